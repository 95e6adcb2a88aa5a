"""End-to-end workflows and the registered queries."""
