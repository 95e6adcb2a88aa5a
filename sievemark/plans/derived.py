"""Input tables the registered queries derive from the given tables.

Model answers, attempts and usage do not come with the data, so they are built from
whole texts and columns of the given tables, for every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions.flags import (
    CARD_16_RULE,
    DEFAULT_RULES,
    IPV4_RULE,
    any_rule,
    rule_flag,
)
from sievemark.operators.generation import Rewriter
from sievemark.operators.moderation import StepScorer
from sievemark.operators.scoring import (
    CASCADE_SCORER,
    EMAIL_SCORER,
    OBVIOUS_SCORER,
    Answer,
    BatchScorer,
    PythonScorer,
)

EMAIL_RULE = DEFAULT_RULES[0]
WIDE_RULES = (EMAIL_RULE, IPV4_RULE, CARD_16_RULE)
SCORERS = (EMAIL_SCORER, OBVIOUS_SCORER, CASCADE_SCORER)

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts. The test tables are one file with one row group, which a single task
    would read; such a table is dealt out over the cores. A table of several files is
    left as it is, however few splits it has."""
    docs = table(spark, sf_dir, "documents")
    if len(docs.inputFiles()) > 1:
        return docs
    return docs.repartition(spark.sparkContext.defaultParallelism, "doc_id")


def wide_truth(text: Column) -> Column:
    """Ground truth of the evaluation queries: a rule set wider than any scorer's."""
    return any_rule(text, WIDE_RULES)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as labelled samples (sample_id, content, lang, n_chars, ground_truth)."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("sample_id"),
        F.col("text").alias("content"),
        "lang",
        "n_chars",
        wide_truth(F.col("text")).alias("ground_truth"),
    )


def said(content: str = "content") -> list[Column]:
    """(model_key, contains_pii) of the rule scorers for one text, as structs."""
    return [
        F.struct(
            F.lit(s.key).alias("model_key"), s.expression(F.col(content)).alias("contains_pii")
        )
        for s in SCORERS
    ]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by every rule scorer, with a latency and a cost that
    follow from the text length. One scan; the texts stay out of the fan-out."""
    return (
        labelled(spark, sf_dir)
        .select(
            "sample_id",
            "lang",
            "ground_truth",
            (F.col("n_chars") / 8).alias("latency_ms"),
            (F.col("n_chars") / 1048576).alias("cost_usd"),
            F.explode(F.array(*said())).alias("s"),
        )
        .select("sample_id", "lang", "ground_truth", "latency_ms", "cost_usd", "s.*")
    )


# --- model answers -------------------------------------------------------------

# Characters that would need escaping inside JSON or end a partial match.
UNSAFE_CHARS = r'["\\{}\x00-\x1f]'


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw): a model answer carrying the whole text, in one of eight shapes."""
    safe = F.regexp_replace("text", UNSAFE_CHARS, " ")
    yes = F.col("n_chars") % 2 == 0
    flag = F.when(yes, "true").otherwise("false")
    label = F.when(yes, "是").otherwise("否")
    confidence = ((F.col("doc_id") % 101) / 100).cast("string")
    shapes = [
        F.concat(
            F.lit('{"contains_pii": '), flag, F.lit(', "label": "'), label,
            F.lit('", "confidence": '), confidence, F.lit(', "reason": "'), safe, F.lit('"}'),
        ),
        F.concat(
            F.lit('```json\n{"label":"'), label, F.lit('","confidence":"'), confidence,
            F.lit('","reason":"'), safe, F.lit('"}\n```'),
        ),
        F.concat(F.lit('{"label": "'), label, F.lit('", "note": "'), safe, F.lit('"}')),
        F.concat(
            F.lit('{\n  "contains_pii": '), flag, F.lit(',\n  "label": "'), label,
            F.lit('",\n  "confidence": '), confidence, F.lit(',\n  "reason": "'), safe,
        ),
        F.concat(
            safe, F.lit(' Answer: {"has_pii": "'), F.when(yes, "YES").otherwise("n"),
            F.lit('", "confidence": 1.7, "reason": null} I hope this helps.'),
        ),
        F.concat(F.lit('{"verdict": 3, "confidence": NaN, "reason": "'), safe, F.lit('"}')),
        safe,
        F.concat(
            F.lit('{"contains_pii": "'), flag, F.lit('", "pii": 1, "confidence": true, "reason": '),
            F.col("n_chars").cast("string"), F.lit(', "note": "'), safe, F.lit('"}'),
        ),
    ]
    shape = F.col("doc_id") % len(shapes)
    raw = F.lit(None).cast("string")
    for number, text in enumerate(shapes):
        raw = F.when(shape == number, text).otherwise(raw)
    return documents(spark, sf_dir).select("doc_id", "n_chars", raw.alias("raw"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, attempt, raw_response): three rewrite attempts per document. Attempt
    ``doc_id % 4`` returns the text itself; the earlier ones are no JSON, an empty
    rewrite, or a rewrite with an address in it."""
    good = F.to_json(F.struct(F.col("text").alias("non_pii_text")))
    bad = F.element_at(
        F.array(
            F.lit("I cannot do that."),
            F.lit('```json\n{"non_pii_text": "  "}\n```'),
            F.lit('{"non_pii_text": "write to a.b@example.com"}'),
        ),
        (F.col("attempt") + 1).cast("int"),
    )
    raw = F.when(F.col("attempt") == F.col("doc_id") % 4, good).otherwise(bad)
    return (
        documents(spark, sf_dir)
        .select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("attempt"))
        .select(F.col("doc_id").alias("id"), "attempt", raw.alias("raw_response"))
    )


# --- deterministic stand-ins for models -------------------------------------------


class AddressScorer(PythonScorer):
    """Answers with JSON after looking for an email address; refuses texts with an
    IPv4 address by raising."""

    key = "address"
    model_id = "python/address"
    concurrency = 4

    def open(self) -> None:
        import re

        self.email = re.compile(EMAIL_RULE.pattern)
        self.ipv4 = re.compile(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}")

    def score(self, content: str) -> Answer:
        if self.ipv4.search(content):
            raise ValueError("not allowed")
        hit = "@" in content and self.email.search(content) is not None
        body = '{"label": "%s", "confidence": "%s"}' % (("是", "0.9") if hit else ("否", "0.2"))
        return Answer(f"```json\n{body}\n```", len(content), 16, len(content) / 1048576)


class AddressBatchScorer(BatchScorer):
    """The same answers for batches of texts; a batch with a refused text fails."""

    key = "address-batch"
    model_id = "python/address-batch"

    def open(self) -> None:
        self.single = AddressScorer()
        self.single.open()

    def score_batch(self, contents: list[str]) -> list[Answer]:
        return [self.single.score(c) for c in contents]


class MaskingRewriter(Rewriter):
    """First returns the text as it is, then masks addresses, then keywords as well."""

    model_id = "python/masking"

    def open(self) -> None:
        import re

        self.email = re.compile(EMAIL_RULE.pattern)
        self.word = re.compile("email", re.IGNORECASE)

    def rewrite(self, messages: list[dict[str, str]], source_text: str, attempt: int) -> str:
        import json

        text = source_text
        if attempt >= 1:
            text = self.email.sub("[mail]", text)
        if attempt >= 2:
            text = self.word.sub("[word]", text)
        return json.dumps({"non_pii_text": text}, ensure_ascii=False)


class AddressSteps(StepScorer):
    """One category per token: PII from the first token with an email address on."""

    def open(self) -> None:
        import re

        self.email = re.compile(EMAIL_RULE.pattern)

    def step(self, token: str, state: list | None) -> tuple[dict, list]:
        hit = "@" in token and self.email.search(token) is not None
        category = "PII" if hit else "None"
        return {"risk_level": "Unsafe" if hit else "Safe", "category": category}, []

    def full(self, tokens: list) -> dict:
        return self.step(" ".join(tokens), None)[0]


def email_token(token: Column) -> Column:
    return rule_flag(token, EMAIL_RULE)

