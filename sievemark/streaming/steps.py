"""What is known of a text while its steps arrive, in any order, over many micro-batches."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# Index of something that has not been seen.
NONE = -1
# What a step can be, as bits of one number.
IS_PII, IS_END, FAILED = 1, 2, 4

TEXT_TYPE = (
    "sample_id bigint, until bigint, starts array<bigint>, ends array<bigint>, trigger bigint, fault bigint, fault_text string, "
    "top bigint, top_category string, last bigint, closed boolean, said bigint"
)
# The texts of a bucket, each with the time it may stay quiet until.
STATE_TYPE = f"texts array<struct<{TEXT_TYPE.replace(' ', ': ').replace(',: ', ', ')}>>"


def smaller(one: int, other: int) -> int:
    """The smaller index of those that have been seen."""
    return max(one, other) if NONE in (one, other) else min(one, other)


def joined(starts: list[int], ends: list[int], more: np.ndarray) -> tuple[list[int], list[int]]:
    """A set of intervals (first and last index of each, ascending) with more indexes."""
    index = np.unique(more)
    breaks = np.flatnonzero(np.diff(index) > 1)
    low = np.concatenate([np.array(starts, np.int64), index[np.concatenate([[0], breaks + 1])]])
    high = np.concatenate([np.array(ends, np.int64), index[np.concatenate([breaks, [len(index) - 1]])]])
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    opens = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1] + 1]))
    closes = np.concatenate([opens[1:] - 1, [len(low) - 1]])
    return low[opens].tolist(), high[closes].tolist()


@dataclass
class Progress:
    """Indexes received, as intervals; smallest PII and smallest failed index; largest
    index and its category; index of the end marker; whether the text has been closed;
    what has been said of it. Nothing here depends on the order of the steps or changes
    when a step comes twice, and a text without gaps needs one interval."""

    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    trigger: int = NONE
    fault: int = NONE
    fault_text: str = ""
    top: int = NONE
    top_category: str = ""
    last: int = NONE
    closed: bool = False
    said: int = 0

    @classmethod
    def of(cls, values: tuple) -> Progress:
        starts, ends, *rest = values
        return cls(list(starts), list(ends), *rest)

    def as_state(self) -> tuple:
        return (
            self.starts, self.ends, self.trigger, self.fault, self.fault_text, self.top,
            self.top_category, self.last, self.closed, self.said,
        )

    def add(
        self, index: np.ndarray, flags: np.ndarray, category: np.ndarray, error: np.ndarray,
        intervals: bool = True,
    ) -> None:
        """Take in steps, of which ``flags`` say IS_PII, IS_END, FAILED."""
        highest = int(index.argmax())
        if index[highest] >= self.top:
            self.top = int(index[highest])
            self.top_category = str(category[highest] or "")
        if flags.any():
            hits, marked = index[flags & IS_PII > 0], index[flags & IS_END > 0]
            if len(hits):
                self.trigger = smaller(self.trigger, int(hits.min()))
            if len(marked):
                self.last = max(self.last, int(marked.max()))
            failed = np.flatnonzero(flags & FAILED)
            if len(failed):
                first = failed[index[failed].argmin()]
                if self.fault == NONE or index[first] < self.fault:
                    self.fault, self.fault_text = int(index[first]), str(error[first])
        if intervals:
            self.starts, self.ends = joined(self.starts, self.ends, index)

    @property
    def first(self) -> int:
        """The step the text stops at, PII or failed, reached or not."""
        return smaller(self.trigger, self.fault)

    @property
    def reached(self) -> int:
        """Steps received from step 0 on without a gap."""
        return self.ends[0] + 1 if self.starts and self.starts[0] <= 0 else 0

    @property
    def stopped(self) -> bool:
        """Whether the step the text stops at has been reached."""
        return NONE < self.first < self.reached

    @property
    def complete(self) -> bool:
        """Whether all steps up to the end marker are there."""
        return NONE < self.last < self.reached

    @property
    def missing(self) -> int:
        """Steps that have not come, up to where the text stops or to its largest index."""
        stop = self.top if self.first == NONE else min(self.top, self.first)
        held = sum(
            min(high, stop) - max(low, 0) + 1
            for low, high in zip(self.starts, self.ends, strict=True)
            if low <= stop and high >= 0
        )
        return stop + 1 - held
