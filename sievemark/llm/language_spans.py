"""Language identification of mixed-language text.

Training counts byte n-grams and scripts of all words of the labelled texts, per task in
hashed buckets, then over all tasks by a grouped sum. A word's score for a language is
the log probability of its n-grams; the script of its first letter, found by code-point
ranges, first narrows the languages to those that are written in it. A Viterbi pass over
the words of a text, with a penalty for every switch, labels each word; runs of one
label are the spans, and the language of most words is the text's.

Most texts never leave one language: if no stretch of words favours another language by
more than half the penalty, the path without a switch is the best, which a running
minimum shows for a whole batch at once. Only the other texts go through the Viterbi
pass, all of a batch step by step together.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is every text
if no language was learned; a null label is no label; repeated rows get equal results; a
null id is not held out; a word in a script of no language says nothing; an empty table
gives an empty result; only the columns named are read. A batch is cut by its number of
words, so memory follows the longest text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
# First code points of the ranges told apart; what lies between is of the range before.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"),
    (0x0F00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x1780, "khmer"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2C60, "latin"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF66, "kana"),
    (0x10000, "other"), (0x20000, "han"),
)
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index(n) for _, n in SCRIPTS])


@dataclass(frozen=True)
class LanguageSpec:
    """Buckets of hashed n-grams (a power of two), penalty of a switch in nats, least
    share of a language's words for one of its scripts, words handled at a time."""

    buckets: int = 1 << 16
    orders: tuple[int, ...] = (2, 3, 4)
    penalty: float = 12.0
    script_share: float = 0.01
    batch_words: int = 400_000
    cached_words: int = 200_000


def letters_of(text: str) -> list[str]:
    """The lower-cased words: runs of letters."""
    found = WORD.findall(text.lower())
    return [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in found if any(map(str.isalpha, w))]


def scripts_of(words: list[str]) -> np.ndarray:
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return SCRIPT_OF[np.searchsorted(STARTS, first, "right") - 1]


def grams(words: list[str], spec: LanguageSpec) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, bucket) of all n-grams of the words, spaces at both ends."""
    data = [f" {w} ".encode("utf-8", "replace") for w in words]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    codes = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(data)), sizes)
    owners, buckets = [], []
    for order in spec.orders:
        if len(codes) < order:
            continue
        last = len(codes) - order + 1
        value = np.full(last, order, np.uint64)
        for k in range(order):
            value = value * np.uint64(0x100000001B3) + codes[k : last + k]
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        inside = owner[:last] == owner[order - 1 :]
        owners.append(owner[:last][inside])
        buckets.append((value >> np.uint64(40)).astype(np.int64)[inside] & (spec.buckets - 1))
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(owners), np.concatenate(buckets)


@dataclass(frozen=True)
class LanguageModel:
    """Learned languages, log probabilities (bucket, language), allowed (script, language)."""

    languages: tuple[str, ...]
    logs: np.ndarray
    allowed: np.ndarray
    spec: LanguageSpec


def learn(
    docs: DataFrame, text_col: str, lang_col: str, spec: LanguageSpec = LanguageSpec()
) -> LanguageModel:
    """Count over all rows of ``docs`` with a text and a language. What comes to the
    driver is bounded by languages x (buckets + scripts), not by the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def settle() -> None:
            for lang, seen in words.items():
                names = list(seen)
                times = np.fromiter(seen.values(), np.float64, len(names))
                table = tables.setdefault(lang, np.zeros(spec.buckets + len(NAMES)))
                owner, bucket = grams(names, spec)
                table[: spec.buckets] += np.bincount(bucket, times[owner], spec.buckets)
                table[spec.buckets :] += np.bincount(scripts_of(names), times, len(NAMES))
            words.clear()

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(letters_of(text))
                if sum(map(len, words.values())) > spec.cached_words:
                    settle()
        settle()
        for lang, table in tables.items():
            place = np.flatnonzero(table)
            yield pa.RecordBatch.from_pydict(
                {"lang": [lang] * len(place), "place": place, "n": table[place].astype(np.int64)},
                schema=pa.schema([("lang", pa.string()), ("place", pa.int64()), ("n", pa.int64())]),
            )

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = (
        rows.where("text IS NOT NULL AND lang IS NOT NULL")
        .mapInArrow(count, "lang string, place bigint, n bigint")
        .groupBy("lang", "place")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    languages = sorted(set(counts["lang"].to_pylist()))
    number = {lang: k for k, lang in enumerate(languages)}
    table = np.zeros((spec.buckets + len(NAMES), len(languages)))
    column = np.fromiter(map(number.__getitem__, counts["lang"].to_pylist()), np.int64, len(counts))
    table[counts["place"].to_numpy(), column] = counts["n"].to_numpy()
    seen = table[: spec.buckets] + 0.5
    scripts = table[spec.buckets :]
    allowed = scripts >= spec.script_share * np.maximum(scripts.sum(axis=0), 1)
    return LanguageModel(
        tuple(languages), np.log(seen / seen.sum(axis=0)).astype(np.float32), allowed, spec
    )


class WordScores:
    """Scores of words per language, remembered up to a bound."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.place: dict[str, int] = {}
        self.scores = np.empty((0, len(model.languages)), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.place) > self.model.spec.cached_words:
            self.place, self.scores = {}, self.scores[:0]
        fresh = list(dict.fromkeys(w for w in words if w not in self.place))
        if fresh:
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh)), strict=True))
            self.scores = np.concatenate([self.scores, self.scored(fresh)])
        return self.scores[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]

    def scored(self, words: list[str]) -> np.ndarray:
        model = self.model
        owner, bucket = grams(words, model.spec)
        made = np.stack(
            [np.bincount(owner, column[bucket], len(words)) for column in model.logs.T], axis=1
        ) / len(model.spec.orders)
        allowed = model.allowed[scripts_of(words)]
        made -= made.max(axis=1, keepdims=True)  # only differences between languages count
        made[~allowed] = -2 * model.spec.penalty
        made[~allowed.any(axis=1)] = 0
        return made.astype(np.float32)


def one_language(scores: np.ndarray, starts: np.ndarray, best: np.ndarray, penalty: float) -> np.ndarray:
    """Whether each text is best labelled with its best language alone: no stretch of
    words favours another language by more than half the penalty."""
    sizes = np.diff(starts)
    text = np.repeat(np.arange(len(sizes)), sizes)
    ahead = scores - scores[np.arange(len(scores)), best[text]][:, None]
    sums = np.cumsum(ahead, axis=0, dtype=np.float64)
    before = np.concatenate([np.zeros((1, sums.shape[1])), sums[:-1]])
    # Texts one below the other: the running minimum starts anew with every text.
    step = float(np.abs(sums).max(initial=0)) * 2 + 1
    floor = np.minimum.accumulate(before - (text * step)[:, None], axis=0) + (text * step)[:, None]
    return np.maximum.reduceat(sums - floor, starts[:-1], axis=0).max(axis=1) <= penalty / 2


def viterbi(scores: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of every word; the texts step together, the longest first."""
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    first, size = starts[:-1][order], sizes[order]
    running = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # texts longer than t
    total = scores[first].astype(np.float64)
    came = np.zeros(scores.shape, np.int32)
    for t in range(1, int(size[0])):
        live = running[t]
        top = total[:live].argmax(axis=1)
        jump = total[np.arange(live), top][:, None] - penalty
        stay = total[:live]
        here = first[:live] + t
        came[here] = np.where(stay >= jump, np.arange(scores.shape[1]), top[:, None])
        total[:live] = np.maximum(stay, jump) + scores[here]
    label = np.zeros(len(scores), np.int32)
    now = total.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        live = running[t] if t else len(size)
        here = first[:live] + t
        label[here] = now[:live]
        now[:live] = came[here, now[:live]]
    return label


def labelled(texts: list[str | None], scorer: WordScores) -> Iterator[tuple[str, float, list[dict]]]:
    """(language, score, spans) of every text."""
    model = scorer.model
    words = [letters_of(t or "") for t in texts]
    if not model.languages:
        yield from ((UNKNOWN, 0.0, []) for _ in texts)
        return
    some = [w for w in words if w]
    starts = np.concatenate([[0], np.cumsum([len(w) for w in some])]).astype(np.int64)
    results = iter(())
    if some:
        scores = scorer.of([w for ws in some for w in ws])
        totals = np.add.reduceat(scores, starts[:-1], axis=0, dtype=np.float64)
        best = totals.argmax(axis=1)
        penalty = model.spec.penalty
        label = np.repeat(best, np.diff(starts)).astype(np.int32)
        mixed = np.flatnonzero(~one_language(scores, starts, best, penalty))
        if len(mixed):
            rows = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in mixed])
            sizes = np.diff(starts)[mixed]
            cut = np.concatenate([[0], np.cumsum(sizes)])
            label[rows] = viterbi(scores[rows], cut, penalty)
        results = iter([described(label[a:b], totals[k], model) for k, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True))])
    for w in words:
        yield next(results) if w else (UNKNOWN, 0.0, [])


def described(label: np.ndarray, total: np.ndarray, model: LanguageModel) -> tuple[str, float, list[dict]]:
    """The language of most words; its share of the words, less where the text as a
    whole fits another language nearly as well; and the spans."""
    counts = np.bincount(label, minlength=len(model.languages))
    main = int(counts.argmax())
    rival = np.delete(total, main).max(initial=-np.inf)
    sure = 1 / (1 + np.exp(-np.clip(total[main] - rival, -50, 50)))
    edges = np.flatnonzero(np.diff(label)) + 1
    cuts = [0, *edges.tolist(), len(label)]
    spans = [
        {"lang": model.languages[label[a]], "from": a, "to": b}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True)
    ]
    return model.languages[main], float(counts[main] / len(label) * sure), spans


def language_spans(text: Column, model: LanguageModel) -> Column:
    """Struct column: ``lang``, ``score`` and ``spans`` (language and [from, to) range
    of words) of every whole text."""
    span = pa.struct([("lang", pa.string()), ("from", pa.int64()), ("to", pa.int64())])
    kinds = (pa.string(), pa.float64(), pa.list_(span))

    @F.arrow_udf("lang string, score double, spans array<struct<lang:string,from:bigint,to:bigint>>")
    def labels(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = WordScores(model)
        for batch in batches:
            rows: list[tuple] = []
            pending: list[str | None] = []
            size = 0
            for t in batch.to_pylist():
                pending.append(t)
                size += len(t or "") // 5
                if size >= model.spec.batch_words:
                    rows += labelled(pending, scorer)
                    pending, size = [], 0
            rows += labelled(pending, scorer)
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.StructArray.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["lang", "score", "spans"],
            )

    return labels.asNondeterministic()(text)  # so that no filter repeats it


def held_out(id_col: str, parts: int = 3, part: int = 1) -> Column:
    mod = F.crc32(F.col(id_col).cast("string").cast("binary")) % parts
    return F.coalesce(mod == part, F.lit(False))


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    spec: LanguageSpec = LanguageSpec(),
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_spans) of every row, by a model of the
    rows that are not held out."""
    model = learn(docs.where(~held_out(id_col)), text_col, lang_col, spec)
    found = docs.select(
        F.col(id_col).alias("doc_id"),
        held_out(id_col).alias("held_out"),
        language_spans(F.col(text_col), model).alias("l"),
    )
    return found.select(
        "doc_id", "held_out", F.col("l.lang").alias("lang_pred"), "l.score",
        F.size("l.spans").cast("long").alias("n_spans"),
    )
