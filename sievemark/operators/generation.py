"""Make non-PII counterparts: phrase mapping, and rewrite rounds with verification."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark.functions.answers import with_json_object
from sievemark.functions.flags import has_obvious_pii
from sievemark.functions.text import clean, strip
from sievemark.operators.evalset import take_first
from sievemark.operators.phrase_join import replace_phrases
from sievemark.operators.prompts import (
    REWRITE_NORMAL,
    REWRITE_REQUEST,
    REWRITE_STRICT,
    REWRITE_SYSTEM,
)
from sievemark.operators.ranks import number_rows
from sievemark.session import bound_text_batches, materialize, require_columns, with_computed

STATUS_OK, STATUS_FAILED = "ok", "failed"

# Up to this many phrases the mapping is part of the plan; up to the second bound
# it travels as one broadcast value; beyond that it stays a distributed table.
LITERAL_PHRASES = 500
BROADCAST_PHRASES = 500_000
BROADCAST_CHARS = 20_000_000


# --- phrase mapping -----------------------------------------------------------


def _map_with_literals(df: DataFrame, col: str, phrases: Mapping[str, str]) -> DataFrame:
    singles = {k: v for k, v in phrases.items() if len(k) == 1 and len(v) == 1}
    text = F.col(col)
    if len(singles) == len(phrases):
        return df.withColumn(col, F.translate(text, "".join(singles), "".join(singles.values())))
    # Java tries alternatives in order, so longest first is longest match.
    ordered = sorted(phrases, key=lambda p: (-len(p), p))
    pattern = "|".join(re.escape(p) for p in ordered)
    lookup = F.create_map(*[F.lit(x) for p in ordered for x in (p, phrases[p])])
    staged = df.withColumn("__between", F.split(text, pattern)).withColumn(
        "__hits", F.regexp_extract_all(text, F.lit(pattern), 0)
    )
    replaced = F.transform(F.col("__hits"), lambda h: F.element_at(lookup, h))
    joined = F.array_join(
        F.zip_with(
            F.col("__between"), replaced, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))
        ),
        "",
    )
    return staged.withColumn(col, F.when(text.isNotNull(), joined)).drop("__between", "__hits")


def _longest_match(text: str, by_length: list[tuple[int, dict]], starts: re.Pattern) -> str:
    """Left to right; text that starts no phrase is copied in whole runs."""
    out, copied, at = [], 0, 0
    while (found := starts.search(text, at)) is not None:
        at = found.start()
        for length, table in by_length:
            target = table.get(text[at : at + length])
            if target is not None:
                out += [text[copied:at], target]
                at += length
                copied = at
                break
        else:
            at += 1
    return "".join(out) + text[copied:]


def _map_with_broadcast(df: DataFrame, col: str, phrases: Mapping[str, str]) -> DataFrame:
    tables: dict[int, dict[str, str]] = {}
    for phrase, target in phrases.items():
        tables.setdefault(len(phrase), {})[phrase] = target
    shared = df.sparkSession.sparkContext.broadcast(sorted(tables.items(), reverse=True))

    @F.pandas_udf(T.StringType())
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        by_length = shared.value
        heads = {phrase[0] for _, table in by_length for phrase in table}
        starts = re.compile("[" + "".join(map(re.escape, sorted(heads))) + "]")
        for texts in batches:
            yield texts.map(lambda t: _longest_match(t, by_length, starts), na_action="ignore")

    return bound_text_batches(df).withColumn(col, convert(F.col(col)))


def map_phrases(
    df: DataFrame,
    col: str,
    mapping: Mapping[str, str] | DataFrame,
    literal_phrases: int = LITERAL_PHRASES,
    broadcast_phrases: int = BROADCAST_PHRASES,
    broadcast_chars: int = BROADCAST_CHARS,
) -> DataFrame:
    """Replace phrases from left to right, the longest match first.

    ``mapping`` is a dict or a table (phrase, target). Its size in phrases and
    characters picks the route; all routes give the same result. A phrase that is given
    twice or has no target is an error; empty and null phrases are passed over.
    """
    if isinstance(mapping, DataFrame):
        require_columns(mapping, "phrase", "target")
        table = mapping.where(F.length("phrase") > 0)
        facts = table.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("target").isNull()).alias("without_target"),
            F.coalesce(F.sum(F.length("phrase") + F.length("target")), F.lit(0)).alias("chars"),
        ).first()
        if facts["without_target"]:
            raise ValueError("phrases without a target")
        if not table.groupBy("phrase").count().where("count > 1").isEmpty():
            raise ValueError("repeated phrases")
        if facts["n"] > broadcast_phrases or facts["chars"] > broadcast_chars:
            return replace_phrases(df, col, table)
        phrases = {r["phrase"]: r["target"] for r in table.collect()}
    else:
        phrases = {k: v for k, v in mapping.items() if k}
        if None in phrases.values():
            raise ValueError("phrases without a target")
    if not phrases:
        return df
    if len(phrases) <= literal_phrases:
        return _map_with_literals(df, col, phrases)
    return _map_with_broadcast(df, col, phrases)


Dictionary = Mapping[str, str] | DataFrame


def _one_dictionary(group: Sequence[Dictionary]) -> Dictionary:
    """The dictionaries of a group as one; what several of them have follows the first."""
    if all(isinstance(d, Mapping) for d in group):
        merged: dict[str, str] = {}
        for d in reversed(group):
            merged.update(d)
        return merged
    spark = next(d for d in group if isinstance(d, DataFrame)).sparkSession
    ranked = None
    for place, d in enumerate(group):
        if isinstance(d, Mapping):
            table = spark.createDataFrame(list(d.items()), "phrase string, target string")
        else:
            require_columns(d, "phrase", "target")
            table = d.select("phrase", "target")
        table = table.withColumn("place", F.lit(place))
        ranked = table if ranked is None else ranked.unionByName(table)
    entries = ranked.where(F.length("phrase") > 0).groupBy("phrase", "place")
    once = materialize(entries.agg(F.count(F.lit(1)).alias("n"), F.first("target").alias("target")), "phrases")
    if not once.where("n > 1").isEmpty():
        raise ValueError("repeated phrases")
    return once.groupBy("phrase").agg(F.min_by("target", "place").alias("target"))


def convert_phrases(
    df: DataFrame, col: str, stages: Sequence[Dictionary | Sequence[Dictionary]], **bounds: int
) -> DataFrame:
    """A chain of dictionaries: each stage maps the phrases of what the one before it has
    made, from left to right, the longest match first.

    A stage is a dictionary, or several that are searched together; a phrase that more than
    one of these have is mapped by the first. Every stage takes the route that fits its
    size, as in ``map_phrases``, whose bounds may be given.
    """
    for stage in stages:
        group = [stage] if isinstance(stage, (Mapping, DataFrame)) else list(stage)
        if group:
            df = map_phrases(df, col, _one_dictionary(group), **bounds)
    return df


# --- rewrite, verify, retry --------------------------------------------------


class Rewriter:
    """Base class of user rewriters: a chat request in, the raw answer out."""

    model_id = "rewriter"
    concurrency = 1

    def open(self) -> None:
        pass

    def rewrite(self, messages: list[dict[str, str]], source_text: str, attempt: int) -> str:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _raw_answers(rewriter: Rewriter, attempt: int) -> Callable:
    opening = REWRITE_STRICT if attempt else REWRITE_NORMAL

    @F.pandas_udf("string")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str) -> str:
            chat = [
                {"role": "system", "content": REWRITE_SYSTEM},
                {"role": "user", "content": opening + REWRITE_REQUEST + text},
            ]
            return rewriter.rewrite(chat, text, attempt) or ""

        rewriter.open()
        try:
            with ThreadPoolExecutor(max_workers=max(1, rewriter.concurrency)) as pool:
                for texts in batches:
                    yield pd.Series(list(pool.map(one, texts)), dtype="object")
        finally:
            with suppress(Exception):  # answers already given stand
                rewriter.close()

    return answers.asNondeterministic()


def with_accepted(df: DataFrame, raw: str, out: str = "candidate") -> DataFrame:
    """Add ``out``: the rewritten text of a raw answer if it may be used, else null.

    It must be an object with a non-empty ``non_pii_text`` that shows no obvious PII.
    """
    payload, text = f"__{out}_payload", f"__{out}_text"
    found = with_json_object(df, F.col(raw), payload, generator_form=True)
    value = F.col(payload)["non_pii_text"]
    stated = F.when(
        F.schema_of_variant(value) == "VOID", F.lit("None")
    ).otherwise(F.try_variant_get(value, "$", "string"))
    staged = found.withColumn(text, strip(stated))
    usable = F.when((F.col(text) != "") & ~has_obvious_pii(F.col(text)), F.col(text))
    return with_computed(staged, out, usable).drop(payload, text)


def rewrite_until_clean(
    df: DataFrame,
    rewriter: Rewriter,
    max_retries: int = 2,
    id_col: str = "id",
    text_col: str = "source_text",
) -> DataFrame:
    """Rewrite every text until the answer passes, at most ``max_retries`` retries.

    Returns (id, source_text, content, generation_status, retry_count, model_id,
    raw_response). Each round is one distributed pass over the texts still open and
    is written to the shared folder, so a lost executor repeats no earlier round.
    """
    if max_retries < 0:
        raise ValueError("max_retries must not be negative")
    require_columns(df, id_col, text_col)
    pending = df.select(F.col(id_col).alias("id"), clean(F.col(text_col)).alias("source_text"))
    finished: list[DataFrame] = []
    for attempt in range(max_retries + 1):
        answered = pending.select(
            "id",
            "source_text",
            _raw_answers(rewriter, attempt)("source_text").alias("raw_response"),
        )
        tried = materialize(with_accepted(answered, "raw_response"), f"rewrite-{attempt}")
        accepted = F.col("candidate").isNotNull()
        last = attempt == max_retries
        done = tried if last else tried.where(accepted)
        finished.append(
            done.select(
                "id",
                "source_text",
                F.coalesce("candidate", F.lit("")).alias("content"),
                F.when(accepted, STATUS_OK).otherwise(STATUS_FAILED).alias("generation_status"),
                F.lit(attempt).cast("bigint").alias("retry_count"),
                F.lit(rewriter.model_id).alias("model_id"),
                "raw_response",
            )
        )
        if last:
            break
        pending = tried.where(~accepted).select("id", "source_text")
        if pending.isEmpty():
            break
    result = finished[0]
    for part in finished[1:]:
        result = result.unionByName(part)
    return result


def resolve_attempts(attempts: DataFrame, max_retries: int = 2) -> DataFrame:
    """The same outcome from a stored table of attempts (id, attempt, raw_response).

    One grouped aggregation that combines before the shuffle: the first accepted
    attempt, and the last one for the ids that never succeed.
    """
    tried = with_accepted(attempts.where(F.col("attempt") <= max_retries), "raw_response")
    ok = F.col("candidate").isNotNull()
    first = F.min(
        F.when(ok, F.struct("attempt", "candidate", "raw_response"))
    ).alias("first")
    last = F.max(F.struct("attempt", "raw_response")).alias("last")
    good = F.col("first").isNotNull()
    return (
        tried.groupBy("id")
        .agg(first, last)
        .select(
            "id",
            F.coalesce(F.col("first.candidate"), F.lit("")).alias("content"),
            F.when(good, STATUS_OK).otherwise(STATUS_FAILED).alias("generation_status"),
            F.when(good, F.col("first.attempt"))
            .otherwise(F.lit(max_retries))
            .cast("bigint")
            .alias("retry_count"),
            F.coalesce(F.col("first.raw_response"), F.col("last.raw_response")).alias(
                "raw_response"
            ),
        )
    )


def generation_summary(df: DataFrame) -> DataFrame:
    """Rows and mean retries per status."""
    return df.groupBy("generation_status").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("retry_count"), 4).alias("retries_avg")
    )


def generate_corpus(
    source: DataFrame,
    n: int,
    rewriter: Rewriter,
    max_retries: int = 2,
    id_col: str = "sample_id",
    content_col: str = "content",
) -> DataFrame:
    """Generation rows of the first n texts, numbered from 1 in source order."""
    if n <= 0:
        raise ValueError("count must be positive")
    require_columns(source, id_col, content_col)
    first = take_first(source.select(id_col, content_col), n, id_col)
    numbered = number_rows(first, id_col, "id")
    return rewrite_until_clean(numbered, rewriter, max_retries, "id", content_col)
