"""Secret scans with corpus-wide ownership frequency, DataFrame functions only.

Every text is scanned once for candidates. Their positions follow from the lengths of
the matches and of the gaps between them, summed up per document. The candidates'
hashes are then counted over the corpus by distinct repositories (documents) and owners
(sources): a value that several owners have in still more repositories is a copied example.
Any other value that also looks random is live: that of one or two owners in however
many documents, and that of some owners who have it once each. Base kinds are always
reported; the added kind
``token`` (a long mixed run outside every base span) is reported only where live.

Cases: a null text counts as empty; a text without candidates gets empty strings and
zero counts; spans of different kinds may overlap, those of one kind never do; repeated
rows are reported one by one but count as one owner; a null owner is an owner of its
own; a null id is kept; texts of any length are scanned whole; an empty table gives an empty result; other columns are not
read, except by ``redact``, which returns them. Values never leave the scan in clear.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.llm.common import free_name, materialize


def either_case(words: str) -> str:
    """A pattern whose letters stand for themselves in either ASCII case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


# Fixed by the task: kinds in the order in which spans of one start are listed. Runs
# below the least length cannot hide a longer match for access and hex, so the length is
# part of their patterns; for assign a dropped match does use up its characters.
ASSIGN = (
    "(" + either_case("password|passwd|secret|token|api_?key") + ")"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
KINDS = ("assign", "access", "hex", "token")
PATTERNS = (ASSIGN, "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}", "[A-Za-z0-9_-]{24,}")
ASSIGN_VALUE_CHARS = 8
BASE_KINDS = 3
# A value with more than this share of the spans is hot; there can only be as many.
HOT_SHARE = 1000
PLACEHOLDER = either_case("example|changeme|placeholder|your_|xxxx|sample|dummy")


@dataclass(frozen=True)
class Ownership:
    """From how many owners and repositories on a value counts as widely copied, and how
    many distinct characters a live value has."""

    wide_owners: int = 3
    wide_repositories: int = 5
    least_distinct: int = 8


def looks_live(value: Column, rules: Ownership) -> Column:
    letters = value.rlike("[A-Za-z]") & value.rlike("[0-9]") & ~value.rlike(PLACEHOLDER)
    return letters & (F.size(F.array_distinct(F.split(value, ""))) >= rules.least_distinct)


def candidates_of(text: Column, kind: int, rules: Ownership) -> Column:
    """Array of the matches of one kind, with the gap in front of each."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def described(match: Column, gap: Column) -> Column:
        value = F.regexp_extract(match, pattern, 2) if kind == 0 else match
        long_enough = F.length(value) >= ASSIGN_VALUE_CHARS if kind == 0 else F.lit(True)
        live = looks_live(value, rules)
        if kind >= BASE_KINDS:
            live = live & value.rlike("[a-z]") & value.rlike("[A-Z]")
            long_enough = live
        return F.struct(
            F.lit(kind).alias("kind"),
            F.length(gap).alias("gap"),
            F.length(match).alias("length"),
            F.sha2(value, 256).alias("hash"),
            live.alias("live"),
            long_enough.alias("counts"),
        )

    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), described)
    return F.when(text.rlike(pattern), pairs).otherwise(F.array())


def scanned(docs: DataFrame, id_col: str, text_col: str, owner_col: str, rules: Ownership) -> DataFrame:
    """(row, doc_id, text_key, owner, candidates): one row per document row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*[candidates_of(text, k, rules) for k in range(len(PATTERNS))])
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_col).alias("text_key"),
        F.col(owner_col).cast("string").alias("owner"),
        found.alias("candidates"),
    )


def placed(scan: DataFrame) -> DataFrame:
    """One row per candidate that counts, with its [start, end) code points."""
    rows = scan.where(F.size("candidates") > 0).select(
        "row", "doc_id", "owner", F.posexplode("candidates").alias("i", "c")
    ).select("row", "doc_id", "owner", "i", "c.*")
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("length")).over(so_far)
    spans = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("length")).where("counts")
    # A token that meets a base span is part of it.
    in_order = Window.partitionBy("row").orderBy("start", "kind")
    base_end = F.when(F.col("kind") < BASE_KINDS, F.col("end"))
    base_start = F.when(F.col("kind") < BASE_KINDS, F.col("start"))
    before = F.max(base_end).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(base_start).over(in_order.rowsBetween(1, Window.unboundedFollowing))
    return (
        spans.withColumn("before", before)
        .withColumn("behind", behind)
        .where(
            (F.col("kind") < BASE_KINDS)
            | (
                (F.coalesce("before", F.lit(0)) <= F.col("start"))
                & (F.coalesce("behind", F.col("end")) >= F.col("end"))
            )
        )
        .select("row", "doc_id", "owner", "kind", "start", "end", "hash", "live")
    )


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories, n_spans) over the corpus; every document is a
    repository of its owner.

    Every task combines its rows to one per (hash, owner, repository), and later to one
    per (hash, owner), so a value that a third of all documents have is no hot key."""
    return (
        spans.groupBy("hash", "owner", "doc_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("hash", "owner")
        .agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
        .groupBy("hash")
        .agg(
            F.count(F.lit(1)).alias("n_owners"),
            F.sum("repositories").alias("n_repositories"),
            F.sum("n").alias("n_spans"),
        )
    )


def widely_copied(rules: Ownership) -> Column:
    """Several owners have the value, in still more repositories. Many documents of one
    owner make no example of its key, and neither do a few owners that have it once."""
    return (F.col("n_owners") >= rules.wide_owners) & (F.col("n_repositories") >= rules.wide_repositories)


def with_verdict(spans: DataFrame, rules: Ownership) -> DataFrame:
    """``spans`` with the column ``wide``. Values with more than a thousandth of all spans,
    of which there are fewer than a thousand, are broadcast; the others meet their verdict
    in a shuffle join. So no task gets all spans of a copied value."""
    owners = materialize(ownership(spans), "secret-owners")
    total = owners.agg(F.sum("n_spans")).first()[0] or 0
    verdict = owners.select(F.col("hash").alias("of_hash"), widely_copied(rules).alias("wide"), "n_spans")
    hot = F.col("n_spans") * HOT_SHARE > total
    same = F.col("hash") == F.col("of_hash")
    common = F.broadcast(verdict.where(hot).select("of_hash", F.col("wide").alias("hot_wide")))
    first = spans.join(common, same, "left").drop("of_hash")
    rest = first.where("hot_wide IS NULL").drop("hot_wide").join(verdict.where(~hot).drop("n_spans"), same)
    known = first.where("hot_wide IS NOT NULL").withColumnRenamed("hot_wide", "wide")
    return known.unionByName(rest.drop("of_hash"))


def secret_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    rules: Ownership = Ownership(),
) -> DataFrame:
    """One row per document row: ``doc_id``, ``text_key`` (hash of the text) and
    ``found``, an array of (start, kind, end, live) sorted by start, then kind."""
    scan = materialize(scanned(docs, id_col, text_col, owner_col, rules), "secret-scan")
    spans = materialize(placed(scan), "secret-spans")
    judged = (
        with_verdict(spans, rules)
        .withColumn("live", F.col("live") & ~F.col("wide"))
        .where((F.col("kind") < BASE_KINDS) | F.col("live"))
    )
    found = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("found")
    )
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean>>")
    return (
        scan.select("row", "doc_id", "text_key")
        .join(found, "row", "left")
        .select("doc_id", "text_key", F.coalesce("found", empty).alias("found"))
    )


def listed(found: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def counted(found: Column, kind: int) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def report(spans: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of every document."""
    found = F.col("found")
    return spans.select(
        "doc_id",
        *[counted(found, k).alias(f"n_{KINDS[k]}") for k in range(len(KINDS))],
        F.sha2(listed(F.filter(found, lambda s: s["kind"] < BASE_KINDS)), 256).alias("base_sha256"),
        listed(found).alias("spans"),
        F.size(F.filter(found, lambda s: s["live"])).cast("long").alias("n_live"),
    )


def redact(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    rules: Ownership = Ownership(),
    mark: str = "[SECRET]",
) -> DataFrame:
    """``docs`` with every live span of the text replaced by ``mark``; copied examples
    stay. Columns are those of ``docs``."""
    id_, key, cuts_ = (free_name(docs, n) for n in ("_id", "_key", "_cuts"))
    live = (
        secret_spans(docs, id_col, text_col, owner_col, rules)
        .select(
            F.col("doc_id").alias(id_),
            F.col("text_key").alias(key),
            F.filter("found", lambda s: s["live"]).alias(cuts_),
        )
        .where(F.size(cuts_) > 0)
        .dropDuplicates([id_, key])
    )
    text = F.col(text_col)
    size = F.length(text).cast("long")
    cuts = F.concat(
        F.transform(
            cuts_,
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(mark).alias("mark")),
        ),
        F.array(F.struct(size.alias("start"), size.alias("end"), F.lit("").alias("mark"))),
    )

    def cut(done: Column, s: Column) -> Column:
        gap = F.substring(text, (done["next"] + 1).cast("int"), (s["start"] - done["next"]).cast("int"))
        overlaps = s["start"] < done["next"]
        return F.struct(
            F.when(overlaps, done["text"])
            .otherwise(F.concat(done["text"], gap, s["mark"]))
            .alias("text"),
            F.greatest(done["next"], s["end"]).alias("next"),
        )

    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("next"))
    cleaned = F.aggregate(cuts, start, cut)["text"]
    same = docs[id_col].eqNullSafe(live[id_]) & (F.xxhash64(text_col) == live[key])
    joined = docs.join(live, same, "left")
    return joined.withColumn(
        text_col, F.when(F.col(cuts_).isNotNull(), cleaned).otherwise(text)
    ).select(*docs.columns)
