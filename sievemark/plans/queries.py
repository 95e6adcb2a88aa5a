"""The registered queries: every operator over whole tables.

Each takes (spark, sf_dir) and returns a DataFrame. ``oracles`` holds the matching
SQL. Only queries whose subject is a sample size or a top-k keep a limit.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions import answers as A
from sievemark.functions import guard as G
from sievemark.functions.flags import DEFAULT_RULES, has_obvious_pii
from sievemark.functions.text import clean, strip, truncate_tokens, words
from sievemark.operators import (
    compare,
    cost,
    evalset,
    generation,
    metrics,
    moderation,
    pii,
    prompts,
    ranks,
    scoring,
)
from sievemark.plans import benchmark
from sievemark.plans import derived as D
from sievemark.session import materialize, new_scratch_path, small_or_materialized
from sievemark.sources import readers, writers
from sievemark.streaming import moderation as stream

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def count_true(name: str, alias: str | None = None) -> Column:
    return F.count_if(F.col(name)).alias(alias or name)


def md5(column: Column) -> Column:
    return F.md5(column.cast("binary"))


# --- flags ------------------------------------------------------------------------


@query
def pii_flags_by_lang(spark, sf_dir):
    docs = pii.pii_regex_flags(D.documents(spark, sf_dir), "text")
    return (
        pii.pii_flags(docs, "text")
        .groupBy("lang")
        .agg(
            F.count(F.lit(1)).alias("docs"),
            *[count_true(f"has_{r.name}") for r in DEFAULT_RULES],
            count_true("regex_pii"),
            count_true("keyword_pii"),
            count_true("obvious_pii"),
        )
    )


@query
def pii_spans(spark, sf_dir):
    return pii.pii_spans(D.documents(spark, sf_dir), "doc_id", "text", D.WIDE_RULES)


@query
def clean_length(spark, sf_dir):
    padded = F.concat(F.lit(" \t　\x85"), "text", F.lit("\xa0\n\x1f "))
    return D.documents(spark, sf_dir).select(
        "doc_id", F.length(clean(padded)).cast("bigint").alias("clean_chars")
    )


# --- evaluation sets ------------------------------------------------------------------

SAMPLES = 100


def _sources(spark, sf_dir):
    """(positives, negatives). Only ids and flags are stored; the operators choose by id and
    then fetch the few texts they have chosen."""
    docs = D.documents(spark, sf_dir).select("doc_id", "text")
    flags = materialize(docs.select("doc_id", has_obvious_pii(F.col("text")).alias("found")), "flags")
    return tuple(
        docs.join(flags.where(F.col("found") == found), "doc_id", "left_semi") for found in (True, False)
    )


def _eval_columns(df):
    return df.select("sample_id", md5(F.col("content")).alias("md5"), "ground_truth", "sample_type")


@query
def eval_set_rows(spark, sf_dir):
    positives, negatives = _sources(spark, sf_dir)
    built = evalset.build_eval_set(
        positives, SAMPLES, non_pii=negatives, id_col="doc_id", content_col="text"
    )
    return _eval_columns(built)


@query
def eval_set_counts(spark, sf_dir):
    positives, negatives = _sources(spark, sf_dir)
    built = evalset.build_eval_set(
        positives, SAMPLES, non_pii=negatives, id_col="doc_id", content_col="text"
    )
    return built.groupBy("sample_type", "ground_truth").agg(F.count(F.lit(1)).alias("n"))


@query
def eval_set_redacted(spark, sf_dir):
    docs = D.documents(spark, sf_dir)
    return _eval_columns(
        evalset.build_eval_set(docs, SAMPLES, id_col="doc_id", content_col="text")
    )


@query
def eval_set_positive_only(spark, sf_dir):
    built = evalset.build_eval_set(
        D.documents(spark, sf_dir), SAMPLES, include_negative=False,
        id_col="doc_id", content_col="text",
    )
    return _eval_columns(built)


@query
def top_up(spark, sf_dir):
    few, many = _sources(spark, sf_dir)
    n = 2 * SAMPLES
    filled = evalset.top_up(
        evalset.sample_n(few, n, "doc_id"), many, n, "doc_id", "text", few.limit(n).count()
    )
    return filled.select("sample_id", md5(F.col("content")).alias("md5"))


@query
def sample_negatives(spark, sf_dir):
    return evalset.sample_n(D.documents(spark, sf_dir), SAMPLES, "doc_id").select("doc_id", "lang")


@query
def redact_templates(spark, sf_dir):
    return D.documents(spark, sf_dir).select(
        "doc_id", evalset.redact(F.col("text")).alias("redacted")
    )


@query
def shuffled_order(spark, sf_dir):
    keyed = D.documents(spark, sf_dir).select(
        "doc_id", evalset.seeded_key("doc_id", evalset.SHUFFLE_SEED).alias("shuffle_key")
    )
    return ranks.number_rows(keyed, "shuffle_key", "position").select("doc_id", "position")


# --- text transformation ------------------------------------------------------------

PHRASES = {"tionier": "[1]", "tion": "[2]", "que": "[3]", "ier": "[4]", "ß": "ss", "ê": "e^"}


@query
def phrase_map(spark, sf_dir):
    mapped = generation.map_phrases(D.documents(spark, sf_dir), "text", PHRASES)
    return mapped.select("doc_id", md5(F.col("text")).alias("md5"))


@query
def phrase_map_broadcast(spark, sf_dir):
    mapped = generation.map_phrases(
        D.documents(spark, sf_dir).select("doc_id", "text"), "text", PHRASES, literal_phrases=0
    )
    return mapped.select("doc_id", md5(F.col("text")).alias("md5"))


@query
def phrase_map_join(spark, sf_dir):
    """The same mapping as a table that is neither small nor broadcast."""
    table = spark.createDataFrame(list(PHRASES.items()), "phrase string, target string")
    mapped = generation.map_phrases(
        D.documents(spark, sf_dir).select("doc_id", "text"), "text", table, 0, 0
    )
    return mapped.select("doc_id", md5(F.col("text")).alias("md5"))


# Each stage undoes, or goes on from, what the one before it has made.
STAGES = (
    {"tion": "que", "ß": "ss"},
    ({"que": "KE", "s": "z"}, {"s": "never", "ier": "ER"}),
    {"KE": "tion", "z": "s"},
)


@query
def phrase_stages(spark, sf_dir):
    """Three dictionaries in order; the second one is a group, its last part a table."""
    docs = D.documents(spark, sf_dir).select("doc_id", "text")
    first, (strong, weak), last = STAGES
    table = spark.createDataFrame(list(weak.items()), "phrase string, target string")
    mapped = generation.convert_phrases(docs, "text", [first, (strong, table), last])
    return mapped.select("doc_id", md5(F.col("text")).alias("md5"))


@query
def resolve_attempts(spark, sf_dir):
    resolved = generation.resolve_attempts(D.attempts(spark, sf_dir))
    return resolved.select(
        "id",
        md5(F.col("content")).alias("content_md5"),
        "generation_status",
        "retry_count",
    )


@query
def generation_summary(spark, sf_dir):
    return generation.generation_summary(generation.resolve_attempts(D.attempts(spark, sf_dir)))


@query
def rewrite_rounds(spark, sf_dir):
    docs = D.documents(spark, sf_dir)
    rows = generation.rewrite_until_clean(
        docs, D.MaskingRewriter(), max_retries=2, id_col="doc_id", text_col="text"
    )
    return rows.select(
        F.col("id").alias("doc_id"),
        md5(F.col("content")).alias("content_md5"),
        "generation_status",
        "retry_count",
    )


@query
def generate_corpus(spark, sf_dir):
    rows = generation.generate_corpus(
        D.documents(spark, sf_dir), SAMPLES, D.MaskingRewriter(), 2, "doc_id", "text"
    )
    return rows.select(
        "id", md5(F.col("source_text")).alias("source_md5"), "generation_status", "retry_count",
        "model_id",
    )


@query
def rewrite_requests(spark, sf_dir):
    chat = prompts.rewrite_messages(F.col("text"), F.col("n_chars") % 2 == 1)
    return D.documents(spark, sf_dir).select(
        "doc_id", md5(prompts.flatten_messages(chat)).alias("request_md5")
    )


# --- prompts ------------------------------------------------------------------------------

MODELS = ("guard/base", "guard/own")
OVERRIDES = {"guard/own": "只輸出 JSON。"}


@query
def render_prompts(spark, sf_dir):
    samples = D.documents(spark, sf_dir).select("doc_id", F.col("text").alias("content"))
    rendered = prompts.render(samples, MODELS, list(prompts.TASKS), OVERRIDES)
    return rendered.select(
        "doc_id",
        "model_id",
        "task_id",
        md5(F.col("system")).alias("system_md5"),
        md5(F.col("user")).alias("user_md5"),
    )


@query
def prompt_validation(spark, sf_dir):
    """Which of the wanted tasks are known, in the wanted order; one is not."""
    wanted = [*reversed(prompts.TASKS), "unheard-of"]
    rows = []
    for place, name in enumerate(wanted):
        try:
            rows.append((place, name, name in prompts.known_tasks(prompts.TASKS, [name])))
        except ValueError:
            rows.append((place, name, False))
    known = F.broadcast(spark.createDataFrame(rows, "place int, task_id string, known boolean"))
    samples = D.documents(spark, sf_dir).select("doc_id", F.col("text").alias("content"))
    ids = [name for _, name, good in rows if good]
    rendered = prompts.render(samples, MODELS[:1], ids).groupBy("task_id").agg(
        F.count(F.lit(1)).alias("prompts")
    )
    return known.join(rendered, "task_id", "left").select(
        "place", "task_id", "known", F.coalesce("prompts", F.lit(0)).alias("prompts")
    )


@query
def flatten_chat(spark, sf_dir):
    chat = prompts.messages(F.lit(prompts.SYSTEM_PROMPT), F.col("text"))
    return D.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", md5(prompts.flatten_messages(chat)).alias("chat_md5")
    )


@query
def flatten_turns(spark, sf_dir):
    """Whole conversations as ``role: text`` lines in the order of their turns."""
    chats = prompts.flatten_turns(D.table(spark, sf_dir, "conversations"), "conv_id")
    return chats.select("conv_id", "turns", md5(F.col("chat")).alias("chat_md5"))


# --- scoring, tokens, cost ------------------------------------------------------------------


@query
def score_rules(spark, sf_dir):
    samples = D.documents(spark, sf_dir).select("doc_id", F.col("text").alias("content"))
    rows = scoring.score_all(samples, D.SCORERS)
    return rows.select("doc_id", "model_key", "contains_pii", "output_json", "cost_usd")


@query
def score_python(spark, sf_dir):
    samples = D.documents(spark, sf_dir).select("doc_id", F.col("text").alias("content"))
    rows = scoring.score(samples, D.AddressScorer())
    reason = F.get_json_object("output_json", "$.reason")
    confidence = F.get_json_object("output_json", "$.confidence").cast("double")
    return rows.select(
        "doc_id", "contains_pii", confidence.alias("confidence"), reason.alias("reason"),
        "prompt_tokens", "completion_tokens", "error",
    )


@query
def score_batches(spark, sf_dir):
    """A scorer that takes batches; those with a refused text are split until it is alone."""
    samples = D.documents(spark, sf_dir).select("doc_id", F.col("text").alias("content"))
    rows = scoring.score(samples, D.AddressBatchScorer())
    return rows.select(
        "doc_id", "contains_pii", "prompt_tokens", "completion_tokens", "cost_usd", "error"
    )


@query
def score_all_errors(spark, sf_dir):
    """Scorers at the same time, one of which cannot be opened; never more than 8 calls of
    a scorer under way."""
    samples = D.documents(spark, sf_dir).select(
        "doc_id", F.col("text").alias("content"), "lang"
    )
    scorers = [*D.SCORERS[:2], _Unavailable(), D.AddressScorer()]
    rows = scoring.score_all(samples, scorers, on_error="row", max_calls=8)
    reason = F.get_json_object("output_json", "$.reason")
    return rows.groupBy("model_key", "lang").agg(
        F.count(F.lit(1)).alias("rows"),
        count_true("contains_pii", "flagged"),
        F.count("error").alias("errors"),
        F.max(F.when(F.col("model_key") == "unavailable", reason)).alias("reason"),
    )


@query
def score_all_totals(spark, sf_dir):
    samples = D.documents(spark, sf_dir).select(
        "doc_id", F.col("text").alias("content"), "lang"
    )
    rows = scoring.score_all(samples, [*D.SCORERS, D.AddressScorer()])
    return rows.groupBy("model_key", "lang").agg(
        F.count(F.lit(1)).alias("rows"),
        count_true("contains_pii", "flagged"),
        F.count("error").alias("errors"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
    )


PRICE_LIST = (
    '{"data": ['
    '{"id": "click", "pricing": {"prompt": "0.5", "completion": "9"}},'
    '{"id": "click", "pricing": {"prompt": "0.000125", "completion": "0.0005"}},'
    '{"id": "view", "pricing": {"prompt": 0.00025, "completion": 0.001}},'
    '{"id": "error", "pricing": {"prompt": "free", "completion": "0"}},'
    '{"id": "signup", "pricing": {"prompt": "0.1"}},'
    '{"pricing": {"prompt": "1", "completion": "1"}}]}'
)


def _usage(spark, sf_dir):
    return D.table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("model_id"),
        F.floor("value").cast("bigint").alias("prompt_tokens"),
        F.when(F.col("user_id") % 2 == 0, F.col("event_id") % 50).alias("completion_tokens"),
        F.when(F.col("event_id") % 10 == 0, F.lit("0.25"))
        .when(F.col("event_id") % 10 == 1, F.lit("n/a"))
        .alias("reported"),
    )


@query
def cost_by_model(spark, sf_dir):
    prices = cost.clean_pricing(spark.createDataFrame([(PRICE_LIST,)], "raw string"))
    priced = cost.with_cost(_usage(spark, sf_dir), prices, "reported")
    return priced.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens_total"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens_total"),
        *[c.alias(n) for n, c in metrics.cost_columns("cost_usd").items()],
    )


@query
def token_totals(spark, sf_dir):
    return cost.token_totals(_usage(spark, sf_dir), ["model_id"])


@query
def truncated_tokens(spark, sf_dir):
    return D.documents(spark, sf_dir).select(
        "doc_id", md5(truncate_tokens(F.col("text"), 64)).alias("md5")
    )


# --- model answers ------------------------------------------------------------------------------


@query
def normalize_outputs(spark, sf_dir):
    rows = A.with_normalized(D.answers(spark, sf_dir), "raw")
    n = F.col("normalized")
    return rows.select(
        "doc_id",
        n["contains_pii"].alias("contains_pii"),
        n["label"].alias("label"),
        n["confidence"].alias("confidence"),
        md5(n["reason"]).alias("reason_md5"),
    )


@query
def free_text_cascade(spark, sf_dir):
    return D.documents(spark, sf_dir).select(
        "doc_id", A.free_text_decision(F.col("text")).alias("decision")
    )


@query
def reread_outputs(spark, sf_dir):
    """Stored records read again: the answer sits in their ``raw_text``."""
    stored = D.answers(spark, sf_dir).select(
        "doc_id",
        A.json_text(contains_pii=F.lit(None).cast("boolean"), raw_text=F.col("raw")).alias("raw"),
    )
    return A.with_parsed_decision(stored, "raw", "decision").select("doc_id", "decision")


@query
def reread_deep(spark, sf_dir):
    """Answers wrapped one to six times, with a JSON object or a word at the core."""
    yes = F.col("n_chars") % 2 == 0
    stated = A.json_text(contains_pii=yes, reason=md5(F.col("text")))
    word = F.when(yes, "yes, it does").otherwise("no")
    rows = D.documents(spark, sf_dir).select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, word).otherwise(stated).alias("raw")
    )
    for wraps in range(1, 7):
        outer = A.json_text(contains_pii=F.lit(None).cast("boolean"), raw_text=F.col("raw"))
        deep = F.col("doc_id") % 6 + 1 >= wraps
        rows = rows.withColumn("raw", F.when(deep, outer).otherwise(F.col("raw")))
    return A.with_parsed_decision(rows, "raw", "decision").select("doc_id", "decision")


@query
def truth_words(spark, sf_dir):
    """Ground truth written as words."""
    words = F.array(*[F.lit(w) for w in ("是", " YES ", "true", "1", "有", "no", "", "2")])
    said = F.get(words, (F.col("n_chars") % 9).cast("int"))  # the ninth is null
    return D.documents(spark, sf_dir).select("doc_id", A.truth_from_text(said).alias("truth"))


@query
def guard_text_parse(spark, sf_dir):
    kind = F.col("event_type")
    category = (
        F.when(kind == "error", "PII, Unethical Acts")
        .when(kind == "click", "violent, Violent, None")
        .when(kind == "view", "None")
        .otherwise("")
    )
    text = F.concat(
        F.lit("Safety: "), F.when(F.col("value") > 50, "Unsafe").otherwise("safe"),
        F.lit("\nCategory: "), category,
        F.when(F.col("user_id") % 2 == 0, "\nRefusal: No").otherwise(""),
    )
    parsed = D.table(spark, sf_dir, "events").select(
        "event_id", G.parse_guard_text(text).alias("g")
    )
    return parsed.select(
        "event_id",
        F.col("g.risk_level").alias("risk_level"),
        F.array_join("g.categories", "|").alias("categories"),
        F.col("g.refusal").alias("refusal"),
        G.has_pii_category(F.lit(""), F.col("g.categories")).alias("has_pii"),
    )


def _category_arrays(spark, sf_dir):
    """Per-token arrays of every document: category, risk level and guard text."""
    token = words(F.col("text"))
    per_token = lambda yes, no: F.transform(
        F.col("tokens"), lambda t: F.when(D.email_token(t), F.lit(yes)).otherwise(F.lit(no))
    )
    docs = D.documents(spark, sf_dir).select("doc_id", "lang", token.alias("tokens"))
    return docs.select(
        "doc_id",
        "lang",
        per_token("PII", "None").alias("category"),
        per_token("Unsafe", "Safe").alias("risk_level"),
    )


@query
def category_arrays(spark, sf_dir):
    c = F.col("category")
    return _category_arrays(spark, sf_dir).select(
        "doc_id",
        G.first_pii_index(c).alias("first_pii"),
        G.last_item(c).alias("last_category"),
        G.pick(c, 2).alias("third_category"),
        F.size(c).cast("bigint").alias("tokens"),
    )


@query
def contract_check(spark, sf_dir):
    rows = A.with_contract(D.answers(spark, sf_dir), "raw").select("contract.*")
    return rows.agg(
        F.count(F.lit(1)).alias("answers"), *[count_true(name) for name in rows.columns]
    )


# --- moderation -------------------------------------------------------------------------------


@query
def early_stop_batch(spark, sf_dir):
    rows = moderation.early_stop_arrays(_category_arrays(spark, sf_dir))
    return rows.select(
        "doc_id", "processed_tokens", "total_tokens", "trigger_index", "early_stopped"
    )


def _token_steps(spark, sf_dir):
    return moderation.steps_from_texts(
        D.documents(spark, sf_dir), D.email_token, "doc_id", "text"
    )


@query
def early_stop_steps(spark, sf_dir):
    return moderation.early_stop(_token_steps(spark, sf_dir), "doc_id")


@query
def processed_steps(spark, sf_dir):
    kept = moderation.processed_steps(_token_steps(spark, sf_dir), "doc_id")
    return kept.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("steps"), F.max("token_index").alias("last_index")
    )


def _event_steps(events, *more):
    return events.select(
        *more,
        F.col("user_id").alias("sample_id"),
        F.col("event_id").alias("token_index"),
        F.when(F.col("event_type") == "error", "PII").otherwise("None").alias("category"),
    )


@query
def early_stop_events(spark, sf_dir):
    return moderation.early_stop_sparse(_event_steps(D.table(spark, sf_dir, "events")))


@query
def early_stop_savings(spark, sf_dir):
    rows = moderation.early_stop_arrays(_category_arrays(spark, sf_dir))
    return moderation.early_stop_savings(rows, ("lang",))


@query
def moderate_arrays(spark, sf_dir):
    rows = moderation.moderate_arrays(_category_arrays(spark, sf_dir))
    return rows.select(
        "doc_id", "early_stopped", "trigger_index", "processed_tokens",
        "decision.risk_level", "decision.category", "decision.contains_pii", "decision.label",
        "decision.reason",
    )


@query
def moderate_texts(spark, sf_dir):
    docs = D.documents(spark, sf_dir).select("doc_id", F.col("text").alias("content"))
    rows = moderation.with_guard_output(moderation.moderate_texts(docs, D.AddressSteps()))
    return rows.select(
        "doc_id", "stream_mode", "early_stopped", "trigger_index", "processed_tokens",
        "total_tokens", "inferred_pii", "contains_pii", "output_json",
    )


@query
def moderate_empty(spark, sf_dir):
    """Every third text is empty, every third one blank: neither reaches the model."""
    third = F.col("doc_id") % 3
    content = F.when(third == 0, "").when(third == 1, " \n\t ").otherwise(F.col("text"))
    docs = D.documents(spark, sf_dir).select("doc_id", content.alias("content"))
    rows = moderation.with_guard_output(moderation.moderate_texts(docs, D.AddressSteps()))
    return rows.select(
        "doc_id",
        "contains_pii",
        "total_tokens",
        F.get_json_object("output_json", "$.reason").alias("reason"),
        F.get_json_object("output_json", "$.label").alias("label"),
    )


@query
def fallback_moderation(spark, sf_dir):
    """Step 0 of Spanish texts fails, the third step of short German ones does."""
    arrays = _category_arrays(spark, sf_dir)
    tokens = F.size("category")
    error = F.when(F.col("lang") == "es", F.array(F.lit("no stream"))).when(
        (F.col("lang") == "de") & (tokens >= 3) & (tokens < 100),
        F.array(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("step broke")),
    )
    none = F.array().cast("array<string>")
    steps = arrays.withColumn("error", F.coalesce(error, none))
    full = D.documents(spark, sf_dir).select(
        "doc_id",
        F.array(F.when(D.email_token(F.col("text")), "PII").otherwise("None")).alias("category"),
    )
    rows = moderation.with_fallback(steps, full, "doc_id")
    return rows.select(
        "doc_id",
        "stream_mode",
        "step_error",
        F.size("category").cast("bigint").alias("steps"),
        G.first_pii_index(F.col("category")).alias("first_pii"),
    )


@query
def inferred_triggers(spark, sf_dir):
    """Arrays of texts that were never stopped: PII is inferred afterwards."""
    rows = _category_arrays(spark, sf_dir).withColumn("early_stopped", F.col("lang") == "fr")
    return moderation.infer_trigger(rows).select(
        "doc_id", "early_stopped", "inferred_pii", "inferred_trigger_index"
    )


@query
def moderation_events(spark, sf_dir):
    rows = moderation.early_stop_arrays(_category_arrays(spark, sf_dir))
    return moderation.moderation_events(rows, "doc_id")


# --- streaming ----------------------------------------------------------------------------------


def _stream_table(spark, sf_dir, name):
    """A given table as a stream. A stream is read from a folder: the table's own, or, where
    the table is one file, the folder that holds it."""
    stored, file = D.table(spark, sf_dir, name), f"{name}.parquet"
    live = spark.readStream.schema(stored.schema)
    if any(path.endswith(f"/{file}") for path in stored.inputFiles()):
        return live.option("pathGlobFilter", file).parquet(sf_dir)
    return live.parquet(f"{sf_dir}/{file}")


@query
def early_stop_stream(spark, sf_dir):
    docs = _stream_table(spark, sf_dir, "documents")
    steps = moderation.steps_from_texts(docs, D.email_token, "doc_id", "text")
    return stream.drain(stream.early_stop_stream(steps, "doc_id", unbounded=True), "doc_id")


@query
def early_stop_sessions(spark, sf_dir):
    events = _stream_table(spark, sf_dir, "events")
    steps = _event_steps(events)
    sessions = stream.drain(stream.early_stop_sessions(steps, unbounded=True))
    return sessions.select(
        "sample_id", "trigger_index", "early_stopped", "processed_tokens", "total_tokens", "closed"
    )


@query
def early_stop_sessions_closed(spark, sf_dir):
    """Sessions that end at a marker: the last event of a user closes the session."""
    events = D.table(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max("event_id").alias("last_id"))
    marked = events.join(last, "user_id").select(
        "user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") == F.col("last_id")).alias("is_end"),
    )
    path = new_scratch_path(spark, "marked-events")
    marked.write.parquet(path)
    live = spark.readStream.schema(marked.schema).parquet(path)
    steps = _event_steps(live, "is_end", "ts")
    sessions = stream.early_stop_sessions(steps, end_col="is_end", ts_col="ts")
    return stream.drain(sessions).select(
        "sample_id", "trigger_index", "early_stopped", "processed_tokens", "total_tokens", "closed"
    )


def _user_steps(spark, sf_dir):
    """Events as steps, numbered from 0 for each user; one in a hundred fails, and the last
    one of each user carries the end marker."""
    events = D.table(spark, sf_dir, "events").withColumn("place", F.struct("user_id", "event_id"))
    numbered = materialize(ranks.number_rows(events, "place", "row").drop("place"), "numbered")
    users = numbered.groupBy("user_id").agg(F.min("row").alias("low"), F.max("row").alias("high"))
    return numbered.join(small_or_materialized(users), "user_id").select(
        F.col("user_id").alias("sample_id"),
        (F.col("row") - F.col("low")).alias("token_index"),
        F.when(F.col("event_type") == "error", "PII").otherwise("None").alias("category"),
        F.when(F.col("event_id") % 101 == 5, "step broke").alias("error"),
        (F.col("row") == F.col("high")).alias("is_end"),
        (F.col("high") - F.col("low")).alias("last"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
    )


def _arriving(spark, steps, path=None, files=16):
    """The steps as a stream in which they arrive in no order, some files at a time."""
    path = path or new_scratch_path(spark, "steps")
    steps.repartition(files, F.xxhash64("sample_id", "token_index")).write.mode("append").parquet(path)
    return spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 6).parquet(path)


@query
def early_stop_sessions_gaps(spark, sf_dir):
    """Steps out of order, some of which never come: what follows is not processed."""
    steps = _user_steps(spark, sf_dir).where(F.col("event_id") % 50 != 7)
    live = _arriving(spark, steps.select("sample_id", "token_index", "category"))
    return stream.drain(stream.early_stop_sessions(live, unbounded=True, contiguous=True))


@query
def early_stop_contiguous(spark, sf_dir):
    """The same steps in batch."""
    steps = _user_steps(spark, sf_dir).where(F.col("event_id") % 50 != 7)
    stops = moderation.early_stop_contiguous(steps)
    return stops.select(
        "sample_id", "processed_tokens", "total_tokens", "trigger_index", "early_stopped"
    )


@query
def early_stop_sessions_late(spark, sf_dir):
    """Sessions closed after two thirds of their steps; the others come later."""
    steps = _user_steps(spark, sf_dir).withColumn("is_end", F.col("token_index") == F.floor(F.col("last") * 2 / 3))
    path = new_scratch_path(spark, "late-steps")
    columns = ["sample_id", "token_index", "category", "is_end", "ts"]
    early = F.col("token_index") <= F.floor(F.col("last") * 2 / 3)
    steps.where(early).select(columns).coalesce(6).write.parquet(path)
    live = _arriving(spark, steps.where(~early).select(columns), path)
    # No step is too late for the watermark.
    sessions = stream.early_stop_sessions(
        live, end_col="is_end", ts_col="ts", watermark="36500 days"
    )
    return stream.drain(sessions)


@query
def moderation_event_stream(spark, sf_dir):
    """Events of a stream that is stopped half-way and started again."""
    steps = _user_steps(spark, sf_dir).select("sample_id", "token_index", "category", "error")
    names = ("step-files", "events", "event-state")
    path, out, state = (new_scratch_path(spark, name) for name in names)
    half = F.pmod(F.xxhash64("token_index", "sample_id"), F.lit(2))
    for part in (0, 1):
        live = _arriving(spark, steps.where(half == part), path)
        events = stream.event_stream(live, error_col="error", unbounded=True)
        stream.write_event_stream(events, out, state, available_now=True).awaitTermination()
    return spark.read.schema(stream.EVENT_TYPE).json(out)


@query
def step_events(spark, sf_dir):
    """The same events from the stored steps."""
    return moderation.step_events(_user_steps(spark, sf_dir), error_col="error")


@query
def fallback_stream(spark, sf_dir):
    """Users whose first event fails are judged by all their events at once; the others
    wait for their last event, whatever comes before it."""
    steps = _user_steps(spark, sf_dir)
    first = (F.col("sample_id") % 3 == 0) & (F.col("token_index") == 0)
    steps = steps.withColumn("error", F.when(first, "no stream").otherwise(F.col("error")))
    many = F.count_if(F.col("category") == "PII") * 5 > F.count(F.lit(1))
    full = materialize(
        steps.groupBy("sample_id").agg(F.array(F.when(many, "PII").otherwise("None")).alias("category")),
        "full-users",
    )
    live = _arriving(spark, steps.select("sample_id", "token_index", "category", "error", "is_end"))
    return stream.drain_rows(stream.fallback_stream(live, full))


# --- metrics ------------------------------------------------------------------------------------


@query
def confusion_by_scorer(spark, sf_dir):
    return metrics.confusion(
        D.scored(spark, sf_dir), "contains_pii", "ground_truth", ["model_key", "lang"]
    )


@query
def binary_metrics(spark, sf_dir):
    return metrics.binary_metrics(
        D.scored(spark, sf_dir), "contains_pii", "ground_truth", ["model_key"]
    )


@query
def binary_metrics_unparseable_true(spark, sf_dir):
    return metrics.binary_metrics(
        D.scored(spark, sf_dir), "contains_pii", None, ["model_key"], treat_unparseable_as=True
    )


@query
def guard_metrics(spark, sf_dir):
    rows = materialize(D.scored(spark, sf_dir), "scored")
    return metrics.guard_metrics(rows, by=["model_key", "lang"])


@query
def latency_p95(spark, sf_dir):
    return metrics.latency_stats(D.table(spark, sf_dir, "events"), "value", ["event_type"])


@query
def latency_p95_ranked(spark, sf_dir):
    """The same figures by the rank search that large groups use."""
    events = D.table(spark, sf_dir, "events")
    found = ranks.exact_percentile(
        events, "value", 0.95, ["event_type"], "p95", single_task_rows=256
    )
    return found.select("event_type", F.round("p95", 2).alias("p95"))


@query
def cost_stats(spark, sf_dir):
    return metrics.cost_stats(D.scored(spark, sf_dir), "cost_usd", ["model_key"])


@query
def alignment_check(spark, sf_dir):
    return metrics.check_alignment(
        D.documents(spark, sf_dir), D.table(spark, sf_dir, "labels"), "doc_id"
    )


@query
def decision_disagreements(spark, sf_dir):
    _, obvious, cascade = (s.expression(F.col("content")) for s in D.SCORERS)
    rows = D.labelled(spark, sf_dir).select(
        "lang", obvious.alias("obvious"), cascade.alias("cascade")
    )
    return metrics.decision_disagreements(rows, "obvious", "cascade", ["lang"])


@query
def rescore(spark, sf_dir):
    """Two decision rules over the same stored answers."""
    rows = A.with_normalized(D.answers(spark, sf_dir), "raw").select(
        (F.col("n_chars") % 2 == 0).alias("truth"),
        F.col("normalized.contains_pii").alias("flag"),
        F.col("normalized.confidence").alias("confidence"),
    )
    rules = {"by_flag": F.col("flag"), "by_confidence": F.col("confidence") > 0.5}
    return metrics.rescore(rows, rules, "truth")


def _scored_samples(spark, sf_dir):
    samples = D.labelled(spark, sf_dir).select(
        "sample_id", "content", "ground_truth", F.lit("positive").alias("sample_type")
    )
    return scoring.score_all(samples, D.SCORERS)


@query
def run_metrics(spark, sf_dir):
    rows = _scored_samples(spark, sf_dir).drop("content")
    # A latency that differs from row to row, so that the percentile is one.
    timed = rows.withColumn("latency_ms", (F.col("sample_id") % 97) / 8)
    return metrics.run_metrics(materialize(timed, "scored"))


@query
def result_rows(spark, sf_dir):
    rows = metrics.result_rows(_scored_samples(spark, sf_dir))
    return rows.select(
        "sample_id", "model_key", "prediction", "prediction_bool", "ground_truth", "sample_type",
        "latency_ms", "cost_usd", md5(F.col("content")).alias("content_md5"),
    )


@query
def process_results(spark, sf_dir):
    outputs = D.answers(spark, sf_dir).select(F.col("doc_id").alias("sample_id"), "raw")
    samples = D.documents(spark, sf_dir).select(F.col("doc_id").alias("sample_id"), "lang")
    rows = metrics.process_results(outputs, samples)
    counted = metrics.confusion(rows, "prediction_bool", "ground_truth", ["lang"])
    return counted.select("lang", "tp", "fn", "unparseable", "total")


# --- comparison ---------------------------------------------------------------------------------

_TIMES = (datetime(2024, 5, 1, 8, 0, 0), datetime(2024, 5, 1, 8, 0, 5), datetime(2024, 5, 1, 8, 1, 0))


def _model_metrics(spark, sf_dir):
    counts = metrics.model_metrics(D.scored(spark, sf_dir)).drop("cost_usd_avg")
    known = F.when(F.col("model_key") == "email", "granite4:tiny").when(
        F.col("model_key") == "obvious", "rules/obvious"
    )
    return counts.withColumn("model_id", known)


@query
def comparison_table(spark, sf_dir):
    return compare.comparison(
        _model_metrics(spark, sf_dir), params={"rules/obvious": 0.5}
    )


@query
def leaderboard(spark, sf_dir):
    table = _model_metrics(spark, sf_dir)
    failed = spark.createDataFrame([("broken", "failed")], "model_key string, status string")
    board = compare.leaderboard(compare.history(table, failed))
    return compare.report(board, ["rank", "model_key", "status", "tpr", "fpr", "absent"])


@query
def select_models(spark, sf_dir):
    models = spark.createDataFrame(
        [("email", "rules/email"), ("obvious", "rules/shared"), ("cascade", "rules/shared")],
        "key string, model_id string",
    )
    rows = compare.select_models(
        D.scored(spark, sf_dir), models, ["rules/shared"]
    )
    return rows.select("sample_id", "model_key", "contains_pii")


@query
def run_history(spark, sf_dir):
    """Two runs appended to one stored table, then compared by run."""
    path = new_scratch_path(spark, "history")
    rows = materialize(D.scored(spark, sf_dir), "scored")
    for number, truth in enumerate(("ground_truth", None)):
        run = metrics.binary_metrics(rows, "contains_pii", truth, ["model_key"])
        started = _TIMES[0].replace(day=number + 1)
        stamped = metrics.with_run(run, started, _TIMES[1], _TIMES[2])
        if number:
            stamped = stamped.drop("accuracy")
        writers.write_comparison(stamped, path, append=True)
    return readers.read_history(spark, path).select(
        "run_id", "model_key", "tp", "fn", "accuracy", "recall", "execution_time_sec"
    )


class _Unavailable(scoring.PythonScorer):
    """A model that cannot be loaded."""

    key = "unavailable"
    model_id = "python/unavailable"

    def open(self) -> None:
        raise RuntimeError("no such model")


def _whole_run(spark, sf_dir):
    """A run of two rule scorers and one that fails, over every document."""
    docs = D.documents(spark, sf_dir).select("doc_id", "text")
    return benchmark.run_benchmark(
        docs, [*D.SCORERS[:2], _Unavailable()], new_scratch_path(spark, "run"), n=docs.count() or 1,
        include_negative=False, id_col="doc_id", content_col="text", started=_TIMES[0],
    )


@query
def benchmark_run(spark, sf_dir):
    """What a run stores: one row per model, the failed one included."""
    good, _bad = readers.read_metrics(spark, _whole_run(spark, sf_dir).metrics_path)
    return good.select("model_key", "provider", "status", "tp", "fn", "total", "tpr", "run_id")


@query
def benchmark_compare(spark, sf_dir):
    """The comparison of a run, from the folder it wrote."""
    board = benchmark.compare_stored(spark, _whole_run(spark, sf_dir).metrics_path)
    return board.select("model_id", "accuracy", "precision", "recall", "f1", "total", "unparseable")


@query
def provider_registry(spark, sf_dir):
    """Scorers made by their provider names."""
    registry = scoring.default_registry()
    made = [registry.create(name) for name in ("email", "obvious")]
    rows = scoring.score_all(D.labelled(spark, sf_dir).select("sample_id", "content"), made)
    return rows.groupBy("model_key", "provider").agg(
        F.count(F.lit(1)).alias("n"), count_true("contains_pii", "flagged")
    )


# --- sources and sinks ------------------------------------------------------------------------------


@query
def csv_texts(spark, sf_dir):
    """Texts written as CSV (quotes, line breaks) and read back."""
    path = new_scratch_path(spark, "texts")
    writers.write_texts(D.documents(spark, sf_dir), path, "text")
    back = readers.read_texts(spark, path, "text")
    return back.groupBy(md5(strip(F.col("text"))).alias("md5")).agg(F.count(F.lit(1)).alias("n"))


def _ordered_csv(spark, sf_dir):
    """All texts written as CSV in the order of language and id, and read back."""
    path = new_scratch_path(spark, "ordered")
    docs = D.documents(spark, sf_dir).select("doc_id", "lang", "text").orderBy("lang", "doc_id")
    writers.write_generated(docs, path, "csv")
    return readers.read_texts(spark, path, "text")


@query
def csv_row_positions(spark, sf_dir):
    """Rows of CSV files without ids are numbered in file order."""
    return _ordered_csv(spark, sf_dir).select(
        F.col("sample_id").alias("position"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        md5(strip(F.col("text"))).alias("md5"),
    )


@query
def first_rows_csv(spark, sf_dir):
    """An evaluation set of the first texts of CSV files, in file order."""
    texts = _ordered_csv(spark, sf_dir)
    built = evalset.build_eval_set(texts, SAMPLES, include_negative=False, content_col="text")
    return built.select("sample_id", md5(strip(F.col("content"))).alias("md5"), "ground_truth")


# Person records are written as JSON arrays of about so many bytes, one by each task.
ARRAY_BYTES = 32 << 20


@query
def people_json(spark, sf_dir):
    """Person records written as files that each hold one JSON array, and read back."""
    path = new_scratch_path(spark, "people")
    person = F.to_json(
        F.struct(
            F.concat(F.lit("p"), F.col("doc_id")).alias("name"),
            (F.col("n_chars") % 90).cast("int").alias("age"),
            F.col("doc_id").alias("idCardNumbers"),
            F.col("n_chars").alias("income"),
            F.col("text").alias("naturalParagraph"),
        )
    )
    docs = D.documents(spark, sf_dir)
    n_bytes = docs.agg(F.sum(F.octet_length(person).cast("long"))).first()[0] or 0
    parts = max(16, -(-n_bytes // ARRAY_BYTES))
    docs = docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    # An empty first element, so that every other one can follow a comma.
    edges = docs.select("part").distinct()
    lines = (
        docs.select("part", F.lit(1).alias("place"), F.concat(F.lit(","), person).alias("line"))
        .union(edges.select("part", F.lit(0), F.lit("[{}")))
        .union(edges.select("part", F.lit(2), F.lit("]")))
    )
    ordered = lines.repartition(parts, "part").sortWithinPartitions("part", "place")
    ordered.select("part", "line").write.partitionBy("part").text(path)
    people = readers.read_people(spark, path).where(F.col("name").isNotNull())
    return people.select(
        "name", "age", "idCardNumbers", "income", md5(F.col("naturalParagraph")).alias("md5")
    )


@query
def eval_set_from_csv(spark, sf_dir):
    """CSV files to an evaluation set: texts and non-PII texts get ids from the files."""
    positives, negatives = _sources(spark, sf_dir)
    texts, others = new_scratch_path(spark, "texts"), new_scratch_path(spark, "others")
    writers.write_texts(positives, texts, "text")
    writers.write_texts(negatives, others, "text")
    built = evalset.build_eval_set(
        readers.read_texts(spark, texts, "text"),
        SAMPLES,
        non_pii=readers.read_non_pii(spark, others, "text"),
        content_col="text",
    )
    return built.groupBy("sample_type", "ground_truth").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("ids")
    )


@query
def non_pii_source(spark, sf_dir):
    """Generated rows as CSV, read as a non-PII source: successful rows only."""
    path = new_scratch_path(spark, "generated")
    rows = generation.resolve_attempts(D.attempts(spark, sf_dir)).select(
        "id", "content", "generation_status"
    )
    writers.write_generated(rows, path, "csv")
    usable = readers.read_non_pii(spark, path, "content")
    return usable.groupBy(md5(strip(F.col("content"))).alias("md5")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def stored_results(spark, sf_dir):
    """Result rows of two models written by run and model, one model written again."""
    path = new_scratch_path(spark, "results")
    rows = metrics.with_run(D.scored(spark, sf_dir), _TIMES[0])
    writers.write_results(rows, path)
    writers.write_results(rows.where(F.col("model_key") == "email"), path)
    back = spark.read.parquet(path)
    return back.groupBy("run_id", "model_key").agg(
        F.count(F.lit(1)).alias("rows"), count_true("contains_pii", "flagged")
    )


@query
def stored_metrics(spark, sf_dir):
    """Metrics written as JSON lines and read back as a comparison table."""
    path = new_scratch_path(spark, "metrics")
    writers.write_metrics(_model_metrics(spark, sf_dir), path)
    good, _bad = readers.read_metrics(spark, path, "*.json", lines=True)
    return good.select("model_key", "f1", "total", "tpr")
