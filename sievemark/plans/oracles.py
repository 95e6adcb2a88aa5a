"""SQL that computes what each registered query must return.

Written independently of the operators: regexes without lookaround, CASE per answer
shape, window functions instead of rank searches, and so on.
"""

from __future__ import annotations

from sievemark.functions.answers import NO_PATTERNS, YES_PATTERNS
from sievemark.functions.flags import EMAIL, KEYWORDS
from sievemark.functions.guard import CATEGORIES
from sievemark.functions.text import WHITESPACE
from sievemark.operators import prompts
from sievemark.operators.evalset import SAFE_TEMPLATES
from sievemark.plans.queries import MODELS, OVERRIDES, PHRASES, SAMPLES


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def chars(text: str) -> str:
    """A string literal that spells unusual characters by code point."""
    return "(" + " || ".join(f"chr({ord(c)})" for c in text) + ")"


WS = chars(WHITESPACE)


def strip(e: str) -> str:
    return f"trim({e}, {WS})"


def email(e: str) -> str:
    return f"regexp_matches({e}, {q(EMAIL)})"


def alone(e: str, body: str) -> str:
    return f"regexp_matches({e}, '(^|[^0-9]){body}([^0-9]|$)')"


def mobile(e: str) -> str:
    return alone(e, "1[3-9][0-9]{9}")


def id_18(e: str) -> str:
    return alone(e, "[0-9]{17}[0-9Xx]")


def id_15(e: str) -> str:
    return alone(e, "[0-9]{15}")


def any_rule(e: str) -> str:
    return f"({email(e)} OR {mobile(e)} OR {id_18(e)} OR {id_15(e)})"


def keyword(e: str) -> str:
    return "(" + " OR ".join(f"contains(lower({e}), {q(k.lower())})" for k in KEYWORDS) + ")"


def obvious(e: str) -> str:
    return f"({e} = '' OR {any_rule(e)} OR {keyword(e)})"


IPV4 = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"


def wide(e: str) -> str:
    return f"({email(e)} OR regexp_matches({e}, '{IPV4}') OR {alone(e, '[0-9]{16}')})"


def free_text(e: str) -> str:
    head = strip(f"substring(lower({strip(e)}), 1, 80)")
    no = " OR ".join(f"regexp_matches(head, {q(p)}, 'i')" for p in NO_PATTERNS)
    yes = " OR ".join(f"regexp_matches(head, {q(p)}, 'i')" for p in YES_PATTERNS)
    return (
        f"(SELECT CASE WHEN {no} THEN false WHEN {yes} THEN true "
        f"WHEN starts_with(head, '是') THEN true WHEN starts_with(head, '否') THEN false END "
        f"FROM (SELECT {head} AS head))"
    )


def tokens(e: str) -> str:
    body = strip(e)
    return rf"CASE WHEN {body} = '' THEN [] ELSE string_split_regex({body}, '\s+') END"


def label(e: str) -> str:
    return f"CASE WHEN {e} THEN '是' WHEN NOT {e} THEN '否' ELSE '無法解析' END"


def template(e: str) -> str:
    choice = f"(('0x' || substr(md5({e}), 1, 8))::UBIGINT % {len(SAFE_TEMPLATES)}) + 1"
    return f"list_extract([{', '.join(q(t) for t in SAFE_TEMPLATES)}], ({choice})::INT)"


def seeded(e: str) -> str:
    return f"('0x' || substr(md5('42:' || {e}), 1, 15))::UBIGINT"


# --- evaluation sets ------------------------------------------------------------------

SOURCES = f"""
pos AS (SELECT doc_id, text FROM documents WHERE {obvious('text')}),
neg AS (SELECT doc_id, text FROM documents WHERE NOT {obvious('text')}),
pos_n AS (SELECT * FROM pos ORDER BY doc_id LIMIT {SAMPLES}),
neg_n AS (SELECT * FROM neg ORDER BY {seeded('doc_id')}, doc_id LIMIT {SAMPLES}),
fill AS (SELECT doc_id, {template('text')} AS text FROM
  (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn FROM pos)
  WHERE rn <= {SAMPLES} - (SELECT count(*) FROM neg_n)),
eval AS (
  SELECT doc_id * 3 AS sample_id, md5(text) AS md5, true AS ground_truth,
         'positive' AS sample_type FROM pos_n
  UNION ALL SELECT doc_id * 3 + 1, md5(text), false, 'negative' FROM neg_n
  UNION ALL SELECT doc_id * 3 + 2, md5(text), false, 'negative' FROM fill)
"""

ANSWERS = f"""
base AS (SELECT doc_id, n_chars, n_chars % 2 = 0 AS yes, doc_id % 8 AS shape,
  (doc_id % 101) / 100.0 AS conf, text,
  regexp_replace(text, '["\\\\{{}}\\x00-\\x1f]', ' ', 'g') AS safe FROM documents),
outcome AS (SELECT *,
  CASE WHEN shape IN (0, 1, 2, 3, 4, 7) THEN yes END AS flag,
  CASE shape WHEN 0 THEN conf WHEN 1 THEN conf WHEN 3 THEN conf WHEN 4 THEN 1.0
    WHEN 5 THEN 0.0 WHEN 7 THEN 1.0 END::DOUBLE AS confidence,
  CASE shape WHEN 2 THEN '' WHEN 6 THEN '' WHEN 4 THEN 'None' WHEN 7 THEN n_chars::VARCHAR
    ELSE {strip('safe')} END AS reason FROM base)
"""

# The answers that are no JSON object as a whole, and so are read as free text.
BODIES = f"""
{ANSWERS}, words AS (SELECT *, CASE WHEN yes THEN '是' ELSE '否' END AS lab,
  conf::DOUBLE::VARCHAR AS c FROM outcome),
bodies AS (SELECT *, CASE shape
  WHEN 1 THEN '```json' || chr(10) || '{{"label":"' || lab || '","confidence":"' || c
    || '","reason":"' || safe || '"}}' || chr(10) || '```'
  WHEN 3 THEN '{{' || chr(10) || '  "contains_pii": ' || yes::VARCHAR || ',' || chr(10)
    || '  "label": "' || lab || '",' || chr(10) || '  "confidence": ' || c || ',' || chr(10)
    || '  "reason": "' || safe
  WHEN 4 THEN safe || ' Answer: {{"has_pii": "' || CASE WHEN yes THEN 'YES' ELSE 'n' END
    || '", "confidence": 1.7, "reason": null}} I hope this helps.'
  WHEN 5 THEN '{{"verdict": 3, "confidence": NaN, "reason": "' || safe || '"}}'
  WHEN 6 THEN safe END AS body FROM words)
"""

ATTEMPTS = f"""
resolved AS (SELECT doc_id AS id, doc_id % 4 < 3 AND NOT {obvious(strip('text'))} AS ok,
  doc_id % 4 AS att, {strip('text')} AS body FROM documents)
"""

# --- scored documents ----------------------------------------------------------------------

SCORED = f"""
said AS (SELECT doc_id, lang, n_chars / 8.0 AS latency, n_chars / 1048576.0 AS cost,
  {wide('text')} AS truth, {email('text')} AS m_email, {obvious('text')} AS m_obvious,
  {free_text('text')} AS m_cascade FROM documents),
scored AS (
  SELECT doc_id, lang, latency, cost, truth, 'email' AS model_key, m_email AS pred FROM said
  UNION ALL SELECT doc_id, lang, latency, cost, truth, 'obvious', m_obvious FROM said
  UNION ALL SELECT doc_id, lang, latency, cost, truth, 'cascade', m_cascade FROM said)
"""


def counts(truth: str = "truth", null_as: str = "false") -> str:
    p = f"coalesce(pred, {null_as})"
    return f"""count(*) FILTER ({truth} AND {p}) AS tp, count(*) FILTER (NOT {truth} AND NOT {p}) AS tn,
      count(*) FILTER (NOT {truth} AND {p}) AS fp, count(*) FILTER ({truth} AND NOT {p}) AS fn,
      count(*) FILTER (pred IS NULL) AS unparseable, count(*) AS total"""


def div(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0.0)"


PRECISION, RECALL = div("tp", "tp + fp"), div("tp", "tp + fn")
RATES = f"""round({div('tp + tn', 'total')}, 4) AS accuracy, round({PRECISION}, 4) AS precision,
  round({RECALL}, 4) AS recall,
  round({div(f'2 * {PRECISION} * {RECALL}', f'{PRECISION} + {RECALL}')}, 4) AS f1"""
GUARD_RATES = f"round({RECALL}, 4) AS tpr, round({div('fp', 'fp + tn')}, 4) AS fpr"
MONEY = "round(sum(cost), 6) AS cost_usd_total, round(avg(cost), 6) AS cost_usd_avg"
LATENCY = """round(avg(latency), 2) AS overhead_latency_ms_avg,
  round(quantile_cont(latency, 0.95), 2) AS overhead_latency_ms_p95"""

BOARD = f"""
{SCORED}, counted AS (SELECT model_key, {counts()}, {LATENCY}, {MONEY}
  FROM scored GROUP BY model_key),
metrics AS (SELECT *, {RATES}, {GUARD_RATES} FROM counted)
"""

# --- tokens ------------------------------------------------------------------------------------

STEPS = f"""
steps AS (SELECT doc_id, lang, list_transform({tokens('text')}, lambda t: {email('t')}) AS hits
  FROM documents),
stops AS (SELECT doc_id, lang, hits, len(hits) AS total_tokens,
  CASE WHEN list_contains(hits, true) THEN list_position(hits, true) - 1 END::BIGINT
    AS trigger_index
  FROM steps),
stopped AS (SELECT *, coalesce(trigger_index + 1, total_tokens) AS processed_tokens,
  trigger_index IS NOT NULL AS early_stopped FROM stops)
"""

EVENT_STOPS = """
trig AS (SELECT user_id, min(event_id) FILTER (event_type = 'error') AS trigger_index
  FROM events GROUP BY user_id)
"""

USER_STEPS = """
steps AS (SELECT user_id AS sample_id, event_id, event_type = 'error' AS pii,
  event_id % 101 = 5 AS broke,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
"""

# Steps that came; up to the first gap a step's index is its place.
GAP_STEPS = f"""{USER_STEPS},
came AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY i) - 1 AS place
  FROM steps WHERE event_id % 50 <> 7),
ends AS (SELECT sample_id, count(*) FILTER (i = place) AS reached, max(i) AS top,
  min(i) FILTER (pii) AS hit FROM came GROUP BY sample_id),
stops AS (SELECT sample_id, top + 1 AS total_tokens, coalesce(hit < reached, false) AS early_stopped,
  CASE WHEN hit < reached THEN hit END AS trigger_index,
  CASE WHEN hit < reached THEN hit + 1 ELSE reached END AS processed_tokens,
  coalesce(hit, top) AS stop FROM ends)
"""

STEP_EVENTS = f"""WITH {USER_STEPS},
f AS (SELECT sample_id, min(i) FILTER (pii) AS hit, min(i) FILTER (broke) AS fault FROM steps GROUP BY 1)
SELECT sample_id, 'start_predict' AS event, NULL::BIGINT AS token_index, NULL::VARCHAR AS detail FROM f
UNION ALL SELECT sample_id, 'early_stop_triggered_by_pii_category', hit, NULL FROM f
  WHERE hit < coalesce(fault, hit + 1)
UNION ALL SELECT sample_id, CASE WHEN fault = 0 THEN 'fallback_to_full_sequence' ELSE 'token_step_failed' END,
  fault, 'step broke' FROM f WHERE fault <= coalesce(hit, fault)
"""

ORDERED_ROWS = f"""SELECT row_number() OVER (ORDER BY lang, doc_id) AS position, doc_id,
  md5({strip('text')}) AS md5 FROM documents"""

# --- prompts ---------------------------------------------------------------------------------------


def _prompt(prompt: str) -> str:
    before, after = prompt.split("{content}")
    plain = [p.replace("{{", "{").replace("}}", "}") for p in (before, after)]
    return f"{q(plain[0])} || text || {q(plain[1])}"


_RENDERED = " UNION ALL ".join(
    f"SELECT doc_id, {q(m)} AS model_id, {q(name)} AS task_id, "
    f"md5({q(OVERRIDES.get(m, prompts.SYSTEM_PROMPT))}) AS system_md5, "
    f"md5({_prompt(t)}) AS user_md5 FROM documents"
    for m in MODELS
    for name, t in prompts.TASKS.items()
)

_PHRASES = "text"
for _phrase in sorted(PHRASES, key=len, reverse=True):
    _PHRASES = f"replace({_PHRASES}, {q(_phrase)}, {q(PHRASES[_phrase])})"

_GUARD = """
texts AS (SELECT event_id, 'Safety: ' || CASE WHEN value > 50 THEN 'Unsafe' ELSE 'safe' END
  || chr(10) || 'Category: ' || CASE event_type WHEN 'error' THEN 'PII, Unethical Acts'
  WHEN 'click' THEN 'violent, Violent, None' WHEN 'view' THEN 'None' ELSE '' END
  || CASE WHEN user_id % 2 = 0 THEN chr(10) || 'Refusal: No' ELSE '' END AS t FROM events),
"""
_CATEGORY = "(" + "|".join(CATEGORIES) + ")"

_MODERATED_JSON = """'{"contains_pii": ' || flag || ', "label": "' || lab || '", "confidence": null, '
  || '"reason": "risk_level=' || risk || '; category=' || cat || '", "raw_text": "{'
  || replace(detail, '"', '\\"') || '}", ' || head || ', ' || tail || '}'"""

# Two rule scorers over every text, each taken to hold personal data.
WHOLE_RUN = f"""t AS (SELECT {strip('text')} AS c FROM documents),
    c AS (SELECT 'email' AS k, count(*) FILTER ({email('c')}) AS tp, count(*) AS total FROM t
      UNION ALL SELECT 'obvious', count(*) FILTER ({obvious('c')}), count(*) FROM t)"""


ORACLES: dict[str, str] = {
    "pii_flags_by_lang": f"""SELECT lang, count(*) AS docs,
        count(*) FILTER ({email('text')}) AS has_email, count(*) FILTER ({mobile('text')}) AS has_mobile_11,
        count(*) FILTER ({id_18('text')}) AS has_id_18, count(*) FILTER ({id_15('text')}) AS has_id_15,
        count(*) FILTER ({any_rule('text')}) AS regex_pii, count(*) FILTER ({keyword('text')}) AS keyword_pii,
        count(*) FILTER ({obvious('text')}) AS obvious_pii FROM documents GROUP BY lang""",
    "pii_spans": f"""WITH hits AS (
        SELECT doc_id, 'email' AS rule, regexp_extract_all(text, {q(EMAIL)}) AS h FROM documents
        UNION ALL SELECT doc_id, 'ipv4', regexp_extract_all(text, '{IPV4}') FROM documents
        UNION ALL SELECT doc_id, 'digits_16',
          list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) = 16) FROM documents)
        SELECT doc_id, rule, (unnest(range(len(h))))::INT AS pos, unnest(h) AS fragment
        FROM hits""",
    "clean_length": f"""SELECT doc_id,
        length({strip(f"({chars(' ' + chr(9) + chr(0x3000) + chr(0x85))} || text)")})::BIGINT
        AS clean_chars FROM documents""",
    "eval_set_rows": f"WITH {SOURCES} SELECT * FROM eval",
    "eval_set_counts": f"""WITH {SOURCES} SELECT sample_type, ground_truth, count(*) AS n
        FROM eval GROUP BY ALL""",
    "eval_set_redacted": f"""WITH first AS (SELECT * FROM documents ORDER BY doc_id LIMIT {SAMPLES})
        SELECT doc_id * 3 AS sample_id, md5(text) AS md5, true AS ground_truth,
          'positive' AS sample_type FROM first
        UNION ALL SELECT doc_id * 3 + 2, md5({template('text')}), false, 'negative' FROM first""",
    "eval_set_positive_only": f"""SELECT doc_id * 3 AS sample_id, md5(text) AS md5,
        true AS ground_truth, 'positive' AS sample_type
        FROM documents ORDER BY doc_id LIMIT {SAMPLES}""",
    "top_up": f"""WITH few AS (SELECT doc_id, text FROM documents WHERE {obvious('text')}
          ORDER BY {seeded('doc_id')}, doc_id LIMIT {2 * SAMPLES}),
        many AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS rn
          FROM documents WHERE NOT {obvious('text')})
        SELECT doc_id * 3 + 1 AS sample_id, md5(text) AS md5 FROM few
        UNION ALL SELECT doc_id * 3 + 2, md5({template('text')}) FROM many
          WHERE rn <= {2 * SAMPLES} - (SELECT count(*) FROM few)""",
    "sample_negatives": f"""SELECT doc_id, lang FROM documents
        ORDER BY {seeded('doc_id')}, doc_id LIMIT {SAMPLES}""",
    "redact_templates": f"SELECT doc_id, {template('text')} AS redacted FROM documents",
    "shuffled_order": f"""SELECT doc_id, row_number() OVER (ORDER BY {seeded('doc_id')}) AS position
        FROM documents""",
    "phrase_map": f"SELECT doc_id, md5({_PHRASES}) AS md5 FROM documents",
    "phrase_map_broadcast": f"SELECT doc_id, md5({_PHRASES}) AS md5 FROM documents",
    "resolve_attempts": f"""WITH {ATTEMPTS} SELECT id,
        md5(CASE WHEN ok THEN body ELSE '' END) AS content_md5,
        CASE WHEN ok THEN 'ok' ELSE 'failed' END AS generation_status,
        (CASE WHEN ok THEN att ELSE 2 END)::BIGINT AS retry_count FROM resolved""",
    "generation_summary": f"""WITH {ATTEMPTS}
        SELECT CASE WHEN ok THEN 'ok' ELSE 'failed' END AS generation_status, count(*) AS n,
        round(avg(CASE WHEN ok THEN att ELSE 2 END), 4) AS retries_avg FROM resolved GROUP BY 1""",
    "rewrite_rounds": f"""WITH r0 AS (SELECT doc_id, {strip('text')} AS t0 FROM documents),
        r1 AS (SELECT *, {strip(f"regexp_replace(t0, {q(EMAIL)}, '[mail]', 'g')")} AS t1 FROM r0),
        r2 AS (SELECT *, {strip("regexp_replace(t1, 'email', '[word]', 'gi')")} AS t2 FROM r1),
        r AS (SELECT doc_id, t0, t1, t2, CASE WHEN NOT {obvious('t0')} THEN 0
          WHEN NOT {obvious('t1')} THEN 1 WHEN NOT {obvious('t2')} THEN 2 END AS won FROM r2)
        SELECT doc_id, md5(CASE won WHEN 0 THEN t0 WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE '' END)
          AS content_md5, CASE WHEN won IS NULL THEN 'failed' ELSE 'ok' END AS generation_status,
          coalesce(won, 2)::BIGINT AS retry_count FROM r""",
    "generate_corpus": f"""WITH f AS (SELECT row_number() OVER (ORDER BY doc_id) AS id,
          {strip('text')} AS t0 FROM documents ORDER BY doc_id LIMIT {SAMPLES}),
        g AS (SELECT *, regexp_replace(t0, {q(EMAIL)}, '[mail]', 'g') AS t1 FROM f),
        h AS (SELECT *, regexp_replace(t1, 'email', '[word]', 'gi') AS t2 FROM g)
        SELECT id, md5(t0) AS source_md5,
          CASE WHEN {obvious('t0')} AND {obvious('t1')} AND {obvious('t2')} THEN 'failed'
            ELSE 'ok' END AS generation_status,
          (CASE WHEN NOT {obvious('t0')} THEN 0 WHEN NOT {obvious('t1')} THEN 1 ELSE 2 END)::BIGINT
            AS retry_count, 'python/masking' AS model_id FROM h""",
    "rewrite_requests": f"""SELECT doc_id, md5('system: ' || {q(prompts.REWRITE_SYSTEM)} || chr(10)
        || 'user: ' || CASE WHEN n_chars % 2 = 1 THEN {q(prompts.REWRITE_STRICT)}
        ELSE {q(prompts.REWRITE_NORMAL)} END || {q(prompts.REWRITE_REQUEST)} || text)
        AS request_md5 FROM documents""",
    "render_prompts": _RENDERED,
    "flatten_turns": """SELECT conv_id, count(*) AS turns,
        md5(string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10)
          ORDER BY turn, role, text)) AS chat_md5 FROM conversations GROUP BY conv_id""",
    "flatten_chat": f"""SELECT conv_id, turn, md5('system: ' || {q(prompts.SYSTEM_PROMPT)} || chr(10)
        || 'user: ' || text) AS chat_md5 FROM conversations""",
    "score_rules": f"""WITH t AS (SELECT doc_id, {strip('text')} AS text FROM documents),
        s AS (SELECT doc_id, 'email' AS model_key, {email('text')} AS contains_pii FROM t
          UNION ALL SELECT doc_id, 'obvious', {obvious('text')} FROM t
          UNION ALL SELECT doc_id, 'cascade', {free_text('text')} FROM t)
        SELECT doc_id, model_key, contains_pii,
          '{{"contains_pii": ' || coalesce(contains_pii::VARCHAR, 'null') || ', "label": "'
          || {label('contains_pii')} || '", "confidence": null, "reason": "", "raw_text": ""}}'
          AS output_json, 0.0::DOUBLE AS cost_usd FROM s""",
    "score_python": f"""WITH t AS (SELECT doc_id, {strip('text')} AS c FROM documents),
        s AS (SELECT doc_id, c, regexp_matches(c, '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}')
          AS refused, {email('c')} AS hit FROM t)
        SELECT doc_id, CASE WHEN NOT refused THEN hit END AS contains_pii,
          CASE WHEN refused THEN NULL WHEN hit THEN 0.9 ELSE 0.2 END::DOUBLE AS confidence,
          CASE WHEN refused THEN 'model_error: not allowed' ELSE '' END AS reason,
          (CASE WHEN refused THEN 0 ELSE length(c) END)::BIGINT AS prompt_tokens,
          (CASE WHEN refused THEN 0 ELSE 16 END)::BIGINT AS completion_tokens,
          CASE WHEN refused THEN 'not allowed' END AS error FROM s""",
    "score_all_totals": f"""WITH t AS (SELECT lang, {strip('text')} AS text FROM documents),
        a AS (SELECT *, regexp_matches(text, '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}')
          AS refused FROM t),
        s AS (SELECT 'email' AS model_key, lang, {email('text')} AS p, false AS e, 0 AS n FROM a
          UNION ALL SELECT 'obvious', lang, {obvious('text')}, false, 0 FROM a
          UNION ALL SELECT 'cascade', lang, {free_text('text')}, false, 0 FROM a
          UNION ALL SELECT 'address', lang, NOT refused AND {email('text')}, refused,
            CASE WHEN refused THEN 0 ELSE length(text) END FROM a)
        SELECT model_key, lang, count(*) AS "rows", count(*) FILTER (p) AS flagged, count(*) FILTER (e) AS errors,
          sum(n)::BIGINT AS prompt_tokens FROM s GROUP BY model_key, lang""",
    "cost_by_model": """WITH u AS (SELECT event_type AS model_id, floor(value)::BIGINT AS pt,
          CASE WHEN user_id % 2 = 0 THEN event_id % 50 END AS ct, event_id % 10 AS r,
          CASE event_type WHEN 'click' THEN 0.000125::DOUBLE WHEN 'view' THEN 0.00025::DOUBLE END AS pp,
          CASE event_type WHEN 'click' THEN 0.0005::DOUBLE WHEN 'view' THEN 0.001::DOUBLE END AS cp
          FROM events),
        c AS (SELECT *, CASE WHEN r = 0 THEN 0.25::DOUBLE
          ELSE coalesce(pt * pp + coalesce(ct, 0) * cp, 0.0::DOUBLE) END AS cost FROM u)
        SELECT model_id, count(*) AS calls, sum(pt)::BIGINT AS prompt_tokens_total,
          coalesce(sum(ct), 0)::BIGINT AS completion_tokens_total,
          round(sum(cost), 6) AS cost_usd_total, round(avg(cost), 6) AS cost_usd_avg
        FROM c GROUP BY model_id""",
    "token_totals": """SELECT event_type AS model_id,
        sum(floor(value)::BIGINT)::BIGINT AS prompt_tokens_total,
        coalesce(sum(CASE WHEN user_id % 2 = 0 THEN event_id % 50 END), 0)::BIGINT
        AS completion_tokens_total FROM events GROUP BY 1""",
    "truncated_tokens": f"""SELECT doc_id,
        md5(array_to_string(list_slice({tokens('text')}, 1, 64), ' ')) AS md5 FROM documents""",
    "normalize_outputs": f"""WITH {ANSWERS} SELECT doc_id, flag AS contains_pii,
        {label('flag')} AS label, confidence, md5(reason) AS reason_md5 FROM outcome""",
    "free_text_cascade": f"SELECT doc_id, {free_text('text')} AS decision FROM documents",
    "reread_outputs": f"""WITH {BODIES}, wrapped AS (SELECT *,
          '{{"contains_pii": null, "raw_text": "'
          || replace(replace(body, '"', '\\"'), chr(10), '\\n') AS outer_text FROM bodies)
        SELECT doc_id, CASE WHEN shape IN (0, 2, 7) THEN yes
          ELSE coalesce({free_text('body')}, {free_text('outer_text')}) END AS decision
        FROM wrapped""",
    "reread_deep": "SELECT doc_id, n_chars % 2 = 0 AS decision FROM documents",
    "truth_words": "SELECT doc_id, n_chars % 9 < 5 AS truth FROM documents",
    "people_json": """SELECT 'p' || doc_id AS name, (n_chars % 90)::INT AS age,
        doc_id::VARCHAR AS "idCardNumbers", n_chars AS income, md5(text) AS md5 FROM documents""",
    "eval_set_from_csv": f"""WITH f AS (SELECT {obvious("coalesce(text, '')")} AS found FROM documents),
        c AS (SELECT count(*) FILTER (found) AS p, count(*) FILTER (NOT found) AS n FROM f),
        s AS (SELECT least(p, {SAMPLES}) AS p, least({SAMPLES},
          least(n, {SAMPLES}) + least(p, {SAMPLES} - least(n, {SAMPLES}))) AS n FROM c)
        SELECT 'positive' AS sample_type, true AS ground_truth, p AS n, p AS ids FROM s
        UNION ALL SELECT 'negative', false, n, n FROM s""",
    "benchmark_run": f"""WITH {WHOLE_RUN} SELECT k AS model_key, 'rules' AS provider,
          NULL::VARCHAR AS status, tp, total - tp AS fn, total, round(tp / total, 4) AS tpr,
          '20240501T080000' AS run_id FROM c
        UNION ALL SELECT 'unavailable', 'python', 'failed', NULL, NULL, NULL, NULL, '20240501T080000'""",
    "benchmark_compare": f"""WITH {WHOLE_RUN} SELECT 'rules/' || k AS model_id,
          round(tp / total, 4) AS accuracy, CASE WHEN tp > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS precision,
          round(tp / total, 4) AS recall, round(2 * tp / (total + tp), 4) AS f1, total,
          0::BIGINT AS unparseable FROM c
        UNION ALL SELECT 'python/unavailable', NULL, NULL, NULL, NULL, NULL, NULL""",
    "provider_registry": f"""WITH {WHOLE_RUN} SELECT k AS model_key, 'rules' AS provider,
          total AS n, tp AS flagged FROM c""",
    "guard_text_parse": f"""WITH {_GUARD}
        cats AS (SELECT event_id, t, regexp_extract_all(t, {q(_CATEGORY)}, 1, 'i') AS c FROM texts),
        uniq AS (SELECT *, list_filter(c, lambda x, i: list_position(c, x) = i) AS u FROM cats)
        SELECT event_id, nullif(regexp_extract(t, 'Safety:\\s*(Safe|Unsafe|Controversial)', 1, 'i'), '')
          AS risk_level, array_to_string(u, '|') AS categories,
          nullif(regexp_extract(t, 'Refusal:\\s*(Yes|No)', 1, 'i'), '') AS refusal,
          list_contains(u, 'PII') AS has_pii FROM uniq""",
    "category_arrays": f"""WITH {STEPS} SELECT doc_id, trigger_index AS first_pii,
        CASE WHEN len(hits) = 0 THEN '' WHEN hits[-1] THEN 'PII' ELSE 'None' END AS last_category,
        CASE WHEN len(hits) = 0 THEN '' WHEN hits[least(3, len(hits))] THEN 'PII' ELSE 'None' END
          AS third_category, total_tokens AS tokens FROM stops""",
    "contract_check": f"""WITH {ANSWERS}, c AS (SELECT shape, yes, length(safe) <= 20 AS short
        FROM outcome) SELECT count(*) AS answers, count(*) FILTER (shape IN (0, 2, 5, 7)) AS is_object,
        count(*) FILTER (shape = 0) AS has_required, count(*) FILTER (shape = 0) AS no_extra,
        count(*) FILTER (shape = 0) AS flag_ok, count(*) FILTER (shape IN (0, 2)) AS label_ok,
        count(*) FILTER (shape = 0) AS confidence_ok, count(*) FILTER (shape IN (0, 5)) AS reason_ok,
        count(*) FILTER (shape = 0) AS label_agrees, count(*) FILTER (shape IN (0, 5) AND short) AS reason_short
        FROM c""",
    "early_stop_batch": f"""WITH {STEPS} SELECT doc_id, processed_tokens, total_tokens,
        trigger_index, early_stopped FROM stopped""",
    "early_stop_steps": f"""WITH {STEPS} SELECT doc_id, processed_tokens, total_tokens,
        trigger_index, early_stopped FROM stopped WHERE total_tokens > 0""",
    "processed_steps": f"""WITH {STEPS} SELECT doc_id, processed_tokens AS steps,
        processed_tokens - 1 AS last_index FROM stopped WHERE total_tokens > 0""",
    "early_stop_events": f"""WITH {EVENT_STOPS} SELECT e.user_id AS sample_id,
        count(*) AS processed_tokens, any_value(t.trigger_index) AS trigger_index,
        any_value(t.trigger_index) IS NOT NULL AS early_stopped
        FROM events e JOIN trig t USING (user_id)
        WHERE t.trigger_index IS NULL OR e.event_id <= t.trigger_index GROUP BY 1""",
    "early_stop_savings": f"""WITH {STEPS} SELECT lang, count(*) AS texts,
        count(*) FILTER (early_stopped) AS stopped, sum(processed_tokens)::BIGINT AS processed_tokens,
        sum(total_tokens)::BIGINT AS total_tokens,
        round({div('sum(processed_tokens)', 'sum(total_tokens)')}, 6) AS processed_share
        FROM stopped GROUP BY lang""",
    "moderate_arrays": f"""WITH {STEPS} SELECT doc_id, early_stopped, trigger_index,
        processed_tokens, CASE WHEN total_tokens = 0 THEN '' WHEN early_stopped THEN 'Unsafe'
          ELSE 'Safe' END AS risk_level,
        CASE WHEN total_tokens = 0 THEN '' WHEN early_stopped THEN 'PII' ELSE 'None' END AS category,
        CASE WHEN total_tokens > 0 THEN early_stopped END AS contains_pii,
        {label('CASE WHEN total_tokens > 0 THEN early_stopped END')} AS label,
        CASE WHEN total_tokens = 0 THEN '' WHEN early_stopped THEN 'risk_level=Unsafe; category=PII'
          ELSE 'risk_level=Safe; category=None' END AS reason FROM stopped""",
    "moderate_texts": f"""WITH {STEPS}, parts AS (SELECT *, early_stopped::VARCHAR AS flag,
          CASE WHEN early_stopped THEN '是' ELSE '否' END AS lab,
          CASE WHEN early_stopped THEN 'Unsafe' ELSE 'Safe' END AS risk,
          CASE WHEN early_stopped THEN 'PII' ELSE 'None' END AS cat FROM stopped),
        pieces AS (SELECT *, '"risk_level": "' || risk || '", "category": "' || cat
            || '", "refusal": null' AS head,
          '"stream_mode": "token_by_token", "early_stopped": ' || flag || ', "trigger_index": '
            || coalesce(trigger_index::VARCHAR, 'null') || ', "inferred_pii": false, '
            || '"inferred_trigger_index": null, "processed_tokens": ' || processed_tokens::VARCHAR
            || ', "total_tokens": ' || total_tokens::VARCHAR AS tail FROM parts),
        details AS (SELECT *, head || ', "text_output": "", ' || tail AS detail FROM pieces)
        SELECT doc_id, 'token_by_token' AS stream_mode, early_stopped, trigger_index,
          processed_tokens, total_tokens, false AS inferred_pii, early_stopped AS contains_pii,
          {_MODERATED_JSON} AS output_json FROM details""",
    "fallback_moderation": f"""WITH {STEPS}, s AS (SELECT s.*, {email('d.text')} AS whole
  FROM stops s JOIN documents d USING (doc_id))
SELECT doc_id, CASE WHEN lang = 'es' THEN 'full_sequence_fallback' ELSE 'token_by_token' END
  AS stream_mode,
  CASE WHEN lang = 'de' AND total_tokens >= 3 AND total_tokens < 100 THEN 'step broke' END
  AS step_error, CASE WHEN lang = 'es' THEN 1 ELSE total_tokens END AS steps,
  CASE WHEN lang <> 'es' THEN trigger_index WHEN whole THEN 0 END AS first_pii FROM s""",
    "fallback_stream": f"""WITH {USER_STEPS},
        u AS (SELECT sample_id, count(*) AS n, count(*) FILTER (pii) AS hits, min(i) FILTER (pii) AS hit,
            min(i) FILTER (broke) AS fault, arg_max(pii, i) AS final, sample_id % 3 = 0 OR min(i) FILTER (broke) = 0 AS whole
          FROM steps GROUP BY 1)
        SELECT sample_id, CASE WHEN coalesce(whole, false) THEN 'full_sequence_fallback' ELSE 'token_by_token' END AS stream_mode,
          CASE WHEN NOT coalesce(whole, false) AND fault IS NOT NULL THEN 'step broke' END AS step_error,
          CASE WHEN whole THEN 1 ELSE n END::BIGINT AS steps,
          CASE WHEN whole THEN CASE WHEN hits * 5 > n THEN 0 END ELSE hit END AS first_pii,
          CASE WHEN CASE WHEN whole THEN hits * 5 > n ELSE final END THEN 'PII' ELSE 'None' END AS last_category
        FROM u""",
    "phrase_stages": """SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(replace(
        text, 'tion', 'que'), 'ß', 'ss'), 'que', 'KE'), 's', 'z'), 'ier', 'ER'), 'KE', 'tion'), 'z', 's')) AS md5
        FROM documents""",
    "prompt_validation": f"""SELECT place::INTEGER AS place, task_id, task_id <> 'unheard-of' AS known,
          CASE WHEN task_id <> 'unheard-of' THEN (SELECT count(*) FROM documents) ELSE 0 END AS prompts
        FROM (SELECT unnest({[*reversed(prompts.TASKS), "unheard-of"]}) AS task_id,
          unnest(range({len(prompts.TASKS) + 1})) AS place)""",
    "moderate_empty": f"""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN hit END AS contains_pii,
          CASE WHEN doc_id % 3 = 2 THEN n ELSE 0 END::BIGINT AS total_tokens,
          CASE WHEN doc_id % 3 <> 2 THEN 'empty content' WHEN hit THEN 'risk_level=Unsafe; category=PII'
            ELSE 'risk_level=Safe; category=None' END AS reason,
          {label('CASE WHEN doc_id % 3 = 2 THEN hit END')} AS label
        FROM (SELECT doc_id, len({tokens('text')}) AS n,
            len(list_filter({tokens('text')}, lambda t: {email('t')})) > 0 AS hit FROM documents)""",
    "early_stop_sessions_gaps": f"""WITH {GAP_STEPS} SELECT s.sample_id, processed_tokens, total_tokens,
        trigger_index, early_stopped, false AS closed,
        stop + 1 - (SELECT count(*) FROM came c WHERE c.sample_id = s.sample_id AND c.i <= s.stop)
          AS missing_tokens FROM stops s""",
    "early_stop_contiguous": f"""WITH {GAP_STEPS} SELECT sample_id, processed_tokens, total_tokens,
        trigger_index, early_stopped FROM stops""",
    "early_stop_sessions_late": f"""WITH {USER_STEPS} SELECT sample_id,
        coalesce(min(i) FILTER (pii), max(i)) + 1 AS processed_tokens, max(i) + 1 AS total_tokens,
        min(i) FILTER (pii) AS trigger_index, count(*) FILTER (pii) > 0 AS early_stopped, true AS closed
        FROM steps GROUP BY sample_id""",
    "moderation_event_stream": STEP_EVENTS,
    "step_events": STEP_EVENTS,
    "csv_row_positions": ORDERED_ROWS,
    "first_rows_csv": f"""SELECT position * 3 AS sample_id, md5, true AS ground_truth FROM ({ORDERED_ROWS})
        WHERE position <= {SAMPLES}""",
    "score_batches": f"""WITH t AS (SELECT doc_id, {strip('text')} AS c FROM documents),
        s AS (SELECT doc_id, c, regexp_matches(c, '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}')
          AS refused, {email('c')} AS hit FROM t)
        SELECT doc_id, CASE WHEN NOT refused THEN hit END AS contains_pii,
          (CASE WHEN refused THEN 0 ELSE length(c) END)::BIGINT AS prompt_tokens,
          (CASE WHEN refused THEN 0 ELSE 16 END)::BIGINT AS completion_tokens,
          CASE WHEN refused THEN 0 ELSE length(c) / 1048576 END::DOUBLE AS cost_usd,
          CASE WHEN refused THEN 'not allowed' END AS error FROM s""",
    "score_all_errors": f"""WITH t AS (SELECT lang, {strip('text')} AS text FROM documents),
        a AS (SELECT *, regexp_matches(text, '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}')
          AS refused FROM t),
        s AS (SELECT 'email' AS model_key, lang, {email('text')} AS p, false AS e FROM a
          UNION ALL SELECT 'obvious', lang, {obvious('text')}, false FROM a
          UNION ALL SELECT 'unavailable', lang, NULL, true FROM a
          UNION ALL SELECT 'address', lang, NOT refused AND {email('text')}, refused FROM a)
        SELECT model_key, lang, count(*) AS "rows", count(*) FILTER (p) AS flagged, count(*) FILTER (e) AS errors,
          CASE WHEN model_key = 'unavailable' THEN 'model_error: RuntimeError: no such model' END AS reason
        FROM s GROUP BY model_key, lang""",
    "inferred_triggers": f"""WITH {STEPS} SELECT doc_id, lang = 'fr' AS early_stopped,
        lang <> 'fr' AND trigger_index IS NOT NULL AS inferred_pii,
        CASE WHEN lang <> 'fr' THEN trigger_index END AS inferred_trigger_index FROM stops""",
    "moderation_events": f"""WITH {STEPS} SELECT doc_id, 'start_predict' AS event,
          total_tokens AS token_index, NULL::VARCHAR AS detail FROM stopped
        UNION ALL SELECT doc_id, 'early_stop_triggered_by_pii_category', trigger_index, NULL
          FROM stopped WHERE early_stopped""",
    "early_stop_stream": f"""WITH {STEPS} SELECT doc_id, processed_tokens, total_tokens,
        trigger_index, early_stopped FROM stopped WHERE total_tokens > 0""",
    "early_stop_sessions": """SELECT user_id AS sample_id,
        min(event_id) FILTER (event_type = 'error') AS trigger_index,
        count(*) FILTER (event_type = 'error') > 0 AS early_stopped, max(event_id) + 1 AS total_tokens,
        coalesce(min(event_id) FILTER (event_type = 'error'), max(event_id)) + 1 AS processed_tokens,
        false AS closed FROM events GROUP BY user_id""",
    "early_stop_sessions_closed": """SELECT user_id AS sample_id,
        min(event_id) FILTER (event_type = 'error') AS trigger_index,
        count(*) FILTER (event_type = 'error') > 0 AS early_stopped, max(event_id) + 1 AS total_tokens,
        coalesce(min(event_id) FILTER (event_type = 'error'), max(event_id)) + 1 AS processed_tokens,
        true AS closed FROM events GROUP BY user_id""",
    "confusion_by_scorer": f"""WITH {SCORED} SELECT model_key, lang, {counts()}
        FROM scored GROUP BY model_key, lang""",
    "binary_metrics": f"""WITH {SCORED}, c AS (SELECT model_key, {counts()} FROM scored
        GROUP BY model_key) SELECT *, {RATES} FROM c""",
    "binary_metrics_unparseable_true": f"""WITH {SCORED}, c AS (SELECT model_key,
        {counts('true', 'true')} FROM scored GROUP BY model_key) SELECT *, {RATES} FROM c""",
    "guard_metrics": f"""WITH {SCORED}, c AS (SELECT model_key, lang, {counts()}, {LATENCY}, {MONEY}
        FROM scored GROUP BY model_key, lang) SELECT * EXCLUDE (total), {GUARD_RATES} FROM c""",
    "latency_p95": """SELECT event_type, round(avg(value), 2) AS overhead_latency_ms_avg,
        round(quantile_cont(value, 0.95), 2) AS overhead_latency_ms_p95
        FROM events GROUP BY event_type""",
    "latency_p95_ranked": """SELECT event_type, round(quantile_cont(value, 0.95), 2) AS p95
        FROM events GROUP BY event_type""",
    "cost_stats": f"WITH {SCORED} SELECT model_key, {MONEY} FROM scored GROUP BY model_key",
    "alignment_check": """WITH l AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1),
        r AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1)
        SELECT coalesce(sum(l.n), 0)::BIGINT AS left_rows, coalesce(sum(r.n), 0)::BIGINT AS right_rows,
          count(*) FILTER (l.n > 0 AND r.n > 0) AS matched_keys, count(*) FILTER (r.n IS NULL) AS left_only_keys,
          count(*) FILTER (l.n IS NULL) AS right_only_keys, count(*) FILTER (l.n > 1 OR r.n > 1) AS repeated_keys
        FROM l FULL JOIN r USING (doc_id)""",
    "decision_disagreements": f"""WITH {SCORED} SELECT lang, count(*) AS total,
        count(*) FILTER (m_obvious IS DISTINCT FROM m_cascade) AS disagreements,
        0::BIGINT AS left_only_null, count(*) FILTER (m_cascade IS NULL) AS right_only_null
        FROM said GROUP BY lang""",
    "rescore": f"""WITH {ANSWERS}, r AS (
          SELECT yes AS truth, 'by_flag' AS rule, flag AS pred FROM outcome
          UNION ALL SELECT yes, 'by_confidence', confidence > 0.5 FROM outcome),
        c AS (SELECT rule, {counts()} FROM r GROUP BY rule) SELECT *, {RATES} FROM c""",
    "run_metrics": f"""WITH t AS (SELECT {wide('text')} AS truth, {strip('text')} AS c,
          (doc_id % 97) / 8.0 AS ms FROM documents),
        s AS (SELECT truth, ms, 'email' AS k, {email('c')} AS pred FROM t
          UNION ALL SELECT truth, ms, 'obvious', {obvious('c')} FROM t
          UNION ALL SELECT truth, ms, 'cascade', {free_text('c')} FROM t),
        c AS (SELECT k, {counts()}, round(avg(ms), 2)::DOUBLE AS mean_ms,
          round(quantile_cont(ms::DOUBLE, 0.95), 2) AS p95_ms FROM s GROUP BY k)
        SELECT k AS model_key, 'rules/' || k AS model_id, 'rules' AS provider,
          0::BIGINT AS prompt_tokens_total, 0::BIGINT AS completion_tokens_total, {GUARD_RATES},
          tp, tn, fp, fn, unparseable, mean_ms AS overhead_latency_ms_avg,
          p95_ms AS overhead_latency_ms_p95, 0.0::DOUBLE AS cost_usd_total, 0.0::DOUBLE AS cost_usd_avg, {RATES}, total,
          0::BIGINT AS decision_disagreements FROM c""",
    "result_rows": f"""WITH t AS (SELECT doc_id, text, {wide('text')} AS truth, {strip('text')} AS c
          FROM documents),
        s AS (SELECT doc_id, text, truth, 'email' AS k, {email('c')} AS p FROM t
          UNION ALL SELECT doc_id, text, truth, 'obvious', {obvious('c')} FROM t
          UNION ALL SELECT doc_id, text, truth, 'cascade', {free_text('c')} FROM t)
        SELECT doc_id AS sample_id, k AS model_key, {label('p')} AS prediction,
          p AS prediction_bool, truth AS ground_truth, md5(text) AS content_md5,
          'positive' AS sample_type, NULL::DOUBLE AS latency_ms, 0.0::DOUBLE AS cost_usd FROM s""",
    "process_results": f"""WITH {BODIES}, p AS (SELECT d.lang,
          CASE WHEN shape IN (0, 2, 7) THEN yes ELSE {free_text('body')} END AS pred
          FROM bodies JOIN documents d USING (doc_id))
        SELECT lang, count(*) FILTER (pred) AS tp,
          count(*) FILTER (NOT coalesce(pred, false)) AS fn,
          count(*) FILTER (pred IS NULL) AS unparseable, count(*) AS total FROM p GROUP BY lang""",
    "comparison_table": f"""WITH {BOARD} SELECT
        CASE model_key WHEN 'email' THEN 'granite4:tiny' WHEN 'obvious' THEN 'rules/obvious'
          ELSE 'unknown' END AS model_id, accuracy, precision, recall, f1,
        NULL::DOUBLE AS execution_time_sec,
        CASE model_key WHEN 'email' THEN 7.0 WHEN 'obvious' THEN 0.5 END::DOUBLE AS model_params_b,
        total, unparseable FROM metrics""",
    "leaderboard": f"""WITH {BOARD}, rows_ AS (
          SELECT model_key, NULL::VARCHAR AS status, tpr, fpr, overhead_latency_ms_avg,
            cost_usd_total FROM metrics
          UNION ALL SELECT 'broken', 'failed', NULL, NULL, NULL, NULL)
        SELECT (row_number() OVER (ORDER BY tpr DESC NULLS LAST, fpr NULLS LAST,
            overhead_latency_ms_avg NULLS LAST, cost_usd_total NULLS LAST, model_key))::INT AS rank,
          model_key, status, tpr, fpr FROM rows_""",
    "select_models": f"""WITH {SCORED} SELECT doc_id AS sample_id, model_key, pred AS contains_pii
        FROM scored WHERE model_key IN ('obvious', 'cascade')""",
    "run_history": f"""WITH {SCORED},
        a AS (SELECT '20240501T080000' AS run_id, model_key, {counts()} FROM scored GROUP BY 2),
        b AS (SELECT '20240502T080000' AS run_id, model_key, {counts('true')} FROM scored GROUP BY 2)
        SELECT run_id, model_key, tp, fn, round({div('tp + tn', 'total')}, 4) AS accuracy,
          round({RECALL}, 4) AS recall, 55.0::DOUBLE AS execution_time_sec FROM a
        UNION ALL SELECT run_id, model_key, tp, fn, NULL, round({RECALL}, 4), 55.0 FROM b""",
    "csv_texts": f"SELECT md5({strip('text')}) AS md5, count(*) AS n FROM documents GROUP BY 1",
    "non_pii_source": f"""WITH {ATTEMPTS} SELECT md5(body) AS md5, count(*) AS n
        FROM resolved WHERE ok GROUP BY 1""",
    "stored_results": f"""WITH {SCORED} SELECT '20240501T080000' AS run_id, model_key,
        count(*) AS "rows", count(*) FILTER (pred) AS flagged FROM scored GROUP BY model_key""",
    "stored_metrics": f"WITH {BOARD} SELECT model_key, f1, total, tpr FROM metrics",
}

ORACLES["phrase_map_join"] = ORACLES["phrase_map"]
