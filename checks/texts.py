"""Checks of row texts, prompts and answer reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.inputs import table
from tabspark import spec
from tabspark.functions import text as X
from tabspark.functions.answers import label_mentions, normalize_text, parse_answer
from tabspark.plans.answers import answer_job
from tabspark.plans.serialize import serialize_table
from tabspark.sources.readers import load_serialized

QUERIES, SQL = {}, {}

FEATURES = ("seg", "nation", "level", "bal")


def fields(df):
    return [df.schema[c] for c in FEATURES]


def rendered(make):
    def query(s, d):
        df = I.attributes(s, d)
        return df.select("c_custkey", make(fields(df)).alias("text"))

    return query


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sentences_sql(cols) -> str:
    return " || ' ' || ".join(f"'The {c} is ' || coalesce(CAST({c} AS VARCHAR), 'unknown') || '.'" for c in cols)


def json_sql(numbers, order) -> str:
    parts = []
    for c in order:
        cell = f"CAST({c} AS VARCHAR)" if c in numbers else f"'\"' || {c} || '\"'"
        parts.append(f"'\"{c}\": ' || coalesce({cell}, '\"unknown\"')")
    return "'{' || " + " || ', ' || ".join(parts) + " || '}'"


def record_sql(cols) -> str:
    phrases = " || ', ' || ".join(f"'{c} ' || coalesce(CAST({c} AS VARCHAR), 'unknown')" for c in cols)
    return f"{quoted(spec.RECORD_LEAD)} || {phrases} || '.'"


JSON_SQL = json_sql({"nation", "level", "bal"}, FEATURES)

QUERIES["q_serialize_text"] = rendered(X.text_sentences)
SQL["q_serialize_text"] = f"WITH {I.ATTRIBUTES_SQL} SELECT c_custkey, {sentences_sql(FEATURES)} AS text FROM cu0"

QUERIES["q_serialize_json"] = rendered(X.text_json)
SQL["q_serialize_json"] = f"WITH {I.ATTRIBUTES_SQL} SELECT c_custkey, {JSON_SQL} AS text FROM cu0"

QUERIES["q_serialize_sentence"] = rendered(X.text_record)
SQL["q_serialize_sentence"] = f"WITH {I.ATTRIBUTES_SQL} SELECT c_custkey, {record_sql(FEATURES)} AS text FROM cu0"

QUERIES["q_rewrite_prompt"] = rendered(X.rewrite_prompt)
SQL["q_rewrite_prompt"] = f"""WITH {I.ATTRIBUTES_SQL}
SELECT c_custkey, {quoted(spec.REWRITE_HEAD)} || {JSON_SQL} || {quoted(spec.REWRITE_TAIL)} AS text FROM cu0"""

QUERIES["q_prompt"] = rendered(
    lambda f: X.class_prompt(X.text_sentences(f), I.CUSTOMER.task, I.CUSTOMER.choices, I.CUSTOMER.positive)
)
PROMPT_TAIL = spec.PROMPT_TAIL.format(
    task=I.CUSTOMER.task, positive="positive", negative="negative", positive_target="near", negative_target="far"
)


def prompt_sql(text: str) -> str:
    return f"{quoted(spec.PROMPT_HEAD)} || {text} || {quoted(PROMPT_TAIL)}"


SQL["q_prompt"] = f"WITH {I.ATTRIBUTES_SQL} SELECT c_custkey, {prompt_sql(sentences_sql(FEATURES))} AS text FROM cu0"


def json_documents(s, d):
    """Whole documents as JSON text: quotes, line breaks and letters beyond ASCII; compared by hash."""
    df = table(s, d, "documents").select("doc_id", "lang", "n_chars", "text")
    made = X.text_json([df.schema[c] for c in ("lang", "n_chars", "text")])
    return df.select("doc_id", F.md5(made).alias("hash"), F.length(made).cast("bigint").alias("size"))


# Per character: named escapes, printable ASCII as it is, anything else as UTF-16 code units.
ESCAPED_SQL = r"""CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r'
  WHEN c = chr(9) THEN '\t' WHEN c = chr(8) THEN '\b' WHEN c = chr(12) THEN '\f'
  WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 65536 THEN '\u' || lower(printf('%04x', unicode(c)))
  ELSE '\u' || printf('%04x', 55296 + ((unicode(c) - 65536) >> 10)) || '\u' || printf('%04x', 56320 + ((unicode(c) - 65536) & 1023))
  END"""
QUERIES["q_json_documents"] = json_documents
SQL["q_json_documents"] = f"""WITH e AS (SELECT doc_id, '{{"lang": "' || lang || '", "n_chars": ' || n_chars || ', "text": "' ||
  list_aggregate(list_transform(string_split(text, ''), lambda c: {ESCAPED_SQL}), 'string_agg', '') || '"}}' AS j FROM documents)
SELECT doc_id, md5(j) AS hash, CAST(length(j) AS BIGINT) AS size FROM e"""


def serialized(s, d):
    return serialize_table(I.split_customers(s, d), I.CUSTOMER, keep=("c_custkey", "split"))


_LEVEL = "CASE WHEN level IS NULL THEN 'unknown' WHEN level <= 0.5 THEN 'less' WHEN level <= 1.5 THEN 'typical' ELSE 'more' END"
_NATION = "CASE CAST(nation AS INTEGER) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in I.NATIONS.items()) + " ELSE 'unknown' END"
SERIALIZED_SQL = f"""{I.CUSTOMERS_SQL},
named AS (SELECT c_custkey, split, seg, {_NATION} AS nation, {_LEVEL} AS level, bal, target FROM cu),
se AS (SELECT c_custkey, split, {sentences_sql(FEATURES)} AS serialized_text,
    {json_sql({"bal"}, FEATURES)} AS serialized_json, {record_sql(FEATURES)} AS serialized_llm,
    CASE target WHEN 1 THEN 'near' ELSE 'far' END AS target_col FROM named)"""

QUERIES["q_serialize_all"] = serialized
SQL["q_serialize_all"] = f"WITH {SERIALIZED_SQL} SELECT * FROM se"


def serialized_head(s, d):
    return load_serialized(serialized(s, d), "json", "c_custkey", max_examples=20).select("c_custkey", "text")


QUERIES["q_serialized_head"] = serialized_head
SQL["q_serialized_head"] = f"""WITH {SERIALIZED_SQL}
SELECT c_custkey, serialized_json AS text FROM se WHERE split = 'test' ORDER BY c_custkey LIMIT 20"""


def rule_scorer_factory():
    """Answers by a rule over the prompt text, in place of a model."""

    def factory():
        def answer(frame):
            return {"output": ["Positive." if "The seg is BUILDING." in p else "negative" for p in frame["prompt"]]}

        return answer

    return factory


def answered(s, d):
    out = answer_job(serialized(s, d), I.CUSTOMER, "text_template", "rule", rule_scorer_factory(), "c_custkey", batch_size=64)
    return out.select("c_custkey", "dataset", "serialization", "model", "target_col", "output", F.md5("prompt").alias("prompt_hash"))


QUERIES["q_answer_job"] = answered
SQL["q_answer_job"] = f"""WITH {SERIALIZED_SQL} SELECT c_custkey, 'customer' AS dataset, 'text_template' AS serialization,
  'rule' AS model, target_col,
  CASE WHEN contains(serialized_text, 'The seg is BUILDING.') THEN 'Positive.' ELSE 'negative' END AS output,
  md5({prompt_sql("serialized_text")}) AS prompt_hash FROM se WHERE split = 'test'"""

# --- reading answers ---------------------------------------------------------
QUERIES["q_normalize_text"] = lambda s, d: table(s, d, "documents").select(
    "doc_id", F.md5(normalize_text(F.col("text"))).alias("hash")
)
SQL["q_normalize_text"] = """SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))) AS hash
FROM documents"""


def mentions(s, d):
    found = I.answers(s, d).select(
        "doc_id", "model", "serialization", label_mentions(F.col("output"), spec.ANSWER_LABELS).alias("m")
    )
    return found.select(
        "doc_id", "model", "serialization", F.size("m").alias("n"),
        F.try_element_at("m", F.lit(1))["label"].alias("first_label"),
        F.try_element_at("m", F.lit(-1))["end"].alias("last_end"),
    )


QUERIES["q_label_mentions"] = mentions
SQL["q_label_mentions"] = f"""WITH {I.ANSWERS_SQL},
w AS (SELECT doc_id, model, serialization, string_split(trim(t), ' ') AS words FROM norm),
h AS (SELECT doc_id, model, serialization, words, list_filter(range(1, len(words) + 1),
    lambda i: words[i] IN ('positive', 'negative')) AS hits FROM w)
SELECT doc_id, model, serialization, CAST(len(hits) AS INTEGER) AS n, words[hits[1]] AS first_label,
  CASE WHEN len(hits) > 0 THEN CAST(length(array_to_string(words[1:hits[-1]], ' ')) AS INTEGER) END AS last_end FROM h"""


def parsed(s, d):
    answer = parse_answer(F.col("output"), spec.ANSWER_LABELS)
    return I.answers(s, d).select("doc_id", "model", "serialization", answer.alias("a")).select(
        "doc_id", "model", "serialization", "a.label", "a.status"
    )


QUERIES["q_parse_answers"] = parsed
SQL["q_parse_answers"] = f"""WITH {I.ANSWERS_SQL}
SELECT doc_id, model, serialization, parsed_prediction AS label, parse_status AS status FROM ev"""


def custom_texts(s, d):
    """A style rendered by the caller's own function of the feature fields."""

    def listed(features):
        return F.concat_ws("; ", *[F.concat(F.lit(f"{f.name}="), F.coalesce(F.col(f.name).cast("string"), F.lit("?"))) for f in features if f.name != "bal"])

    out = serialize_table(I.split_customers(s, d), I.CUSTOMER, styles=("llm",), keep=("c_custkey", "split"), custom={"llm": listed})
    return out.select("c_custkey", "split", "serialized_llm", "target_col")


QUERIES["q_custom_texts"] = custom_texts
SQL["q_custom_texts"] = f"""WITH {SERIALIZED_SQL} SELECT c_custkey, split,
  'seg=' || coalesce(seg, '?') || '; nation=' || nation || '; level=' || level AS serialized_llm, CASE target WHEN 1 THEN 'near' ELSE 'far' END AS target_col FROM named"""
