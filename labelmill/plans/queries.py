"""One query per operator over the given tables, and the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.functions.cells import canonical_str
from labelmill.functions.conform import conform_fields
from labelmill.functions.constraints import violations
from labelmill.functions.identity import decode_request_id, encode_request_id
from labelmill.functions.tokens import token_estimate
from labelmill.operators import batches as B
from labelmill.operators import cost as C
from labelmill.operators import ids as I
from labelmill.operators import merge as M
from labelmill.operators import preflight as P
from labelmill.operators import requests as Q
from labelmill.operators import responses as R
from labelmill.operators.row_store import open_rows, store_rows
from labelmill.plans.labeler import Labeler
from labelmill.plans.tables import (
    DOCUMENT_SPEC, EVENT_SPEC, QUALITY_SPEC, SYSTEM, document_responses, quality_responses, response_line, table,
)
from labelmill.session import shared_dir
from labelmill.sources import delimited as D
from labelmill.sources import records as S
from labelmill.sources.prices import MODEL_PRICES, price_table
from labelmill.spec import LabelSpec, OutputField
from labelmill.streaming import ingest as T
from labelmill.streaming import progress as G
from labelmill.streaming.rounds import ROUND, STREAM, add_round, compact, current, history

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that states its result."""
    def register(fn: Query) -> Query:
        name = fn.__name__.rstrip("_")
        QUERIES[name], ORACLES[name] = fn, oracle
        return fn

    return register


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _document_rows(spark: SparkSession, folder: str) -> DataFrame:
    return I.id_from_column(_documents(spark, folder), "doc_id")


def _parsed(spark: SparkSession, folder: str, mode: str = "strict") -> DataFrame:
    return R.parse_responses(document_responses(_documents(spark, folder)), DOCUMENT_SPEC, mode)


def _quality_answers(spark: SparkSession, folder: str) -> DataFrame:
    return R.answers(R.parse_responses(quality_responses(spark, folder), QUALITY_SPEC), QUALITY_SPEC)


_PROMPT = "'Lang: ' || lang || chr(10) || 'Source: ' || source || chr(10) || 'Text: ' || text"
_TOKENS = f"greatest(1, length({_PROMPT}) // 4)"

# --- whole jobs ---------------------------------------------------------------------------------------------------------------


@query(f"""
    SELECT CAST(d.doc_id AS VARCHAR) AS row_id, d.lang, {_TOKENS.replace('lang', 'd.lang').replace('source', 'd.source').replace('text', 'd.text')} AS prompt_tokens,
           CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def label_rows(spark: SparkSession, folder: str) -> DataFrame:
    job = Labeler(QUALITY_SPEC)
    rows = job.number(_documents(spark, folder))
    rows = rows.withColumn("prompt_tokens", C.prompt_tokens(rows, QUALITY_SPEC))
    merged = job.collect(rows, quality_responses(spark, folder)).merged()
    return merged.select(F.col("_row_id").alias("row_id"), "lang", "prompt_tokens", "quality", "toxic")


def count_prompt_chars(docs: list[dict]) -> list[dict]:
    """A responder: counts the characters of each prompt."""
    return [{"chars": len(d["params"]["messages"][1]["content"])} for d in docs]


CHARS_SPEC = LabelSpec(system=SYSTEM, template=DOCUMENT_SPEC.template, fields=(OutputField("chars", "integer", "Length"),), id_column="doc_id")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS row_id, CAST(length({_PROMPT}) AS BIGINT) AS chars FROM documents")
def infer_rows(spark: SparkSession, folder: str) -> DataFrame:
    requests = Q.build_requests(_document_rows(spark, folder), CHARS_SPEC)
    parsed = R.parse_responses(Q.infer(requests, count_prompt_chars), CHARS_SPEC)
    return R.answers(parsed, CHARS_SPEC).select(F.col("_row_id").alias("row_id"), "chars")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS row_id, lang, CAST(length({_PROMPT}) AS BIGINT) AS chars FROM documents")
def label_with_responder(spark: SparkSession, folder: str) -> DataFrame:
    done = Labeler(CHARS_SPEC).label(_documents(spark, folder), count_prompt_chars)
    return done.merged().select(F.col("_row_id").alias("row_id"), "lang", "chars")


def failing_by_id(number: int):
    """The responder of a round: every fifth document gets an answer that does not fit, others fail in as many rounds as their id says modulo four."""
    def answer(docs: list[dict]) -> list:
        ids = [int(d["custom_id"].removeprefix("row_")) for d in docs]
        return [{"chars": "many"} if i % 5 == 0 else RuntimeError("Overloaded") if i % 4 > number else a for i, a in zip(ids, count_prompt_chars(docs), strict=True)]

    return answer


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS row_id, CASE WHEN doc_id % 5 > 0 AND doc_id % 4 < 3 THEN CAST(length({_PROMPT}) AS BIGINT) END AS chars,
    CASE WHEN doc_id % 5 = 0 THEN 1 ELSE least(doc_id % 4 + 1, 3) END AS attempts, CASE WHEN doc_id % 5 = 0 THEN 'misfit' WHEN doc_id % 4 = 3 THEN 'service' END AS kind FROM documents""")
def label_rounds(spark: SparkSession, folder: str) -> DataFrame:
    done = Labeler(CHARS_SPEC).label_rounds(_documents(spark, folder), failing_by_id, limits={"service": 3, "misfit": 1})
    tried = done.attempts.groupBy("_row_id").agg(F.count("*").alias("attempts"), F.max_by("kind", "round").alias("kind"))
    return done.merged().join(tried, "_row_id", "left").select(F.col("_row_id").alias("row_id"), "chars", "attempts", "kind")


# --- ids and batches ----------------------------------------------------------------------------------------------------------


@query("SELECT CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR) AS row_id, row_number() OVER (ORDER BY doc_id) AS row_no, doc_id FROM documents")
def assign_ids(spark: SparkSession, folder: str) -> DataFrame:
    numbered = I.assign_ids(_documents(spark, folder).select("doc_id", "text"), order_by=["doc_id"])
    return numbered.select(F.col("_row_id").alias("row_id"), F.col("_row_no").alias("row_no"), "doc_id")


@query("""SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_no, conv_id, turn, role FROM conversations""")
def assign_ids_from_zero(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role")
    numbered = I.assign_ids(rows, order_by=["conv_id", "turn"], offset=0)
    return numbered.select(F.col("_row_no").alias("row_no"), "conv_id", "turn", "role")


@query("SELECT min(rn) AS first_no, max(rn) AS last_no, count(*) AS n, count(DISTINCT rn) AS n_distinct FROM (SELECT row_number() OVER () AS rn FROM orders)")
def assign_ids_unordered(spark: SparkSession, folder: str) -> DataFrame:
    numbered = I.assign_ids(table(spark, folder, "orders").select("o_orderkey"))
    return numbered.agg(F.min("_row_no").alias("first_no"), F.max("_row_no").alias("last_no"), F.count("*").alias("n"), F.count_distinct("_row_no").alias("n_distinct"))


@query("SELECT min(rn) AS first_no, max(rn) AS last_no, count(*) AS n, count(DISTINCT rn) AS n_distinct FROM (SELECT row_number() OVER () AS rn FROM lineitem)")
def number_files(spark: SparkSession, folder: str) -> DataFrame:
    numbered = I.number_files(spark, f"{folder}/lineitem.parquet")
    return numbered.agg(F.min("_row_no").alias("first_no"), F.max("_row_no").alias("last_no"), F.count("*").alias("n"), F.count_distinct("_row_no").alias("n_distinct"))


@query("SELECT CAST(doc_id AS VARCHAR) AS row_id, doc_id, lang FROM documents")
def id_from_column(spark: SparkSession, folder: str) -> DataFrame:
    return _document_rows(spark, folder).select(F.col("_row_id").alias("row_id"), "doc_id", "lang")


@query("SELECT doc_id, 'row_' || source || '_row_' || doc_id AS request_id, source || '_row_' || doc_id AS row_id FROM documents")
def id_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    row_id = F.concat(F.col("source"), F.lit("_row_"), F.col("doc_id").cast("string"))
    coded = _documents(spark, folder).select("doc_id", encode_request_id(row_id).alias("request_id"))
    return coded.withColumn("row_id", decode_request_id(F.col("request_id")))


@query("""SELECT (rn - 1) // 250 AS batch_no, count(*) AS n, min(rn) AS first_no, max(rn) AS last_no
          FROM (SELECT row_number() OVER (ORDER BY doc_id) AS rn FROM documents) GROUP BY 1""")
def batch_assign(spark: SparkSession, folder: str) -> DataFrame:
    rows = I.assign_batches(I.assign_ids(_documents(spark, folder).select("doc_id"), order_by=["doc_id"]), 250)
    return rows.groupBy("batch_no").agg(F.count("*").alias("n"), F.min("_row_no").alias("first_no"), F.max("_row_no").alias("last_no"))


# --- prompts and requests -----------------------------------------------------------------------------------------------------


@query("SELECT CAST(doc_id AS VARCHAR) AS row_id, lang, source FROM documents")
def project_columns(spark: SparkSession, folder: str) -> DataFrame:
    return Q.project_columns(_document_rows(spark, folder), ["lang", "source"], keep=["_row_id"]).withColumnRenamed("_row_id", "row_id")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS key_text, CAST(o_totalprice AS VARCHAR) AS price_text,
                 strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS date_text, CASE WHEN o_totalprice > 200000 THEN 'True' ELSE 'False' END AS flag_text
          FROM orders""")
def canonical_cells(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders").withColumn("flag", F.col("o_totalprice") > 200000)
    types = {f.name: f.dataType for f in df.schema.fields}
    names = {"o_orderkey": "key_text", "o_totalprice": "price_text", "o_orderdate": "date_text", "flag": "flag_text"}
    return df.select(*[canonical_str(F.col(c), types[c]).alias(n) for c, n in names.items()])


@query("""SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'None') AS quality_text, coalesce(CAST(l.toxic AS VARCHAR), '') AS toxic_text
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def canonical_nulls(spark: SparkSession, folder: str) -> DataFrame:
    df = _documents(spark, folder).select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select("doc_id", canonical_str(F.col("quality"), types["quality"]).alias("quality_text"),
                     canonical_str(F.col("toxic"), types["toxic"], null_text="").alias("toxic_text"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS row_id, 'row_' || doc_id AS custom_id, {_PROMPT} AS prompt FROM documents")
def render_prompts(spark: SparkSession, folder: str) -> DataFrame:
    requests = Q.build_requests(_document_rows(spark, folder), DOCUMENT_SPEC)
    return requests.select(F.col("_row_id").alias("row_id"), "custom_id", "prompt")


@query(f"SELECT doc_id, CAST({_TOKENS} AS BIGINT) AS tokens FROM documents")
def token_estimate_(spark: SparkSession, folder: str) -> DataFrame:
    df = _documents(spark, folder)
    return df.select("doc_id", C.prompt_tokens(df, DOCUMENT_SPEC).alias("tokens"))


@query("SELECT sum(greatest(1, length(text) // 4))::BIGINT AS tokens FROM documents")
def token_sum(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).agg(F.sum(token_estimate(F.col("text"))).alias("tokens"))


def _request_parts(requests: DataFrame) -> DataFrame:
    doc = F.try_parse_json("request")
    def part(path: str, kind: str = "string"):
        return F.try_variant_get(F.col("doc"), path, kind)

    return requests.select(doc.alias("doc")).select(
        part("$.custom_id").alias("custom_id"), part("$.params.model").alias("model"), part("$.params.max_tokens", "bigint").alias("max_tokens"),
        part("$.params.messages[0].content[0].text").alias("system"), part("$.params.messages[0].content[0].cache_control.type").alias("cache"),
        part("$.params.messages[1].role").alias("role"), part("$.params.messages[1].content").alias("prompt"),
        part("$.params.output_format.schema.properties.chars.type").alias("chars_type"),
        part("$.params.output_format.schema.required[3]").alias("last_field"),
    )


_REQUEST_SQL = f"""SELECT 'row_' || doc_id AS custom_id, 'claude-sonnet-4-5' AS model, CAST(4096 AS BIGINT) AS max_tokens, '{SYSTEM}' AS system,
    'ephemeral' AS cache, 'user' AS role, {_PROMPT} AS prompt, 'integer' AS chars_type, 'ratio' AS last_field FROM documents"""


@query(_REQUEST_SQL)
def build_requests(spark: SparkSession, folder: str) -> DataFrame:
    return _request_parts(Q.build_requests(_document_rows(spark, folder), DOCUMENT_SPEC))


@query(f"""SELECT 'row_' || rn AS custom_id, (rn - 1) // 250 AS batch_no, prompt, 'claude-sonnet-4-5' AS model
           FROM (SELECT row_number() OVER (ORDER BY doc_id) AS rn, {_PROMPT} AS prompt FROM documents)""")
def requests_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    job = Labeler(DOCUMENT_SPEC.replace(id_column=None))
    path = shared_dir(spark, "requests")
    job.prepare(job.number(_documents(spark, folder), order_by=["doc_id"]), path)
    return S.read_requests(spark, path).select("custom_id", F.col("batch_no").cast("bigint").alias("batch_no"), "prompt", "model")


# --- responses ----------------------------------------------------------------------------------------------------------------

_RATIO = "n_chars / 8.0"
_PARSED_SQL = f"""SELECT CAST(doc_id AS VARCHAR) AS row_id,
    CASE WHEN doc_id % 16 < 8 THEN lang END AS lang_label, CASE WHEN doc_id % 16 < 8 THEN n_chars END AS chars,
    CASE WHEN doc_id % 16 < 8 THEN n_chars > 1000 END AS is_long, CASE WHEN doc_id % 16 < 8 THEN CAST({_RATIO} AS DOUBLE) END AS ratio,
    CASE doc_id % 16 WHEN 8 THEN 'No result in response' WHEN 9 THEN 'Overloaded at ' || doc_id WHEN 10 THEN 'No message in result'
        WHEN 11 THEN 'Empty content in message' WHEN 12 THEN 'Failed to parse JSON' WHEN 13 THEN 'Answer is not a JSON object'
        WHEN 14 THEN 'Field chars: not an integer; Field ratio: missing' WHEN 15 THEN 'Unknown error' END AS error
    FROM documents"""
_PARSED_COLUMNS = ["lang_label", "chars", "is_long", "ratio", "error"]


@query(_PARSED_SQL)
def parse_responses(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).select(F.col("_row_id").alias("row_id"), *_PARSED_COLUMNS)


@query("""SELECT CAST(doc_id AS VARCHAR) AS row_id, CASE WHEN doc_id % 16 IN (0,1,2,3,4,5,6,7,14) THEN lang END AS lang_label,
    CASE WHEN doc_id % 16 < 8 THEN n_chars END AS chars, doc_id % 16 IN (0,1,2,3,4,5,6,7,14) AS is_good FROM documents""")
def parse_loose(spark: SparkSession, folder: str) -> DataFrame:
    parsed = _parsed(spark, folder, mode="loose")
    return parsed.select(F.col("_row_id").alias("row_id"), "lang_label", "chars", F.col("error").isNull().alias("is_good"))


@query("""SELECT 'row_' || doc_id AS custom_id, doc_id % 16 = 14 AS has_extra, CASE WHEN doc_id % 16 = 14 THEN 'many' WHEN doc_id % 16 < 8 THEN CAST(n_chars AS VARCHAR) END AS chars_text
    FROM documents WHERE doc_id % 16 < 8 OR doc_id % 16 = 14""")
def loose_extra(spark: SparkSession, folder: str) -> DataFrame:
    narrow = DOCUMENT_SPEC.replace(fields=tuple(f for f in DOCUMENT_SPEC.fields if f.name != "chars"))
    parsed = R.parse_responses(document_responses(_documents(spark, folder)), narrow, mode="loose")
    kept = R.answers(parsed.withColumn("request_id", F.col("custom_id")), narrow)
    chars = F.try_variant_get("_extra", "$.chars", "string")
    return kept.select(F.col("request_id").alias("custom_id"), chars.isin("many").alias("has_extra"), chars.alias("chars_text"))


@query(f"SELECT row_id, 'row_' || row_id AS custom_id, error, CASE WHEN error = 'Failed to parse JSON' THEN 'language is ' || lang END AS content FROM ({_PARSED_SQL.replace('FROM documents', ', lang FROM documents')}) WHERE error IS NOT NULL")
def error_rows(spark: SparkSession, folder: str) -> DataFrame:
    errors = R.error_rows(_parsed(spark, folder))
    path = shared_dir(spark, "errors")
    S.write_errors(errors, path)
    return S.read_errors(spark, path).select(F.col("_row_id").alias("row_id"), "custom_id", "error", "content")


@query("""SELECT count(*) FILTER (WHERE good) AS success_count, count(*) FILTER (WHERE NOT good) AS error_count, count(*) AS total,
    round(count(*) FILTER (WHERE good) / count(*) * 100, 6) AS success_pct, round(count(*) FILTER (WHERE NOT good) / count(*) * 100, 6) AS error_pct
    FROM (SELECT doc_id % 16 < 8 AS good FROM documents)""")
def results_summary(spark: SparkSession, folder: str) -> DataFrame:
    s = R.results_summary(_parsed(spark, folder))
    return s.select("success_count", "error_count", "total", F.round("success_pct", 6).alias("success_pct"), F.round("error_pct", 6).alias("error_pct"))


@query(f"SELECT row_id, chars, row_number() OVER (ORDER BY CAST(row_id AS BIGINT)) AS place FROM ({_PARSED_SQL}) WHERE error IS NULL")
def results_ordered(spark: SparkSession, folder: str) -> DataFrame:
    ordered = M.results_ordered(R.answers(_parsed(spark, folder), DOCUMENT_SPEC))
    # The order shows as the place that numbering the sorted rows gives.
    placed = I.assign_ids(ordered.withColumnRenamed("_row_id", "row_id"), row_no="place")
    return placed.select("row_id", "chars", "place")


@query("""SELECT event_id, CASE WHEN event_id % 5 < 3 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
    CASE event_id % 5 WHEN 3 THEN 'Field k: not an integer' WHEN 4 THEN 'Field k: missing' END AS reason FROM events""")
def conform_strict(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    way = F.col("event_id") % 5
    text = (
        F.when(way == 0, F.col("props"))
        .when(way == 1, F.concat(F.lit('{"k": " +'), k, F.lit('.00 "}')))
        .when(way == 2, F.concat(F.lit('{"k": '), k, F.lit(".0}")))
        .when(way == 3, F.concat(F.lit('{"k": '), k, F.lit(".5}")))
        .otherwise(F.concat(F.lit('{"K": '), k, F.lit("}")))
    )
    docs = table(spark, folder, "events").select("event_id", F.try_parse_json(text).alias("doc"))
    typed = conform_fields(docs, F.col("doc"), "$", EVENT_SPEC.fields, "reason")
    return typed.select("event_id", "k", "reason")


NESTED_SPEC = (
    OutputField("order", "object", fields=(OutputField("status", "string"), OutputField("price", "number"))),
    OutputField("keys", "array", items=OutputField("item", "integer")),
)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS price,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + o_custkey END AS key_sum,
    CASE o_orderkey % 3 WHEN 1 THEN 'Field keys: [1] not an integer' WHEN 2 THEN 'Field order: Field price: missing' END AS error
    FROM orders""")
def conform_nested(spark: SparkSession, folder: str) -> DataFrame:
    way = F.col("o_orderkey") % 3
    order = F.struct(F.col("o_orderstatus").alias("status"), F.when(way != 2, F.col("o_totalprice")).alias("price"))
    keys = F.array(F.col("o_orderkey").cast("string"), F.when(way == 1, "x").otherwise(F.col("o_custkey").cast("string")))
    line = response_line(encode_request_id(F.col("o_orderkey")), F.to_json(F.struct(order.alias("order"), keys.alias("keys"))))
    spec = LabelSpec("You read orders.", "{o_orderkey}", NESTED_SPEC)
    parsed = R.parse_responses(table(spark, folder, "orders").select(line.alias("value")), spec)
    total = F.aggregate("keys", F.lit(0).cast("bigint"), lambda a, k: a + k)
    return parsed.select(F.col("_row_id").cast("bigint").alias("o_orderkey"), F.col("order.status").alias("status"), F.col("order.price").alias("price"), total.alias("key_sum"), "error")


BOUNDED_SPEC = LabelSpec("You read orders.", "{o_orderkey}", (
    OutputField("status", "string"),
    OutputField("lines", "array", items=OutputField("line", "object", fields=(
        OutputField("price", "number", minimum=1000, exclusive_maximum=400_000), OutputField("keys", "array", items=OutputField("key", "integer", multiple_of=2))))),
))


def _order_lines(spark: SparkSession, folder: str, price) -> DataFrame:
    """A response for each order: two lines, with a price and two keys each."""
    key = F.col("o_orderkey")
    line = F.struct(price.alias("price"), F.array(key * 2, key).alias("keys"))
    answer = F.struct(F.col("o_orderstatus").alias("status"), F.array(F.struct(F.lit(1000.0).alias("price"), F.array(key * 4).alias("keys")), line).alias("lines"))
    return table(spark, folder, "orders").select(response_line(encode_request_id(key), F.to_json(answer)).alias("value"))


@query("""SELECT o_orderkey, CASE WHEN error = '' THEN o_totalprice END AS price, nullif(error, '') AS error FROM (
    SELECT *, array_to_string(list_filter([CASE WHEN o_totalprice < 1000 THEN 'lines[1].price is below 1000' END, CASE WHEN o_totalprice >= 400000 THEN 'lines[1].price is not below 400000' END,
        CASE WHEN o_orderkey % 2 = 1 THEN 'lines[1].keys[1] is not a multiple of 2' END], lambda x: x IS NOT NULL), '; ') AS error FROM orders)""")
def conform_bounds(spark: SparkSession, folder: str) -> DataFrame:
    parsed = R.parse_responses(_order_lines(spark, folder, F.col("o_totalprice")), BOUNDED_SPEC)
    return parsed.select(F.col("_row_id").cast("bigint").alias("o_orderkey"), F.col("lines")[1]["price"].alias("price"), "error")


@query("""SELECT o_orderkey, o_orderstatus AS status, o_custkey AS customer, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS whole,
    CASE WHEN o_orderkey % 3 <> 2 THEN o_custkey END AS from_text FROM orders""")
def loose_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Inside of objects and arrays, too, what is no integer is null, and numbers may come as text."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    whole = F.concat(key.cast("string"), F.when(key % 3 == 0, ".0").otherwise(".5"))
    text = F.when(key % 3 == 0, customer.cast("string")).when(key % 3 == 1, F.concat(F.lit('"'), customer.cast("string"), F.lit('"'))).otherwise('"none"')
    answer = F.concat(F.lit('{"order": {"status": "'), F.col("o_orderstatus"), F.lit('", "note": '), customer.cast("string"), F.lit('}, "keys": ['), whole, F.lit(", "), text, F.lit("]}"))
    spec = LabelSpec("You read orders.", "{o_orderkey}", (
        OutputField("order", "object", fields=(OutputField("status", "string"), OutputField("note", "string"))), OutputField("keys", "array", items=OutputField("item", "integer"))))
    parsed = R.parse_responses(table(spark, folder, "orders").select(response_line(encode_request_id(key), answer).alias("value")), spec, mode="loose")
    return parsed.select(F.col("_row_id").cast("bigint").alias("o_orderkey"), "order.status", F.col("order.note").cast("bigint").alias("customer"),
                         F.col("keys")[0].alias("whole"), F.col("keys")[1].alias("from_text"))


_RULES = (
    OutputField("event_type", "string", enum=("click", "view", "purchase")),
    OutputField("value", "number", minimum=1, exclusive_maximum=50),
    OutputField("user_id", "integer", exclusive_minimum=5, maximum=900, multiple_of=2),
)


@query("""SELECT event_id, array_to_string(list_filter([
    CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'event_type is not one of the allowed values' END,
    CASE WHEN value < 1 THEN 'value is below 1' END, CASE WHEN value >= 50 THEN 'value is not below 50' END,
    CASE WHEN user_id > 900 THEN 'user_id is above 900' END, CASE WHEN user_id <= 5 THEN 'user_id is not above 5' END,
    CASE WHEN user_id % 2 <> 0 THEN 'user_id is not a multiple of 2' END], lambda x: x IS NOT NULL), '; ') AS broken FROM events""")
def constraint_check(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.array_join(violations(_RULES), "; ").alias("broken"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS row_id, CAST(quality AS BIGINT) AS quality, 'quality ' || quality AS quality_reasoning,
    CAST(toxic AS BIGINT) AS toxic, 'toxic ' || toxic AS toxic_reasoning FROM labels""")
def reasoning_columns(spark: SparkSession, folder: str) -> DataFrame:
    spec = QUALITY_SPEC.replace(reasoning=True)
    reason = [F.concat(F.lit(f"{c} "), F.col(c).cast("string")).alias(f"{c}_reasoning") for c in ("quality", "toxic")]
    text = F.to_json(F.struct("quality", "toxic", *reason))
    lines = table(spark, folder, "labels").select(response_line(encode_request_id(F.col("doc_id")), text).alias("value"))
    return R.answers(R.parse_responses(lines, spec), spec).withColumnRenamed("_row_id", "row_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS row_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM labels")
def reasoning_dropped(spark: SparkSession, folder: str) -> DataFrame:
    return R.reasoning_dropped(reasoning_columns(spark, folder), QUALITY_SPEC.replace(reasoning=True))


# --- merging ------------------------------------------------------------------------------------------------------------------

_MERGED_SQL = """SELECT CAST(d.doc_id AS VARCHAR) AS row_id, d.source, CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


@query(_MERGED_SQL)
def merge_results(spark: SparkSession, folder: str) -> DataFrame:
    merged = M.merge_results(_document_rows(spark, folder), _quality_answers(spark, folder))
    return merged.select(F.col("_row_id").alias("row_id"), "source", "quality", "toxic")


_HOT_SQL = """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 WHEN event_id % 5 > 0 THEN 10 + event_id % 3000 END AS id, event_type FROM events"""


@query(f"""SELECT CAST(r.id AS VARCHAR) AS row_id, r.place, a.event_id, a.event_type
    FROM (SELECT DISTINCT o_orderkey % 4000 AS id, o_orderkey % 2 AS place FROM orders) r LEFT JOIN ({_HOT_SQL}) a ON a.id = r.id""")
def merge_hot(spark: SparkSession, folder: str) -> DataFrame:
    """One id has half of all answers, a tenth have none, the others a few each; some rows share an id."""
    number = F.col("event_id")
    row_id = F.when(number % 2 == 0, 1).when(number % 5 > 0, 10 + number % 3000)
    answers = table(spark, folder, "events").select(row_id.cast("string").alias("_row_id"), "event_id", "event_type")
    rows = table(spark, folder, "orders").select((F.col("o_orderkey") % 4000).alias("_row_id"), (F.col("o_orderkey") % 2).alias("place")).distinct()
    return M.merge_results(rows, answers).withColumnRenamed("_row_id", "row_id")


@query("""SELECT CAST(d.doc_id AS VARCHAR) AS row_id, d.lang, d.n_chars, CASE WHEN d.doc_id % 16 < 8 THEN d.lang END AS lang_right,
    CASE WHEN d.doc_id % 16 < 8 THEN d.n_chars END AS n_chars_right FROM documents d""")
def merge_collision(spark: SparkSession, folder: str) -> DataFrame:
    answers = R.answers(_parsed(spark, folder), DOCUMENT_SPEC).select("_row_id", F.col("lang_label").alias("lang"), F.col("chars").alias("n_chars"))
    rows = _document_rows(spark, folder).select("_row_id", "lang", "n_chars")
    return M.merge_results(rows, answers).withColumnRenamed("_row_id", "row_id")


@query("""SELECT CAST(conv_id AS VARCHAR) AS row_id, role AS first_role, length(text) AS first_chars FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn = 1""")
def merge_dedup(spark: SparkSession, folder: str) -> DataFrame:
    turns = I.id_from_column(table(spark, folder, "conversations"), "conv_id", keep=False)
    rows = turns.select("_row_id").distinct()
    answers = turns.select("_row_id", "turn", F.col("role").alias("first_role"), F.length("text").cast("bigint").alias("first_chars"))
    merged = M.merge_results(rows, answers, on_duplicate="first", order_answers=F.col("turn"))
    return merged.select(F.col("_row_id").alias("row_id"), "first_role", "first_chars")


@query("SELECT CAST(conv_id AS VARCHAR) AS row_id, turn, role FROM conversations")
def merge_duplicates_kept(spark: SparkSession, folder: str) -> DataFrame:
    turns = I.id_from_column(table(spark, folder, "conversations"), "conv_id", keep=False)
    merged = M.merge_results(turns.select("_row_id").distinct(), turns.select("_row_id", "turn", "role"))
    return merged.select(F.col("_row_id").alias("row_id"), "turn", "role")


@query("SELECT CAST(doc_id AS VARCHAR) AS row_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unanswered_rows(spark: SparkSession, folder: str) -> DataFrame:
    left = M.unanswered_rows(_document_rows(spark, folder), _quality_answers(spark, folder))
    return left.select(F.col("_row_id").alias("row_id"), "lang")


@query("SELECT CAST(doc_id AS VARCHAR) AS row_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def answered_rows(spark: SparkSession, folder: str) -> DataFrame:
    done = M.answered_rows(_document_rows(spark, folder), _quality_answers(spark, folder))
    return done.select(F.col("_row_id").alias("row_id"), "lang")


@query("""SELECT CAST(doc_id AS VARCHAR) AS row_id, 1 AS round, n_chars AS chars FROM documents WHERE doc_id % 16 < 8
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 2, n_chars + 1 FROM documents WHERE doc_id % 16 >= 8""")
def union_rounds(spark: SparkSession, folder: str) -> DataFrame:
    first = R.answers(_parsed(spark, folder), DOCUMENT_SPEC)
    rest = M.unanswered_rows(_document_rows(spark, folder), first)
    text = F.to_json(F.struct((F.col("n_chars") + 1).alias("chars")))
    lines = rest.select(response_line(encode_request_id(F.col("_row_id")), text).alias("value"))
    second = R.answers(R.parse_responses(lines, CHARS_SPEC), CHARS_SPEC)
    both = M.union_rounds(first.withColumn("round", F.lit(1)), second.withColumn("round", F.lit(2)))
    return both.select(F.col("_row_id").alias("row_id"), "round", "chars")


@query("""SELECT CAST(d.doc_id AS VARCHAR) AS row_id, a.n AS after, d.lang, CASE WHEN d.doc_id % 4 <= a.n THEN d.n_chars END AS chars
    FROM documents d, (VALUES (0), (1), (2)) a(n)""")
def merge_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Rows are stored once; after each of three rounds, all answers so far are merged with them. A row of the last quarter is never answered."""
    docs, target = _documents(spark, folder), shared_dir(spark, "answers")
    path = store_rows(I.id_from_column(docs.select("doc_id", "lang"), "doc_id", keep=False)).path
    merged = []
    for number in range(3):
        text = F.when(F.col("doc_id") % 4 <= number, F.to_json(F.struct(F.col("n_chars").alias("chars")))).otherwise("none")
        lines = docs.where(F.col("doc_id") % 4 >= number).select(response_line(encode_request_id(F.col("doc_id")), text).alias("value"))
        add_round(R.parse_responses(lines, CHARS_SPEC), target, "asked", number)
        answers = R.answers(current(history(spark, target)).drop(ROUND, STREAM), CHARS_SPEC)
        merged.append(open_rows(spark, path).merge(answers).withColumn("after", F.lit(number)))
    return M.union_rounds(*merged).select(F.col("_row_id").alias("row_id"), "after", "lang", "chars")


# --- checks before a job ------------------------------------------------------------------------------------------------------


@query(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(n_chars AS VARCHAR) AS n_chars, lang FROM documents ORDER BY documents.doc_id LIMIT 1")
def sample_row(spark: SparkSession, folder: str) -> DataFrame:
    return P.sample_row(_documents(spark, folder), ["doc_id", "n_chars", "lang", "no_such_column"], order_by=["doc_id"])


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN length(text) > 50 THEN substring(text, 1, 47) || '...' ELSE text END AS text, lang, source,
    CAST(n_chars AS VARCHAR) AS n_chars FROM documents ORDER BY documents.doc_id LIMIT 5""")
def preview_rows(spark: SparkSession, folder: str) -> DataFrame:
    return P.preview_rows(_documents(spark, folder), 5, order_by=["doc_id"])


@query("SELECT count(*) AS row_count, count(DISTINCT doc_id) AS unique_count, count(*) FILTER (WHERE doc_id IS NULL) AS null_count, count(*) = count(DISTINCT doc_id) AS is_unique FROM documents")
def id_uniqueness(spark: SparkSession, folder: str) -> DataFrame:
    return P.id_uniqueness(_documents(spark, folder), "doc_id")


@query("""SELECT count(*) AS row_count, count(DISTINCT quality) + 1 AS unique_count, count(*) FILTER (WHERE quality IS NULL) AS null_count, false AS is_unique
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def id_uniqueness_nulls(spark: SparkSession, folder: str) -> DataFrame:
    df = _documents(spark, folder).select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    return P.id_uniqueness(df, "quality")


@query("SELECT CAST(conv_id AS VARCHAR) AS id, count(*) AS occurrences FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    return P.duplicate_ids(table(spark, folder, "conversations"), "conv_id")


@query("""SELECT * FROM (VALUES (1, 'model', 'ok', 'claude-sonnet-4-5'),
    (2, 'rows', 'ok', (SELECT count(*) FROM documents) || ' rows, 5 columns'), (3, 'columns', 'ok', 'lang, source, text'),
    (4, 'id_column', 'ok', 'doc_id (' || (SELECT count(DISTINCT doc_id) FROM documents) || ' unique values)'),
    (5, 'template', 'ok', '3 variables'), (6, 'output', 'ok', '4 fields')) AS t(seq, "check", status, detail)""")
def preflight_report(spark: SparkSession, folder: str) -> DataFrame:
    return P.preflight_report(_documents(spark, folder), DOCUMENT_SPEC)


@query("""SELECT * FROM (VALUES (1, 'model', 'warn', 'Unknown model: other (cost estimation may be inaccurate)'),
    (2, 'rows', 'ok', (SELECT count(*) FROM conversations) || ' rows, 4 columns'), (3, 'columns', 'ok', 'text'),
    (4, 'id_column', 'error', 'ID column ''conv_id'' contains duplicate values. Found ' || (SELECT count(DISTINCT conv_id) FROM conversations)
        || ' unique values in ' || (SELECT count(*) FROM conversations) || ' rows.')) AS t(seq, "check", status, detail)""")
def preflight_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    spec = LabelSpec("s", "{text}", CHARS_SPEC.fields, model="other", id_column="conv_id")
    return P.preflight_report(table(spark, folder, "conversations"), spec)


# --- tokens and cost ----------------------------------------------------------------------------------------------------------

_PRICES_SQL = "(VALUES " + ", ".join(f"('{m}', {', '.join(str(float(x)) for x in p)})" for m, p in MODEL_PRICES.items()) + ") AS p(model, pi, po, pw, pr)"
_CACHED = f"(greatest(1, length('{SYSTEM}') // 4) + greatest(1, length('{DOCUMENT_SPEC.schema_text()}') // 4))"


def _cost_sql(tokens: str, where: str) -> str:
    return f"""SELECT model, round(tokens * pi / 1e6, 6) AS input_cost, round(n * 200 * po / 1e6, 6) AS output_cost,
        round({_CACHED} * pw / 1e6, 6) AS cache_write_cost, round((n - 1) * {_CACHED} * pr / 1e6, 6) AS cache_read_cost,
        round((tokens * pi + n * 200 * po + {_CACHED} * pw + (n - 1) * {_CACHED} * pr) / 1e6, 6) AS total_cost, n AS total_requests
        FROM (SELECT p.*, (SELECT count(*) FROM documents) AS n, {tokens} AS tokens FROM {_PRICES_SQL}) {where}"""


_ALL_TOKENS = f"(SELECT sum({_TOKENS}) FROM documents)"
_FIRST_TOKENS = f"(SELECT {_TOKENS} FROM documents ORDER BY doc_id LIMIT 1) * (SELECT count(*) FROM documents)"


def _rounded(cost: DataFrame) -> DataFrame:
    names = ["input_cost", "output_cost", "cache_write_cost", "cache_read_cost", "total_cost"]
    return cost.select("model", *[F.round(c, 6).alias(c) for c in names], "total_requests")


@query(_cost_sql(_ALL_TOKENS, "WHERE model = 'claude-sonnet-4-5'"))
def cost_exact(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(C.estimate_cost(_documents(spark, folder), DOCUMENT_SPEC))


@query(_cost_sql(_FIRST_TOKENS, "WHERE model = 'claude-sonnet-4-5'"))
def cost_first_row(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(C.estimate_cost(_documents(spark, folder), DOCUMENT_SPEC, method="first_row", order_by=["doc_id"]))


@query(_cost_sql(_ALL_TOKENS, ""))
def cost_by_model(spark: SparkSession, folder: str) -> DataFrame:
    totals = C.token_totals(_documents(spark, folder), DOCUMENT_SPEC)
    return _rounded(C.cost_by_model(totals, DOCUMENT_SPEC, price_table(spark)))


# --- batches ------------------------------------------------------------------------------------------------------------------

_BATCHED = "SELECT *, doc_id // 250 AS batch_no FROM documents"


def _batched_requests(spark: SparkSession, folder: str) -> DataFrame:
    batch = F.floor(F.col("doc_id") / 250).cast("bigint")
    return _documents(spark, folder).select(encode_request_id(F.col("doc_id")).alias("custom_id"), batch.alias("batch_no"))


@query(f"""SELECT batch_no, CASE WHEN processing = 0 THEN 'ended' ELSE 'in_progress' END AS status, total, processing, succeeded, errored, canceled, expired,
    processing = 0 AS is_done, round((succeeded + errored) / total, 6) AS progress FROM (
    SELECT batch_no, count(*) AS total, count(*) FILTER (WHERE doc_id % 5 = 0 AND batch_no % 2 = 1) AS processing,
        count(*) FILTER (WHERE NOT (doc_id % 5 = 0 AND batch_no % 2 = 1) AND doc_id % 16 NOT IN (8, 9, 15)) AS succeeded,
        count(*) FILTER (WHERE NOT (doc_id % 5 = 0 AND batch_no % 2 = 1) AND doc_id % 16 IN (8, 9)) AS errored, CAST(0 AS BIGINT) AS canceled,
        count(*) FILTER (WHERE NOT (doc_id % 5 = 0 AND batch_no % 2 = 1) AND doc_id % 16 = 15) AS expired FROM ({_BATCHED}) GROUP BY batch_no)""")
def batch_status(spark: SparkSession, folder: str) -> DataFrame:
    # In every second batch, the documents with ids divisible by five have no response yet.
    waiting = (F.col("doc_id") % 5 == 0) & (F.floor(F.col("doc_id") / 250) % 2 == 1)
    responses = B.response_states(document_responses(_documents(spark, folder).filter(~waiting)))
    status = B.batch_status(_batched_requests(spark, folder), responses)
    return status.withColumn("progress", F.round("progress", 6))


def _batch_log(spark: SparkSession, folder: str) -> DataFrame:
    """Two state changes for each 100 orders: the batch is created, later it ends or is canceled."""
    order = F.col("o_orderkey")
    per_batch = table(spark, folder, "orders").groupBy(F.floor(order / 100).cast("bigint").alias("b")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "P").alias("failed"))
    created = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("b").cast("int"))
    change = F.explode(F.array(F.lit(0), F.lit(1))).alias("step")
    steps = per_batch.select("*", change)
    last = F.col("step") == 1
    ended = F.when(F.col("b") % 3 == 0, "canceled").otherwise("ended")
    none = F.lit(None).cast("string")
    return steps.select(
        F.concat(F.lit("batch_of_one_hundred_orders_"), F.lpad(F.col("b").cast("string"), 8, "0")).alias("batch_id"),
        F.when(last, ended).otherwise("in_progress").alias("status"), created.alias("created_at"),
        (created + F.make_dt_interval(F.lit(0), F.lit(0), F.col("step") * 10)).alias("updated_at"),
        F.col("n").alias("total_requests"), F.when(last, F.col("done")).otherwise(0).alias("completed_requests"),
        F.when(last, F.col("failed")).otherwise(0).alias("failed_requests"),
        *[none.alias(c) for c in ("config_path", "input_path", "requests_path", "responses_path", "errors_path")],
    )


_LIST_SQL = """SELECT left('batch_of_one_hundred_orders_' || lpad(CAST(b AS VARCHAR), 8, '0'), 26) AS batch,
    CASE WHEN b % 3 = 0 THEN 'canceled' ELSE 'ended' END AS status, strftime(TIMESTAMP '2024-01-01' + to_hours(b), '%Y-%m-%d %H:%M') AS created,
    done || '/' || n AS requests, CAST(round_even(done / n * 100, 0) AS BIGINT) || '%' AS progress
    FROM (SELECT o_orderkey // 100 AS b, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY 1)"""


@query(_LIST_SQL + " ORDER BY b DESC LIMIT 20")
def batch_list(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_dir(spark, "batch-log")
    B.append_batch_log(_batch_log(spark, folder), path)
    return B.batch_list(B.read_batch_log(spark, path), limit=B.LISTED_BATCHES)


@query(_LIST_SQL)
def batch_list_all(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_dir(spark, "batch-log")
    for step in ("in_progress", "ended", "canceled"):  # the log grows by one change after the other
        B.append_batch_log(_batch_log(spark, folder).where(F.col("status") == step), path)
    return B.batch_list(B.read_batch_log(spark, path))


@query(f"""SELECT 'batch_' || batch_no AS batch, CASE WHEN waiting = 0 THEN 'ended' ELSE 'in_progress' END AS status, '2024-01-01 00:00' AS created,
    good || '/' || total AS requests, CAST(round_even(good / total * 100, 0) AS BIGINT) || '%' AS progress FROM (
    SELECT batch_no, count(*) AS total, count(*) FILTER (WHERE doc_id % 5 = 0 AND batch_no % 2 = 1) AS waiting,
        count(*) FILTER (WHERE NOT (doc_id % 5 = 0 AND batch_no % 2 = 1) AND doc_id % 16 NOT IN (8, 9, 15)) AS good FROM ({_BATCHED}) GROUP BY batch_no)""")
def batch_progress_logged(spark: SparkSession, folder: str) -> DataFrame:
    """Two polls of the batches go to the log, before and after responses came; the list shows the second."""
    path, at = shared_dir(spark, "batch-log"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    requests, documents = _batched_requests(spark, folder), _documents(spark, folder)
    waiting = (F.col("doc_id") % 5 == 0) & (F.floor(F.col("doc_id") / 250) % 2 == 1)
    for minute, answered in enumerate([F.lit(False), ~waiting]):
        status = B.batch_status(requests, B.response_states(document_responses(documents.filter(answered))))
        B.append_batch_log(B.log_rows(status, F.concat(F.lit("batch_"), "batch_no"), at, at + F.make_dt_interval(mins=F.lit(minute))), path)
    return B.batch_list(B.read_batch_log(spark, path))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ended' WHEN 'O' THEN 'in_progress' ELSE 'pending' END AS state,
    o_orderstatus = 'F' AS is_done FROM orders""")
def batch_states(spark: SparkSession, folder: str) -> DataFrame:
    word = F.when(F.col("o_orderstatus") == "F", "ended").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("canceling")
    state = B.batch_state(word)
    return table(spark, folder, "orders").select("o_orderkey", state.alias("state"), B.is_done(state).alias("is_done"))


# --- delimited files ----------------------------------------------------------------------------------------------------------


@query("""SELECT s.sep, s.sep AS detected, (SELECT count(*) FROM orders) AS n_rows, (SELECT sum(o_orderkey)::BIGINT FROM orders) AS key_sum
    FROM (VALUES (','), (';'), (chr(9)), ('|')) AS s(sep)""")
def detect_separator(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    found = []
    for sep in D.SEPARATORS:
        path = shared_dir(spark, "delimited")
        D.write_delimited(orders, path, sep)
        df = D.read_delimited(spark, path)
        found.append(df.agg(F.lit(sep).alias("sep"), F.lit(D.detect_separator(spark, path)).alias("detected"),
                            F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("key_sum")))
    return M.union_rounds(*found)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_dir(spark, "delimited")
    D.write_delimited(_documents(spark, folder), path, ";")
    df = D.read_delimited(spark, path)
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"))


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Files with four separators in one folder, each read by its own."""
    path = shared_dir(spark, "delimited")
    for i, sep in enumerate(D.SEPARATORS):
        D.write_delimited(_documents(spark, folder).where(F.col("doc_id") % 4 == i), f"{path}/{i}", sep)
    df = D.read_delimited(spark, f"{path}/*", schema="doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.select("doc_id", "text", "lang", "source", "n_chars")


@query("""SELECT * FROM (VALUES ('found', true, '', (SELECT count(*) FROM documents), 5), ('given', true, '', (SELECT count(*) FROM documents), 5),
    ('missing', false, 'Missing columns: label, score', (SELECT count(*) FROM documents), 5), ('wrong', false, 'Missing columns: text', (SELECT count(*) FROM documents), 1)) AS t("check", ok, message, n_rows, n_columns)""")
def file_check(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_dir(spark, "delimited")
    D.write_delimited(_documents(spark, folder), path, ";")
    cases = {"found": (["text"], None), "given": (["text", "lang"], ";"), "missing": (["text", "label", "score"], None), "wrong": (["text"], "|")}
    found = {name: D.check_delimited(spark, path, required, sep) for name, (required, sep) in cases.items()}
    return spark.createDataFrame([(name, *check) for name, check in found.items()], "check string, ok boolean, message string, n_rows long, n_columns int")


@query("""SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, d.text, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    df = _documents(spark, folder).select("doc_id", "text").join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left")
    path = shared_dir(spark, "delimited")
    D.write_delimited(df, path)
    return D.read_delimited(spark, path, sep=",", schema="doc_id string, text string, quality int")


# --- streams ------------------------------------------------------------------------------------------------------------------


@query(_PARSED_SQL)
def stream_parse(spark: SparkSession, folder: str) -> DataFrame:
    source, target, state = (shared_dir(spark, p) for p in ("lines", "parsed", "state"))
    S.write_lines(document_responses(_documents(spark, folder)), source)
    T.stream_parse(spark, source, target, state, DOCUMENT_SPEC).awaitTermination()
    return spark.read.parquet(target).select(F.col("_row_id").alias("row_id"), *_PARSED_COLUMNS)


@query(_REQUEST_SQL)
def stream_requests(spark: SparkSession, folder: str) -> DataFrame:
    target, state = (shared_dir(spark, p) for p in ("requests", "state"))
    batch = _documents(spark, folder)
    rows = spark.readStream.schema(batch.schema).parquet(f"{folder}/documents.parquet*")
    T.stream_requests(rows, DOCUMENT_SPEC, target, state).awaitTermination()
    return _request_parts(spark.read.text(target).withColumnRenamed("value", "request"))


@query(_MERGED_SQL)
def stream_merge(spark: SparkSession, folder: str) -> DataFrame:
    source, target, state = (shared_dir(spark, p) for p in ("lines", "answers", "state"))
    S.write_lines(quality_responses(spark, folder).repartition(4), source)
    T.stream_answers(spark, source, target, state, QUALITY_SPEC, files_per_trigger=2).awaitTermination()
    merged = T.merge_answers(_document_rows(spark, folder), target, QUALITY_SPEC)
    return merged.select(F.col("_row_id").alias("row_id"), "source", "quality", "toxic")


@query("""SELECT batch_no, CASE WHEN processing = 0 THEN 'ended' ELSE 'in_progress' END AS status, total, processing, succeeded, errored, canceled, expired,
    processing = 0 AS is_done, round((succeeded + errored) / total, 6) AS progress FROM (
    SELECT o_orderkey // 500 AS batch_no, count(*) AS total, count(*) FILTER (WHERE NOT answered AND NOT past) AS processing,
        count(*) FILTER (WHERE answered AND o_orderstatus <> 'P') AS succeeded, count(*) FILTER (WHERE answered AND o_orderstatus = 'P') AS errored,
        CAST(0 AS BIGINT) AS canceled, count(*) FILTER (WHERE NOT answered AND past) AS expired
    FROM (SELECT *, o_orderkey % 7 NOT IN (2, 3) AS answered, o_orderdate + INTERVAL 25 HOUR < (SELECT max(o_orderdate) FROM orders) AS past FROM orders)
    GROUP BY 1)""")
def stream_status(spark: SparkSession, folder: str) -> DataFrame:
    """Orders are requests, sent on their date; one in seven is never answered, one in seven too late, some twice; one response has no request. What is
    unanswered a day later is expired, as far as both streams have come (one hour less than the last time seen)."""
    orders, key = table(spark, folder, "orders"), F.col("o_orderkey")
    asked, told, target, state = (shared_dir(spark, p) for p in ("asked", "told", "outcomes", "state"))
    request = encode_request_id(key).alias("custom_id")
    requests = orders.select(request, F.floor(key / 500).cast("bigint").alias("batch_no"), F.col("o_orderdate").cast("timestamp").alias(G.SENT))
    hours = F.explode(F.when(key % 7 == 2, F.array()).when(key % 7 == 3, F.array(F.lit(25))).when(key % 7 == 4, F.array(F.lit(2), F.lit(23))).otherwise(F.array(F.lit(5))))
    arrived = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=F.col("hour"))
    result = F.when((F.col("o_orderstatus") == "P") | ((key % 7 == 4) & (F.col("hour") == 2)), "errored").otherwise("succeeded")
    responses = orders.select("*", hours.alias("hour")).select(request, result.alias("state"), arrived.alias(G.ANSWERED))
    stranger = requests.agg(F.lit("row_none").alias("custom_id"), F.lit("succeeded").alias("state"), (F.max(G.SENT) + F.expr("INTERVAL 30 HOURS")).alias(G.ANSWERED))
    requests.write.parquet(asked)
    responses.union(stranger).write.parquet(told)
    streams = [spark.readStream.schema(df.schema).parquet(path) for df, path in ((requests, asked), (responses, told))]
    G.stream_outcomes(*streams, target, state).awaitTermination()
    status = G.live_status(requests, target)
    return status.withColumn("progress", F.round("progress", 6))


ROUND_SPEC = LabelSpec("You read orders.", "{o_orderkey}", (OutputField("round", "integer"), OutputField("stream", "string")), id_column="o_orderkey")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS row_id, CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 3 = 1 THEN 1 WHEN o_orderkey % 4 = 0 THEN 3 END AS round,
    CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 3 = 1 OR o_orderkey % 4 = 0 THEN o_orderstatus END AS stream FROM orders""")
def stream_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Two streams, one of them run again from nothing, feed a table that is compacted between rounds: a third of the rows is answered twice (the later
    counts), a third once and then failed (the answer counts), a third failed, some of those answered after the compaction."""
    orders, key = table(spark, folder, "orders"), F.col("o_orderkey")
    target, sources, states = shared_dir(spark, "answers"), [shared_dir(spark, "lines") for _ in range(2)], [shared_dir(spark, "state") for _ in range(2)]

    def land(source: str, where, number: int | None) -> None:
        text = F.to_json(F.struct(F.lit(number).alias("round"), F.col("o_orderstatus").alias("stream"))) if number else F.lit("none")
        S.write_lines(orders.where(where).select(response_line(encode_request_id(key), text).alias("value")), f"{source}/{number}-{shared_dir(spark, 'part').rsplit('-', 1)[1]}")

    def run(i: int, state: str) -> None:
        T.stream_answers(spark, f"{sources[i]}/*", target, state, ROUND_SPEC).awaitTermination()

    land(sources[0], key % 3 != 2, 1)
    land(sources[0], key % 3 == 2, None)
    run(0, states[0])
    land(sources[1], key % 3 == 0, 2)
    land(sources[1], key % 3 == 1, None)
    run(1, states[1])
    compact(spark, target)
    land(sources[1], (key % 3 == 2) & (key % 4 == 0), 3)
    run(1, states[1])
    add_round(history(spark, target).drop(ROUND, STREAM), target, md5(states[0].encode()).hexdigest(), 0)  # the first round once more, with other rows
    merged = T.merge_answers(I.id_from_column(orders.select("o_orderkey"), "o_orderkey"), target, ROUND_SPEC, "latest")
    return merged.select(F.col("_row_id").alias("row_id"), "round", "stream")
