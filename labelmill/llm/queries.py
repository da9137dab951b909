"""One query per operator over its whole table, with production parameters; and SQL for those that SQL can state."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm import (
    byte_bpe, decontaminate, fill_middle, inner_products, language, line_templates, merkle, near_dedup, packing, perplexity, site_style, token_counts, toxicity,
)
from labelmill.llm.common import fold

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PACKING_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CODING_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COUNTING_VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def ship(spark: SparkSession) -> None:
    """Lets Python workers find this package where the driver found it, if their path was not set."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(spark, folder)

        QUERIES[fn.__name__] = run
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _held_out(parts: int, rest: int):
    return F.coalesce(fold(F.col("doc_id"), parts) == rest, F.lit(True)).alias("held_out")


_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(regexp_split_to_array({_LOW.format('text')}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
    sizes AS (SELECT d.doc_id, count(g) AS n FROM documents d LEFT JOIN shingles s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
    SELECT d.doc_id, n AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM sizes d JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id""")
def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


_RUNS = "list_filter(regexp_split_to_array({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


@query(f"""
    WITH items AS (SELECT item_id, {_RUNS.format(_LOW.format('text'))} AS w FROM benchmark),
    windows AS (
        SELECT DISTINCT item_id, least(13, len(w)) AS size, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) AS window
        FROM items WHERE len(w) > 0),
    docs AS (SELECT doc_id, {_RUNS.format(_LOW.format('text'))} AS w FROM documents),
    places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM windows)),
    hits AS (SELECT DISTINCT doc_id, item_id, i, p.size FROM places p JOIN windows x ON x.size = p.size AND x.window = array_to_string(w[i:i + p.size - 1], ' ')),
    words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
    found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM docs d LEFT JOIN words h ON h.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id""")
def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), COUNTING_VOCABULARY, public_tokenizers.PATTERN, fields=("source", "text"))


@query()
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.identify(docs.select("doc_id", "text"), language.learn(docs)).select("doc_id", _held_out(5, 0), "lang_pred", "score")


@query("""
    WITH lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS body, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents),
    tokens AS (SELECT doc_id, line, body, list_filter(regexp_split_to_array(regexp_replace(body, '[^ \\t\\r]*[0-9][^ \\t\\r]*', '<*>', 'g'), '[ \\t\\r]+'), lambda x: x <> '') AS t FROM lines),
    parts AS (SELECT doc_id, line, t, len(t) AS n, CAST(ceil((len(t) - 3) / 3) AS BIGINT) AS third FROM tokens WHERE len(t) > 0),
    keyed AS (
        SELECT doc_id, line, unnest(CASE WHEN n >= 12 THEN [{'k': 0, 'n': n, 'v': t}, {'k': 1, 'n': n, 'v': t[1:3] || ['|'] || t[4 + third:]},
                    {'k': 2, 'n': n, 'v': t[1:3 + third] || ['|'] || t[4 + 2 * third:]}, {'k': 3, 'n': n, 'v': t[1:3 + 2 * third]}] ELSE [{'k': 0, 'n': n, 'v': t}] END) AS key FROM parts),
    shared AS (SELECT key, min({'d': doc_id, 'l': line}) AS first FROM keyed GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    dropped AS (SELECT DISTINCT doc_id, line FROM keyed JOIN shared USING (key) WHERE {'d': doc_id, 'l': line} <> first)
    SELECT l.doc_id, string_agg(l.body, chr(10) ORDER BY l.line) FILTER (x.line IS NULL) AS text, count(*) AS n_lines, count(x.line) AS n_dropped
    FROM lines l LEFT JOIN dropped x ON x.doc_id = l.doc_id AND x.line = l.line GROUP BY l.doc_id""".replace("string_agg(", "coalesce(string_agg(").replace("AS text, count", ", '') AS text, count"))
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_templates.drop_recurring(table(spark, folder, "documents").select("doc_id", "text"))


@query()
def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return site_style.extract_main_text(table(spark, folder, "pages"))


@query("""
    WITH whole AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
        FROM whole q JOIN whole c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
    ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
    SELECT * FROM ranked WHERE rank <= 10""")
def op7_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return inner_products.top_products(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.learn(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model).select("doc_id", _held_out(5, 0), "score", "predicted")


@query()
def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = perplexity.learn(docs, where="crc32(cast(doc_id as string)) % 7 <> 2")
    return perplexity.score(docs, model).select("doc_id", _held_out(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, folder, "documents"), PACKING_TOKENIZER)


_LEAF = "sha256({})".format(" || ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in ("doc_id", "source", "lang", "{n}", "text")))


@query(f"""
    WITH RECURSIVE crc(i, k, x) AS (
        SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM crc WHERE k < 8),
    crc_table AS (SELECT list(x ORDER BY i) AS t FROM crc WHERE k = 8),
    hashed AS (
        SELECT doc_id, lang, {_LEAF.format(n='n_chars')} AS leaf,
               xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                               lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 7 = 0 AS forged,
               {_LEAF.format(n='(n_chars + 1)')} AS other
        FROM documents, crc_table),
    leaves AS (SELECT *, coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
    tree AS (
        SELECT g, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM leaves
        UNION ALL SELECT g, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, level, pos // 2),
    subs AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
    joint AS (
        SELECT 0 AS level, pos, h, n FROM subs
        UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM joint WHERE n > 1 GROUP BY level, pos // 2),
    steps AS (
        SELECT l.g, l.pos, t.level, CASE WHEN t.pos % 2 = 0 THEN 'R' ELSE 'L' END || coalesce(s.h, '') AS step
        FROM leaves l JOIN tree t ON t.g = l.g AND t.n > 1 AND t.pos = l.pos // (1 << t.level)
        LEFT JOIN tree s ON s.g = t.g AND s.level = t.level AND s.pos = xor(t.pos, 1)
        UNION ALL
        SELECT l.g, l.pos, 100 + t.level, CASE WHEN t.pos % 2 = 0 THEN 'R' ELSE 'L' END || coalesce(s.h, '')
        FROM leaves l JOIN subs b ON b.g = l.g JOIN joint t ON t.n > 1 AND t.pos = b.pos // (1 << t.level)
        LEFT JOIN joint s ON s.level = t.level AND s.pos = xor(t.pos, 1)),
    proofs AS (SELECT g, pos, list(step ORDER BY level) AS steps FROM steps GROUP BY g, pos),
    folded AS (
        SELECT l.*, b.h AS subroot, (SELECT h FROM joint WHERE n = 1) AS root, sha256(coalesce(array_to_string(list_transform(p.steps, lambda s: s[2:]), ''), '')) AS proof_sha256,
               list_reduce(list_prepend(CASE WHEN forged THEN other ELSE leaf END, coalesce(p.steps, [])),
                           lambda node, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || node ELSE node || s[2:] END)) AS folded_root
        FROM leaves l JOIN subs b ON b.g = l.g LEFT JOIN proofs p ON p.g = l.g AND p.pos = l.pos)
    SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded""")
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    forged = merkle.leaf_hash([F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in fields])
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    # The leaf to fold: null where it is the leaf itself.
    rows = docs.withColumn("forged", F.when(chosen, forged))
    proved = merkle.manifest(rows, merkle.leaf_hash([F.col(c) for c in fields]), "lang", "doc_id", ["doc_id", "forged"])
    segments = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    folded = merkle.fold(F.coalesce("row.forged", "leaf"), F.col("proof"))
    out = proved.select("row.doc_id", "leaf", "subroot", "root", F.sha2(segments, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@query()
def op12_byte_level_bpe(spark: SparkSession, folder: str) -> DataFrame:
    model = byte_bpe.serialise_model(byte_bpe.read_ranks(CODING_VOCABULARY))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = byte_bpe.encode(docs, model, public_tokenizers.PATTERN, decoded_col="decoded")
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("""
    WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                           regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents),
    drawn AS (
        SELECT doc_id, text, units, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS b,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
                    WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM hashed),
    parts AS (
        SELECT doc_id, text, CAST(n AS BIGINT) AS n, form, array_to_string(units[:least(a, b)], '') AS p, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m,
               array_to_string(units[greatest(a, b) + 1:], '') AS s FROM drawn)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(text) AS restored_sha256 FROM parts""")
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return fill_middle.fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
