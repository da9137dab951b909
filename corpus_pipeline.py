"""A corpus from raw documents to packed sequences: language, recurring lines, near duplicates, contamination, packing.

Each stage works on all rows its predecessor kept and returns the columns of documents, but for the last. Its rows are written to the shared
folder and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm import decontaminate, language, line_templates, near_dedup, packing
from labelmill.llm.common import stage
from labelmill.llm.queries import PACKING_TOKENIZER, ship, table

LEAST_SCORE = 0.5

#: SQL cannot state the language model and the tokenizer; tests hold the pipeline against brute force.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """The name, with underscores in front as long as the table has such a column."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters (null and empty ones too), and those that no learned language accounts for better than all others together.

    All columns stay as they are; rows are judged one by one, so repeated rows and ids make no difference; nothing is left of an empty table."""
    ship(spark)
    found = _free(docs, "found")
    judged = docs.withColumn(found, language.language_of(F.col("text"), language.learn(docs), spark))
    return judged.where((F.col(f"{found}.lang_pred") != language.UNDETERMINED) & (F.col(f"{found}.score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines; documents that consisted of nothing else go. ``n_chars``, if there, follows the text; other columns stay as they are.

    Null texts have no lines and stay; rows with equal id and text share their result."""
    aside = {c: _free(docs, c) for c in docs.columns if c.lower() in ("n_lines", "n_dropped")}
    cut = line_templates.drop_recurring(docs.withColumnsRenamed(aside))
    changed = F.col("n_dropped") > 0
    cut = cut.where(~changed | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    columns = {c: F.col(aside.get(c, c)).alias(c) for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return cut.select(*columns.values())


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component: the least id (null after all others), the first row of several.

    Every row is a document of its own, whatever its id. Rows without an id and rows that share one are written with numbers below all ids first, and go
    by these. Texts without words are linked with nothing and stay."""
    ship(spark)
    key = _free(docs, "key")
    named = F.col("doc_id").isNotNull()
    repeated = stage(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where((F.col("n") > 1) | ~named).select("doc_id"), "repeated_ids")
    rows = docs.withColumn(key, F.col("doc_id").cast("long"))
    if not repeated.isEmpty():
        below = docs.agg(F.least(F.min("doc_id").cast("long"), F.lit(0))).first()[0] or 0
        odd = docs.alias("d").join(repeated.alias("r"), F.expr("d.doc_id <=> r.doc_id"), "left_semi")
        odd = stage(odd.withColumn(key, F.lit(below - 1) - F.monotonically_increasing_id()), "numbered")
        rows = rows.where(named).join(repeated, "doc_id", "left_anti").select(*rows.columns).unionByName(odd)
    found = near_dedup.near_duplicates(rows, id_col=key).select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select(F.col(key).alias("row"), "doc_id")
    rank = F.struct(~named, "doc_id", -F.col("row"))
    first = found.join(ids, "row").groupBy("component_id").agg(F.min_by("row", rank).alias(key))
    return rows.join(stage(first.select(key), "kept"), key, "left_semi").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents. A document is its id and text: a clean one stays, also beside a contaminated one of the same id.

    Null texts have no words and stay."""
    ship(spark)
    judged = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), text_hash=True).where("contaminated")
    judged = judged.select("doc_id", "_text_hash").distinct().alias("j")
    same = F.expr("d.doc_id <=> j.doc_id") & (F.xxhash64(F.col("d.text")) == F.col("j._text_hash"))
    return docs.alias("d").join(judged, same, "left_anti").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences. Null texts are empty ones; every row is packed; an empty table gives none."""
    ship(spark)
    return packing.best_fit_pack(docs, PACKING_TOKENIZER)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
