"""Specs and derived inputs of the registered queries, all built from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.functions.identity import encode_request_id
from labelmill.spec import LabelSpec, OutputField

SYSTEM = "You label documents by language, source and length."
TEMPLATE = "Lang: {lang}\nSource: {source}\nText: {text}"

DOCUMENT_SPEC = LabelSpec(
    system=SYSTEM,
    template=TEMPLATE,
    fields=(
        OutputField("lang_label", "string", "Language of the text"),
        OutputField("chars", "integer", "Length of the text"),
        OutputField("is_long", "boolean", "Whether the text is long"),
        OutputField("ratio", "number", "Length in thousands"),
    ),
    id_column="doc_id",
    batch_size=250,
)

QUALITY_SPEC = LabelSpec(
    system="You judge the quality of documents.",
    template=TEMPLATE,
    fields=(OutputField("quality", "integer", "Good text", enum=(0, 1)), OutputField("toxic", "integer", "Harmful text", enum=(0, 1))),
    id_column="doc_id",
)

EVENT_SPEC = LabelSpec(system="You read events.", template="{props}", fields=(OutputField("k", "integer", "Key"),), id_column="event_id")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def response_line(request_id: Column, text: Column) -> Column:
    """A success response around an answer text."""
    return F.to_json(F.struct(request_id.alias("custom_id"), _success(text).alias("result")))


def _success(text: Column) -> Column:
    content = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
    return F.struct(F.lit("succeeded").alias("type"), F.struct(content.alias("content")).alias("message"))


def document_answer(df: DataFrame) -> Column:
    return F.to_json(F.struct(
        F.col("lang").alias("lang_label"), F.col("n_chars").alias("chars"), (F.col("n_chars") > 1000).alias("is_long"),
        (F.col("n_chars") / 8).alias("ratio"),
    ))


def document_responses(df: DataFrame) -> DataFrame:
    """One response line per document; half of them good, the others one of eight failures by ``doc_id % 16``."""
    way = F.col("doc_id") % 16
    message = F.concat(F.lit("Overloaded at "), F.col("doc_id").cast("string"))
    text = (
        F.when(way == 12, F.concat(F.lit("language is "), F.col("lang")))
        .when(way == 13, F.concat(F.lit("["), F.col("n_chars").cast("string"), F.lit("]")))
        .when(way == 14, F.to_json(F.struct(F.col("lang").alias("lang_label"), F.lit("many").alias("chars"), F.lit(True).alias("is_long"))))
        .otherwise(document_answer(df))
    )
    part = F.struct(F.lit("text").alias("type"), text.alias("text"))
    content = F.when(way == 11, F.array().cast("array<struct<type:string,text:string>>")).otherwise(F.array(part))
    result = F.struct(
        F.when(way == 9, "errored").when(way == 15, "expired").when(way != 8, "succeeded").alias("type"),
        F.when(way == 9, F.struct(message.alias("message"))).alias("error"),
        F.when(~way.isin(8, 9, 10, 15), F.struct(content.alias("content"))).alias("message"),
    )
    return df.select(F.to_json(F.struct(encode_request_id(F.col("doc_id")).alias("custom_id"), result.alias("result"))).alias("value"))


def quality_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Responses for the labelled documents only."""
    labels = table(spark, folder, "labels")
    return labels.select(response_line(encode_request_id(F.col("doc_id")), F.to_json(F.struct("quality", "toxic"))).alias("value"))
