import glob
import os

import pytest
from pyspark.sql import functions as F

from labelmill.errors import SpecError
from labelmill.session import shared_dir
from labelmill.sources import records as S


def requests(spark, n, batch):
    doc = F.to_json(F.struct(F.concat(F.lit("row_"), "id").alias("custom_id")))
    return spark.range(n).select(doc.alias("request"), batch.alias("batch_no"))


@pytest.mark.parametrize(("n", "most"), [(3, 200), (2500, 200), (2500, 3), (2500, 1)])
def test_a_file_holds_one_batch(spark, n, most):
    path = shared_dir(spark, "requests")
    S.write_requests(requests(spark, 4 * n, F.floor(F.col("id") / 4).cast("bigint")).repartition(5), path, most_folders=most)
    folders = glob.glob(f"{path}/per=*/place=*")
    assert len(folders) <= most
    files = [f for d in folders for f in glob.glob(f"{d}/part-*") if os.path.getsize(f)]
    assert len(files) == n
    seen = S.read_requests(spark, path).select("batch_no", F.substring("custom_id", 5, 9).cast("bigint").alias("id"), F.col("_metadata.file_path").alias("f"))
    assert seen.agg(F.count("*"), F.count_if(F.col("batch_no") == F.floor(F.col("id") / 4)), F.count_distinct("f"), F.count_distinct("f", "batch_no")).first()[:] == (4 * n, 4 * n, n, n)


def test_some_batches_only(spark):
    path = shared_dir(spark, "requests")
    S.write_requests(requests(spark, 90, F.col("id") % 9 * 7), path, most_folders=4)
    assert {(r.batch_no, r["count"]) for r in S.read_requests(spark, path).groupBy("batch_no").count().collect()} == {(7 * i, 10) for i in range(9)}


def test_no_requests_and_bad_numbers(spark):
    path = shared_dir(spark, "requests")
    S.write_requests(requests(spark, 0, F.col("id")), path)
    assert not glob.glob(f"{path}/per=*/place=*/part-*")
    for bad in (F.lit(None).cast("bigint"), F.lit(-1)):
        with pytest.raises(SpecError, match="Batch numbers"):
            S.write_requests(requests(spark, 2, bad), shared_dir(spark, "requests"))
