"""Ids, requests, merging, batches and whole jobs on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from labelmill import Labeler, LabelError, LabelSpec, OutputField, SpecError
from labelmill.operators import batches as B
from labelmill.operators import cost as C
from labelmill.operators import ids as I
from labelmill.operators import merge as M
from labelmill.operators import preflight as P
from labelmill.operators import responses as R
from labelmill.operators.requests import build_requests, infer
from labelmill.session import shared_dir
from labelmill.sources import records as S
from tests.test_responses import GOOD, PARCELS, envelope, ok


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_ids_are_dense_in_any_layout(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = I.assign_ids(df.filter("k % 3 = 0"), order_by=["k"]).orderBy("k").collect()
    assert [r._row_no for r in got] == list(range(1, 335)) and [r._row_id for r in got] == [str(i) for i in range(1, 335)]
    assert sorted(r._row_no for r in I.assign_ids(df, offset=0).collect()) == list(range(1000))
    assert I.assign_ids(df.limit(0), order_by=["k"]).count() == 0


def test_hot_key_is_split(spark):
    # A third of the rows have the same key and are equal in all columns.
    df = spark.range(0, 30000, 1, 8).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    ordered = I.spread_order(df, ["k"]).select("k", F.spark_partition_id().alias("p"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in ordered.groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 30000 / 3
    got = I.assign_ids(df, order_by=["k"]).agg(F.min("_row_no"), F.max("_row_no"), F.count_distinct("_row_no"), F.max(F.when(F.col("k") == -1, F.col("_row_no")))).first()
    assert got[:] == (1, 30000, 30000, 10000)


def test_numbers_do_not_change(spark):
    path = shared_dir(spark, "test")
    df = I.assign_ids(spark.range(500).select(F.rand().alias("x")), order_by=["x"], staging=path)
    assert rows_of(df) == rows_of(df)


def test_rows_before_has_no_task_of_all_parts(spark):
    sizes = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("part"), (F.col("id") % 7).alias("n"))
    before = I.rows_before(sizes.repartition(7), "part", "n", "start")
    plan = before._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and not any("Window [" in line and "[_range" not in line for line in plan.splitlines())
    total, want = 0, []
    for i in range(1000):
        want.append(total)
        total += i % 7
    assert [r.start for r in before.orderBy("part").collect()] == want
    assert I.rows_before(sizes.limit(0), "part", "n", "start").count() == 0


def test_number_files(spark):
    path = shared_dir(spark, "test")
    spark.range(0, 1000, 1, 5).write.parquet(path)
    got = I.number_files(spark, path).orderBy("id").collect()
    assert [r._row_no for r in got] == list(range(1, 1001))
    assert "Exchange hashpartitioning" not in I.number_files(spark, path)._jdf.queryExecution().executedPlan().toString()


def test_id_column(spark):
    df = spark.createDataFrame([("U001", "a"), ("U002", "b")], "user_id string, text string")
    assert I.id_from_column(df, "user_id", keep=False).columns == ["_row_id", "text"]
    with pytest.raises(SpecError, match="ID column 'x' not found in CSV. Available columns: user_id, text"):
        I.id_from_column(df, "x")


def test_requests_have_the_wire_form(spark):
    df = spark.createDataFrame([("7", 'say "hi"\n\\ é', 1, "secret")], "_row_id string, text string, n int, other string")
    spec = LabelSpec('Be "kind".', "T: {text} {{n={n}}}", PARCELS.fields, reasoning=True)
    row = build_requests(df, spec).first()
    assert json.loads(row.request) == {
        "custom_id": "row_7",
        "params": {
            "model": "claude-sonnet-4-5",
            "max_tokens": 4096,
            "messages": [
                {"role": "user", "content": [{"type": "text", "text": 'Be "kind".', "cache_control": {"type": "ephemeral"}}]},
                {"role": "user", "content": 'T: say "hi"\n\\ é {n=1}'},
            ],
            "output_format": {"type": "json_schema", "schema": spec.json_schema()},
        },
    }
    assert "secret" not in row.request
    assert list(json.loads(row.request)["params"]["output_format"]["schema"]["properties"]) == [f.name for f in spec.answer_fields]


def test_unused_columns_stay_in_the_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spec = LabelSpec("s", "{lang}", PARCELS.fields)
    plan = build_requests(I.id_from_column(docs, "doc_id"), spec)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan and "Exchange" not in plan and "Python" not in plan


def test_missing_template_column(spark):
    df = spark.createDataFrame([("1", "a")], "_row_id string, text string")
    with pytest.raises(SpecError, match="Missing columns: title"):
        build_requests(df, LabelSpec("s", "{title}", PARCELS.fields))
    with pytest.raises(SpecError, match="undefined variable: 'text'"):
        build_requests(df, LabelSpec("s", "{text}", PARCELS.fields, columns=("_row_id",)))


def test_cells(spark):
    from labelmill.functions.cells import canonical_str, double_str

    random.seed(3)
    xs = [0.0, 1.0, 123456789.0, 1e15, 9999999999999998.0, 1e16, 1e22, 1e-4, 1e-5, 0.001, 1e7, 0.1, 1 / 3, -2.5e-7, float("inf")]
    xs += [random.uniform(-1, 1) * 10 ** random.randint(-4, 15) for _ in range(3000)] + [random.uniform(-1, 1) * 1e-9 for _ in range(500)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", double_str(F.col("x")).alias("s")).collect()
    assert [(r.x, r.s) for r in got if r.s != repr(r.x)] == []
    df = spark.sql("SELECT true AS b, CAST(null AS int) AS n, CAST(0.1 AS float) AS f, TIMESTAMP '2024-03-15 09:45:00.5' AS t, DATE '2024-03-15' AS d, 12.50BD AS c")
    row = df.select(*[canonical_str(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]).first()
    assert tuple(row) == ("True", "None", repr(0.10000000149011612), "2024-03-15 09:45:00.500000", "2024-03-15", "12.50")


def test_merge(spark):
    rows = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y"), ("3", "c", "z")], "_row_id string, name string, category string")
    answers = spark.createDataFrame([("3", "C"), ("1", "A")], "_row_id string, category string")
    want = [("1", "a", "x", "A"), ("2", "b", "y", None), ("3", "c", "z", "C")]
    for way in ("keep", "error"):
        merged = M.merge_results(rows, answers, way)
        assert merged.columns == ["_row_id", "name", "category", "category_right"]
        assert sorted(merged.collect()) == want
    numeric = rows.withColumn("_row_id", F.col("_row_id").cast("bigint"))
    assert sorted(M.merge_results(numeric, answers).collect()) == want
    assert M.merge_results(rows, answers.limit(0)).filter("category_right IS NULL").count() == 3
    assert rows_of(M.unanswered_rows(rows, answers).select("_row_id")) == [("2",)]
    assert rows_of(M.answered_rows(rows, answers).select("_row_id")) == [("1",), ("3",)]


def test_merge_duplicates(spark):
    rows = spark.createDataFrame([("1",), ("2",)], "_row_id string")
    answers = spark.createDataFrame([("1", 3, "late"), ("1", 1, "early"), ("2", 2, "only")], "_row_id string, at int, a string")
    assert M.merge_results(rows, answers).count() == 3
    first = M.merge_results(rows, answers, "first", order_answers=F.col("at"))
    assert rows_of(first.select("_row_id", "a")) == [("1", "early"), ("2", "only")]
    with pytest.raises(LabelError, match="for example to 1"):
        M.merge_results(rows, answers, "error")


def test_preflight(spark):
    df = spark.createDataFrame([("U001", "a"), ("U001", "b"), ("U002", None)], "user_id string, text string")
    spec = LabelSpec("s", "{text}", PARCELS.fields, id_column="user_id")
    report = P.preflight_report(df, spec).collect()
    assert [r.status for r in report] == ["ok", "ok", "ok", "error"]
    assert report[-1].detail == "ID column 'user_id' contains duplicate values. Found 2 unique values in 3 rows."
    good = P.preflight_report(df.filter("text <> 'b'").union(df.filter("text IS NULL")), spec.replace(reasoning=True)).collect()
    assert good[-1].detail == "2 fields + 2 reasoning fields" and {r.status for r in good} == {"ok"}
    lost = P.preflight_report(df, spec.replace(columns=("text", "title"))).collect()
    assert lost[-1][1:] == ("columns", "error", "Missing columns: title")
    odd = P.preflight_report(df, spec.replace(id_column=None, template="{title}", columns=("text",))).collect()
    assert odd[-1].detail == "Template validation failed: Template references undefined variable: 'title'"
    nulls = P.preflight_report(df.withColumn("user_id", F.when(F.col("text") == "a", "x").when(F.col("text") == "b", "y")), spec).collect()
    assert nulls[-1].detail == "ID column 'user_id' has 1 rows without a value."


def test_samples(spark):
    df = spark.createDataFrame([(1, None, "x" * 51), (2, "b", "x" * 50)], "a int, b string, c string")
    assert P.sample_dict(df, ["b", "a", "nope"], order_by=["a"]) == {"b": "None", "a": "1"}
    assert P.sample_dict(df.limit(0)) == {}
    assert [tuple(r) for r in P.preview_rows(df, order_by=["a"]).collect()] == [("1", "", "x" * 47 + "..."), ("2", "b", "x" * 50)]


def test_cost(spark):
    df = spark.createDataFrame([(1, "abcd" * 10), (2, "abcd" * 30)], "id int, text string")
    spec = LabelSpec("system text", "{text}", PARCELS.fields)
    exact, first = (C.estimate_cost(df, spec, m, order_by=["id"]).first() for m in ("exact", "first_row"))
    assert (exact.avg_input_tokens, first.avg_input_tokens, exact.total_requests) == (20.0, 10.0, 2)
    assert exact.input_cost == pytest.approx(40 * 1.5 / 1e6) and first.input_cost == pytest.approx(20 * 1.5 / 1e6)
    assert exact.cache_read_cost == pytest.approx(exact.cached_tokens * 0.15 / 1e6)
    assert exact.total_cost == pytest.approx(exact.cache_write_cost + exact.cache_read_cost + exact.input_cost + exact.output_cost)
    assert C.estimate_cost(df, spec, "first_row").first().avg_input_tokens in (10.0, 30.0)
    empty = C.estimate_cost(df.limit(0), spec).first()
    assert (empty.total_cost, empty.cost_per_row, empty.total_requests, empty.cached_tokens) == (0.0, 0.0, 0, 0)
    other = spec.replace(model="other")
    with pytest.raises(LabelError, match="Unknown model: other"):
        C.estimate_cost(df, other)
    assert C.estimate_cost(df, other, on_unknown_model="fallback").first().total_cost == pytest.approx(exact.total_cost)


def test_responder_failures_become_rows(spark):
    df = spark.createDataFrame([(str(i), f"t{i}") for i in range(6)], "_row_id string, text string").coalesce(1)
    spec = LabelSpec("s", "{text}", (OutputField("n", "integer"),))

    def responder(docs):
        for i, d in enumerate(docs):
            if i == 1:
                yield ValueError("bad row")
            elif i == 2:
                yield '{"n": "2"}'
            elif i == 3:
                yield {"custom_id": "x", "result": {"type": "expired"}}
            elif i == 4:
                raise RuntimeError("service down")
            else:
                yield {"n": len(d["params"]["messages"])}

    done = Labeler(spec).collect(df, infer(build_requests(df, spec), responder))
    assert {r._row_id: (r.n, r.error) for r in done.parsed.collect()} == {
        "0": (2, None), "1": (None, "bad row"), "2": (2, None), "3": (None, "Unknown error"), "4": (None, "service down"), "5": (None, "service down"),
    }


def test_whole_job(spark):
    calls = spark.sparkContext.accumulator(0)

    def responder(docs):
        calls.add(len(docs))
        return [{"bulk": "small", "weight": 0.5} for _ in docs]

    data = [{"text": "A"}, {"text": "B"}, {"text": "C"}]
    done = Labeler(PARCELS).label(data, responder, order_by=["text"], fail_on_error=True, spark=spark)
    assert sorted(done.merged().select("_row_id", "text", "bulk").collect()) == [("1", "A", "small"), ("2", "B", "small"), ("3", "C", "small")]
    assert done.typed().columns == ["bulk", "weight"] and done.typed().count() == 3
    assert done.summary.first().success_count == 3 and done.unanswered().count() == 0
    assert calls.value == 3
    with pytest.raises(LabelError, match=r"3 row\(s\) failed"):
        Labeler(PARCELS).label(data, lambda docs: [RuntimeError("no")] * len(docs), fail_on_error=True, spark=spark)


def test_list_input(spark):
    assert S.as_input(spark, [{"a": 1, "b": 2}], ["a"]).collect() == [(1,)]
    with pytest.raises(SpecError, match="Row 0 has no column 'c'"):
        S.as_input(spark, [{"a": 1}], ["c"])
    with pytest.raises(TypeError, match="Unsupported input type"):
        S.as_input(spark, "text")


def test_typed_results_come_in_row_order(spark):
    rows = spark.createDataFrame([(str(i),) for i in range(12)], "_row_id string")
    lines = spark.createDataFrame([(ok(f"row_{i}", {"bulk": "medium", "weight": i}),) for i in (11, 2, 0, 10, 1)], "value string")
    assert [r.weight for r in Labeler(PARCELS).collect(rows, lines).typed().collect()] == [0, 1, 2, 10, 11]
    with pytest.raises(LabelError, match=r"1 row\(s\) failed"):
        Labeler(PARCELS).collect(rows, lines.union(lines.selectExpr("'x'").limit(1))).typed()


def test_batch_status(spark):
    requests = spark.range(10).select(F.concat(F.lit("row_"), "id").alias("custom_id"), F.floor(F.col("id") / 4).alias("batch_no"))
    answers = [ok(f"row_{i}", GOOD) for i in range(4)] + [envelope("row_0", {"type": "errored"}), envelope("row_4", {"type": "errored"}), envelope("row_5", {"type": "canceled"}), envelope("row_8", {"type": "expired"})]
    parsed = Labeler(PARCELS).collect(requests, spark.createDataFrame([(a,) for a in answers], "value string")).parsed
    got = {r.batch_no: tuple(r)[1:] for r in B.batch_status(requests, parsed).collect()}
    assert got[0] == ("ended", 4, 0, 4, 0, 0, 0, True, 1.0)
    assert got[1] == ("in_progress", 4, 2, 0, 1, 1, 0, False, 0.25)
    assert got[2] == ("in_progress", 2, 1, 0, 0, 0, 1, False, 0.0)


def test_batch_log_and_errors_may_be_missing(spark):
    path = shared_dir(spark, "nothing")
    assert B.batch_list(B.read_batch_log(spark, path)).count() == 0
    assert S.read_errors(spark, path).count() == 0


def test_list_rows_may_lack_what_is_not_used(spark):
    job = Labeler(LabelSpec("s", "{text}", (OutputField("a", "string"),)))
    assert rows_of(job.number([{"text": "x", "more": 1}, {"text": "y"}], spark=spark).select("text", "more")) == [("x", 1), ("y", None)]


def test_batches_with_an_id_column(spark):
    job = Labeler(LabelSpec("s", "{id}", (OutputField("a", "string"),), id_column="id", batch_size=10))
    rows = job.number(spark.range(25).selectExpr("cast(id as string) as id", "id as _source", "id as _part"))
    assert sorted(r["count"] for r in rows.groupBy("batch_no").count().collect()) == [5, 10, 10]
    assert rows.where("_row_id = id and _source = cast(id as bigint) and _part = _source").count() == 25


def test_fields_may_have_any_name(spark):
    names = ("state", "content", "raw", "error", "custom_id", "value")
    spec = LabelSpec("s", "{t}", tuple(OutputField(n, "string") for n in names))
    lines = spark.createDataFrame([(ok("row_1", {n: n for n in names}),), (ok("row_2", {}),)], "value string")
    parsed = R.parse_responses(lines, spec)
    assert [tuple(r) for r in R.answers(parsed, spec).collect()] == [("1", *names)]
    assert [(r._row_id, r.custom_id) for r in R.error_rows(parsed).collect()] == [("2", "row_2")]


def test_batch_status_of_a_row_sent_twice(spark):
    requests = spark.createDataFrame([("row_1", 0), ("row_1", 1)], "custom_id string, batch_no long")
    lines = spark.createDataFrame([(envelope("row_1", {"type": "expired"}), 0), (ok("row_1", {"a": 1}), 1)], "value string, batch_no long")
    got = {r.batch_no: (r.succeeded, r.expired) for r in B.batch_status(requests, B.response_states(lines)).collect()}
    assert got == {0: (0, 1), 1: (1, 0)}


def test_responder_edges(spark):
    requests = spark.createDataFrame([("row_1", "{}"), ("row_2", "{}")], "custom_id string, request string").coalesce(1)

    def errors(responder):
        return [json.loads(r.value)["result"]["type"] for r in infer(requests, responder, partitions=1).collect()]

    assert errors(lambda docs: [object(), "fine"]) == ["errored", "succeeded"] or errors(lambda docs: [object(), "fine"]) == ["succeeded", "errored"]
    assert errors(lambda docs: ["a", "b", "c"]) == ["errored", "errored"]
