"""Hot ids, one-pass collecting, the answers table and asking again."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelmill import Labeler, LabelError, LabelSpec, OutputField, SpecError
from labelmill.functions.constraints import violations
from labelmill.operators import hot as H
from labelmill.operators import merge as M
from labelmill.operators import responses as R
from labelmill.session import shared_dir
from labelmill.streaming import rounds as T
from tests.test_responses import GOOD, PARCELS, envelope, ok


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("equal", [True, False])
def test_hot_answers_are_split_and_none_lost(spark, equal):
    value = F.lit(1) if equal else F.col("id")
    answers = spark.range(0, 6000, 1, 6).select(F.when(F.col("id") % 2 == 0, "7").when(F.col("id") % 7 > 0, (F.col("id") % 500).cast("string")).alias("_row_id"), value.alias("v"))
    rows = spark.createDataFrame([(i, k) for i in [None, 7, *range(300, 700)] for k in range(1 + (i == 7))], "_row_id long, k int")
    got = M.merge_results(rows, answers)
    want = rows.withColumn("_row_id", F.col("_row_id").cast("string")).join(answers, "_row_id", "left")
    assert rows_of(got) == rows_of(want)
    path = shared_dir(spark, "hot")
    seen = H.written(answers, path, F.col("_row_id"))
    assert seen["rows"] == seen["all"] == 6000 and H.hot_ids(seen, 10) == {"7": 6}
    spread = M.merge_stored(rows, spark.read.parquet(path), {"7": 5})
    assert "_salt" in plan(spread) and rows_of(spread) == rows_of(want)
    dealt = spark.read.parquet(path).where("_row_id = '7'").groupBy(F.pmod(F.col("_metadata.row_index"), F.lit(5))).count().collect()
    assert len(dealt) == 5 and max(r["count"] for r in dealt) < 1000
    fresh = plan(M.merge_results(rows, answers))
    assert "Union" not in fresh and fresh.count("FileScan parquet") == 1 and "Range" not in fresh  # the answers as written; the rows are a local table here


def test_hot_ids_without_rows(spark):
    nothing = spark.createDataFrame([], "_row_id string, v int")
    rows = spark.createDataFrame([("1",)], "_row_id string")
    assert M.merge_results(rows, nothing).collect()[0][:] == ("1", None) and M.merge_results(rows.limit(0), nothing).count() == 0
    only_null = spark.createDataFrame([(None, 1)] * 9, "_row_id string, v int")
    assert H.hot_ids(H.written(only_null, shared_dir(spark, "hot"), F.col("_row_id")), 4) == {}


def test_collect_reads_responses_once(spark):
    lines = [ok("row_1", GOOD), ok("row_1", GOOD), envelope("row_2", {}), ok("row_3", {"bulk": "bad", "weight": 1})]
    rows = spark.createDataFrame([(str(i),) for i in range(1, 5)], "_row_id string")
    source = shared_dir(spark, "lines")
    spark.createDataFrame([(v,) for v in lines], "value string").write.text(source)
    done = Labeler(PARCELS).collect(rows, source)
    for view in (done.answers, done.errors, done.merged(), done.unanswered(), done.answered(), done.summary):
        assert "variant" not in plan(view) and source not in plan(view)  # nothing is parsed again
    assert "FileScan" in plan(done.answers) and "FileScan" not in plan(done.summary)
    assert done.summary.first()[:3] == (2, 2, 4)
    assert [r._row_id for r in done.merged().where("bulk is not null").collect()] == ["1", "1"]
    assert sorted(r._row_id for r in done.errors.collect()) == ["2", "3"] and sorted(r._row_id for r in done.unanswered().collect()) == ["2", "3", "4"]
    with pytest.raises(LabelError, match="2 row"):
        done.require_all()
    empty = Labeler(PARCELS).collect(rows, spark.createDataFrame([], "value string"))
    assert empty.summary.first()[:3] == (0, 0, 0) and empty.merged().count() == 4


def parsed(spark, lines):
    return R.parse_responses(spark.createDataFrame([(v,) for v in lines], "value string"), PARCELS)


def test_rounds_are_added_once_and_seen_whole(spark):
    path = shared_dir(spark, "table")
    assert T.read_log(spark, path) == [] and T.compact(spark, path) == 0
    with pytest.raises(LabelError, match="No rounds"):
        T.history(spark, path)
    first = parsed(spark, [ok("row_1", GOOD), envelope("row_2", {}), envelope("row_3", {})])
    assert T.add_round(first, path, "a", 0) and not T.add_round(parsed(spark, [ok("row_9", GOOD)]), path, "a", 0)
    # A round that broke off before its entry: its data are not seen, and it can be run again.
    first.withColumn("_round", F.lit(0)).withColumn("_stream", F.lit("x")).write.parquet(f"{path}/data/torn")
    assert T.add_round(parsed(spark, [ok("row_2", GOOD), envelope("row_1", {})]), path, "b", 0)
    assert T.history(spark, path).count() == 5
    best = {r._row_id: (r.bulk, r.error) for r in T.current(T.history(spark, path)).collect()}
    assert best == {"1": ("small", None), "2": ("small", None), "3": (None, "No result in response")}
    assert T.compact(spark, path) == 2 and T.compact(spark, path) == 0
    assert T.history(spark, path).count() == 3 and not T.add_round(first, path, "b", 0)
    later = parsed(spark, [ok("row_1", GOOD | {"bulk": "large"}), ok("row_3", GOOD)])
    assert T.add_round(later, path, "a", 1)
    best = {r._row_id: r.bulk for r in T.current(T.history(spark, path)).collect()}
    assert best == {"1": "large", "2": "small", "3": "small"}
    with pytest.raises(LabelError, match="Reserved"):
        T.add_round(first.withColumn("_stream", F.lit(1)), path, "c", 0)


def test_compactions_side_by_side_lose_nothing(spark):
    path = shared_dir(spark, "table")
    for i in range(3):
        T.add_round(parsed(spark, [ok(f"row_{i}", GOOD)]), path, "a", i)
    old = T.read_log(spark, path)
    T.compact(spark, path)
    # Another one that saw the same rounds, and ended later.
    folder = f"{path}/data/other"
    T.current(spark.read.parquet(*[e.folder for e in old])).write.parquet(folder)
    T._publish(spark, path, T.Entry("compacted-other", folder, tuple(e.name for e in old)))
    assert sorted(r._row_id for r in T.current(T.history(spark, path)).collect()) == ["0", "1", "2"]
    T.compact(spark, path)
    assert T.history(spark, path).count() == 3


def test_batches_and_missing_ids_are_told_apart(spark):
    rows = [("1", 1, "a"), ("1", 2, "b"), ("1", 2, "c"), (None, 1, "d"), (None, 1, "e")]
    df = spark.createDataFrame([(*r, None, 5, "s") for r in rows], "_row_id string, batch_no long, v string, error string, _round long, _stream string")
    assert Counter((r._row_id, r.batch_no) for r in T.current(df).collect()) == {("1", 1): 1, ("1", 2): 1, (None, 1): 2}


COUNT = LabelSpec("Count.", "{text}", (OutputField("chars", "integer"),), id_column="id")


def test_rows_are_asked_again_by_rule(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def responder(number):
        def answer(docs):
            for d in docs:
                i = int(d["custom_id"].removeprefix("row_"))
                with open(log / f"{number}-{i}", "a") as f:
                    f.write("x")
                failed = {1: RuntimeError("busy"), 2: "not json", 3: {"chars": "no"}, 4: {"result": {"type": "canceled"}}}.get(i % 6)
                yield failed if failed is not None and (number < 2 or i > 50) else {"chars": i}

        return answer

    docs = spark.createDataFrame([(i, "t") for i in range(12)] + [(60 + i, "t") for i in range(6)], "id long, text string")
    job, folder = Labeler(COUNT), shared_dir(spark, "rounds")
    rows = job.number(docs)
    done = job.label_rounds(rows, responder, limits={"service": 3, "unreadable": 2, "misfit": 3, "canceled": 1}, folder=folder)
    asked = Counter(int(f.name.split("-")[1]) for f in log.iterdir() for _ in f.read_text())
    want = {i: {1: 3, 2: 2, 3: 3}.get(i % 6, 1) for i in [*range(12), *range(60, 66)]}
    assert asked == want and Counter(int(r._row_id) for r in done.attempts.collect()) == want
    good = {int(r._row_id): r.chars for r in done.answers.collect()}
    assert good == {i: i for i in want if i % 6 in (0, 5) or (i < 50 and i % 6 in (1, 3))}
    assert {(int(r._row_id) % 6, r.kind) for r in done.attempts.where("error is not null").collect()} == {(1, "service"), (2, "unreadable"), (3, "misfit"), (4, "canceled")}
    assert done.summary.first().total == 18 and done.merged().count() == 18
    # The same job once more: everything is there, nobody is asked.
    again = job.label_rounds(rows, responder, limits={"service": 3, "unreadable": 2, "misfit": 3, "canceled": 1}, folder=folder)
    assert rows_of(again.answers) == rows_of(done.answers) and sum(len(f.read_text()) for f in log.iterdir()) == sum(want.values())
    with pytest.raises(SpecError, match="Unknown kinds"):
        job.label_rounds(docs, responder, limits={"bad": 1})
    assert job.label_rounds(docs.limit(0), responder).merged().count() == 0


def test_reserved_names():
    with pytest.raises(SpecError, match="Reserved"):
        LabelSpec("s", "t", (OutputField("_Round", "string"),))


def broken(value, field, path):
    """Broken constraints of a value, by the rules."""
    if value is None:
        return []
    if field.type == "object":
        return [t for f in field.fields for t in broken(value[f.name], f, f"{path}.{f.name}")]
    if field.type == "array":
        return [t for i, v in enumerate(value) for t in broken(v, field.items, f"{path}[{i}]")]
    out = [f"{path} is not one of the allowed values"] if field.enum and value not in field.enum else []
    return out + ([f"{path} is below {field.minimum}"] if field.minimum is not None and value < field.minimum else [])


def test_nested_constraints(spark):
    inner = OutputField("o", "object", fields=(OutputField("n", "integer", minimum=3), OutputField("e", "string", enum=("a", "b")), OutputField("free", "string")))
    fields = (OutputField("top", "integer", minimum=1), OutputField("list", "array", items=OutputField("item", "array", items=inner)), inner, OutputField("plain", "array", items=OutputField("x", "string")))
    rng = random.Random(1)

    def make(f):
        if rng.random() < 0.15:
            return None
        if f.type == "object":
            return {g.name: make(g) for g in f.fields}
        if f.type == "array":
            return [make(f.items) for _ in range(rng.randrange(3))]
        return rng.randrange(6) if f.type == "integer" else rng.choice("abc")

    rows = [{f.name: make(f) for f in fields} for _ in range(200)]
    schema = "top long, list array<array<struct<n: long, e: string, free: string>>>, o struct<n: long, e: string, free: string>, plain array<string>, i int"
    df = spark.createDataFrame([tuple(r[f.name] for f in fields) + (i,) for i, r in enumerate(rows)], schema)
    got = {r.i: r.v for r in df.select("i", violations(fields).alias("v")).collect()}
    assert got == {i: [t for f in fields for t in broken(r[f.name], f, f.name)] for i, r in enumerate(rows)}


def test_bounds_hold_by_default_in_strict_mode(spark):
    spec = LabelSpec("s", "{t}", (OutputField("score", "integer", minimum=1, maximum=5), OutputField("keys", "array", items=OutputField("k", "number", exclusive_minimum=0))))
    lines = spark.createDataFrame([(ok("row_1", {"score": 9, "keys": [1, 0]}),), (ok("row_2", {"score": 5, "keys": [2]}),)], "value string")
    assert {r._row_id: r.error for r in R.parse_responses(lines, spec).collect()} == {"1": "score is above 5; keys[1] is not above 0", "2": None}
    assert R.parse_responses(lines, spec, mode="loose").where("error is not null").count() == 0
    assert R.parse_responses(lines, spec, check_bounds=False).where("error is not null").count() == 0
