import json

import pytest
from pyspark.sql import functions as F

from labelmill.errors import LabelError
from labelmill.operators.responses import answers, error_rows, parse_responses, require_all, results_summary
from labelmill.spec import LabelSpec, OutputField

PARCELS = LabelSpec(
    system="You sort parcels.",
    template="Parcel: {text}",
    fields=(
        OutputField("bulk", "string", "How bulky", enum=("small", "large", "medium")),
        OutputField("weight", "number", "In kilograms"),
    ),
)


def ok(cid, text):
    text = text if isinstance(text, str) else json.dumps(text)
    return json.dumps({"custom_id": cid, "result": {"type": "succeeded", "message": {"content": [{"type": "text", "text": text}]}}})


def envelope(cid, result):
    return json.dumps({"custom_id": cid, "result": result})


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


GOOD = {"bulk": "small", "weight": 0.9}

TAXONOMY = [
    ("not json", "Malformed record"),
    (ok("row_0", GOOD) + " trailing", "Malformed record"),
    ("[1]", "Malformed record"),
    (json.dumps({"custom_id": "row_1"}), "No result in response"),
    (envelope("row_1", {}), "No result in response"),
    (envelope("row_1", None), "No result in response"),
    (envelope("row_1", []), "No result in response"),
    (envelope("row_2", {"type": "error", "error": {"message": "Rate limit exceeded"}}), "Rate limit exceeded"),
    (envelope("row_2", {"type": "errored", "error": {"type": "error", "error": {"message": "Overloaded"}}}), "Overloaded"),
    (envelope("row_2", {"type": "expired"}), "Unknown error"),
    (envelope("row_2", {"type": "canceled", "error": None}), "Unknown error"),
    (envelope("row_2", {"message": {"content": [{"text": json.dumps(GOOD)}]}}), "Unknown error"),
    (envelope("row_3", {"type": "succeeded"}), "No message in result"),
    (envelope("row_3", {"type": "succeeded", "message": {}}), "No message in result"),
    (envelope("row_4", {"type": "succeeded", "message": {"role": "assistant"}}), "Empty content in message"),
    (envelope("row_4", {"type": "succeeded", "message": {"content": []}}), "Empty content in message"),
    (envelope("row_4", {"type": "succeeded", "message": {"content": [{}]}}), "Failed to parse JSON"),
    (ok("row_5", "plain words"), "Failed to parse JSON"),
    (ok("row_5", ""), "Failed to parse JSON"),
    (ok("row_5", '{"bulk": "small", "weight": 1} {"a": 1}'), "Failed to parse JSON"),
    (ok("row_5", '{"bulk": "small", "weight": 1}, {"a": 1}'), "Failed to parse JSON"),
    (ok("row_5", '{"bulk": "small", "weight": 1}] x'), "Failed to parse JSON"),
    (ok("row_6", [1, 2]), "Answer is not a JSON object"),
    (ok("row_6", "5"), "Answer is not a JSON object"),
    (ok("row_6", "null"), "Answer is not a JSON object"),
    (ok("row_7", {"bulk": "small"}), "Field weight: missing"),
    (ok("row_7", {"bulk": "POSITIVE", "weight": None}),
     "Field bulk: not one of the allowed values; Field weight: null is not allowed"),
    (ok("row_7", {"bulk": 1, "weight": "high"}), "Field bulk: not a string; Field weight: not a number"),
    (ok("row_8", GOOD), None),
    (ok("row_8", " \n" + json.dumps(GOOD) + " "), None),
]


def test_taxonomy(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(TAXONOMY)], "n int, value string")
    got = {r.n: r for r in parse_responses(df, PARCELS).collect()}
    for i, (value, error) in enumerate(TAXONOMY):
        assert got[i].error == error, value
        if error is None:
            assert (got[i].bulk, got[i].weight, got[i].raw) == ("small", 0.9, None)
        else:
            assert (got[i].bulk, got[i].weight, got[i].raw) == (None, None, value)


def test_blank_lines_are_skipped(spark):
    df = lines(spark, ["", "   ", "\t", ok("row_1", GOOD)])
    assert parse_responses(df, PARCELS).count() == 1


def test_unreadable_content_is_cut(spark):
    row = parse_responses(lines(spark, [ok("row_1", "é" * 300)]), PARCELS).first()
    assert row.error == "Failed to parse JSON" and row.content == "é" * 200


def test_ids(spark):
    got = parse_responses(lines(spark, [ok("row_my_row_3", GOOD), ok("SF001", GOOD), ok("row_REC-001", GOOD)]), PARCELS)
    assert {r._row_id for r in got.collect()} == {"my_row_3", "SF001", "REC-001"}


def test_undeclared_fields(spark):
    df = lines(spark, [ok("row_1", GOOD | {"bulk_reasoning": "because", "n": 3})])
    strict = parse_responses(df, PARCELS).first()
    assert strict.error is None and "bulk_reasoning" not in strict
    loose = parse_responses(df, PARCELS, mode="loose").select(F.to_json("_extra").alias("x")).first()
    assert json.loads(loose.x) == {"bulk_reasoning": "because", "n": 3}


def test_loose_mode_rejects_no_answer(spark):
    df = lines(spark, [ok("row_1", {"bulk": 5, "weight": "0.5"}), ok("row_2", {"weight": "x"}), ok("row_3", GOOD)])
    got = {r._row_id: r for r in parse_responses(df, PARCELS, mode="loose").collect()}
    assert [got[i].error for i in "123"] == [None] * 3
    assert (got["1"].bulk, got["1"].weight) == ("5", 0.5)
    assert (got["2"].bulk, got["2"].weight) == (None, None)
    assert got["3"]._extra is None


def test_reasoning_columns(spark):
    spec = PARCELS.replace(reasoning=True)
    full = GOOD | {"bulk_reasoning": "a", "weight_reasoning": "b"}
    parsed = parse_responses(lines(spark, [ok("row_1", full), ok("row_2", GOOD)]), spec)
    assert parsed.columns[1:6] == ["custom_id", "bulk", "bulk_reasoning", "weight", "weight_reasoning"]
    got = {r._row_id: r.error for r in parsed.collect()}
    assert got["1"] is None and "bulk_reasoning: missing" in got["2"]
    assert answers(parsed, spec).columns == ["_row_id", "bulk", "bulk_reasoning", "weight", "weight_reasoning"]
    assert answers(parsed, spec, keep_reasoning=False).columns == ["_row_id", "bulk", "weight"]


def test_bounds(spark):
    spec = LabelSpec("s", "{t}", (OutputField("score", "integer", minimum=1, maximum=5),))
    df = lines(spark, [ok("row_1", {"score": 5}), ok("row_2", {"score": 6})])
    assert parse_responses(df, spec, check_bounds=False).filter("error is not null").count() == 0
    got = {r._row_id: r.error for r in parse_responses(df, spec).collect()}
    assert got == {"1": None, "2": "score is above 5"}


def test_split_and_summary(spark):
    parsed = parse_responses(lines(spark, [ok("row_0", GOOD), ok("row_1", "x"), ok("row_2", GOOD), envelope("row_3", {"type": "expired"})]), PARCELS)
    assert sorted(r._row_id for r in answers(parsed, PARCELS).collect()) == ["0", "2"]
    assert sorted((r._row_id, r.error) for r in error_rows(parsed).collect()) == [("1", "Failed to parse JSON"), ("3", "Unknown error")]
    assert results_summary(parsed).first()[:] == (2, 2, 4, 50.0, 50.0)
    with pytest.raises(LabelError, match=r"2 row\(s\) failed"):
        require_all(parsed)
    empty = parsed.limit(0)
    assert results_summary(empty).first()[:] == (0, 0, 0, 0.0, 0.0)
    require_all(empty)


def test_each_text_is_parsed_once(spark):
    parsed = parse_responses(lines(spark, [ok("row_0", GOOD)]), PARCELS)
    for df in (parsed, answers(parsed, PARCELS), error_rows(parsed)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("parse_json") <= 2, plan
        assert "Python" not in plan and "Exchange" not in plan
