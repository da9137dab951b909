"""The conformance rules against a lax validator, value by value."""

import json
import re
from typing import Literal, Optional

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from labelmill.operators.responses import parse_responses
from labelmill.spec import LabelSpec, OutputField, fields_from_class
from tests.test_responses import ok

pydantic = pytest.importorskip("pydantic")

VALUES = [
    5, 0, 1, 2, -3, 5.0, 5.5, 1.0, 0.0, 0.5, 1e2, 1e20, 2**62, True, False, None, [], {}, [1], {"a": 1},
    "5", " 5 ", "5.0", "5.00", "5.", ".0", "05", "-05", "+5", "1_000", "1__0", "_1", "1_", "5.5", "0x5", "1e2", "", "1_0.0", "- 5",
    "\t5\n", " 5", "000", "-0", "1_000.00", "5.0_0", "５", "nan", "NaN", "inf", "-Infinity", "+inf", "infinity", "iNf", "+nan",
    "-nan", "1e5", "1E5", ".5", "+.5", "1_0.5", "1e400", "e5", "5f", "5d", "1.5e-3", "true", "TRUE", "t", "yes", "on", "y", "off", "f", "n", "no",
    "false", " true", "tRuE", "01", "1.0", "0", "1", "2", "a", "A", "b", " a",
    [1, 2], [1, None], [1, 2.5], ["1", 2], [1.5, 2.5], {"a": 1, "b": "x"}, {"a": "1", "b": "x"}, {"a": 1}, {"a": 1, "b": None}, {"a": 1, "b": "x", "c": 2},
    {"a: BIGINT, b": "x"}, {"a": 1.0, "b": ""}, {"A": 1, "b": "x"},
]

class Pair(pydantic.BaseModel):
    a: int
    b: str


KINDS = {
    "integer": (int, {}),
    "number": (float, {}),
    "string": (str, {}),
    "boolean": (bool, {}),
    "enum_text": (Literal["a", "b"], {}),
    "enum_int": (Literal[1, 2, 3], {}),
    "enum_num": (Literal[0.5, 2.0], {}),
    "optional": (Optional[int], {}),
    "ints": (list[int], {}),
    "numbers": (list[float], {}),
    "pair": (Pair, {}),
}


def model(hint):
    return pydantic.create_model("Model", x=(hint, ...))


def expected(m, value):
    try:
        return True, m.model_validate({"x": value}).x
    except pydantic.ValidationError:
        return False, None


def same(a, b):
    if isinstance(b, pydantic.BaseModel):
        return a.asDict() == b.model_dump()
    return type(a) is type(b) and (a == b or (a != a and b != b))


def check(spark, hint, values):
    m = model(hint)
    spec = LabelSpec("s", "{t}", fields_from_class(m))
    df = spark.createDataFrame([(i, ok(f"row_{i}", {"x": v})) for i, v in enumerate(values)], "n int, value string")
    got = {r.n: r for r in parse_responses(df, spec).collect()}
    wrong = []
    for i, v in enumerate(values):
        good, value = expected(m, v)
        if (got[i].error is None) != good or (good and not same(got[i].x, value)):
            wrong.append((v, good, value, got[i].error, got[i].x))
    assert not wrong[:3]


@pytest.mark.parametrize("kind", KINDS)
def test_values(spark, kind):
    check(spark, KINDS[kind][0], VALUES)


NUMBERISH = st.text(alphabet="0159.+-_eE \tinfa", max_size=7)


@pytest.mark.parametrize("hint", [int, float, bool])
@settings(max_examples=4, deadline=None, derandomize=True, database=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(values=st.lists(NUMBERISH, min_size=200, max_size=300))
def test_texts(spark, hint, values):
    # The validator takes a sign after zeros and an underscore, which is no number anywhere else.
    check(spark, hint, [v for v in values if not re.search("0_+[+-]", v)])


@settings(max_examples=2, deadline=None, derandomize=True, database=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.one_of(st.floats(allow_nan=False, allow_infinity=False), st.integers(-(2**62), 2**62)), min_size=100, max_size=200))
def test_numbers(spark, values):
    check(spark, float, [v for v in values if v != 0])


def test_missing_default_and_null(spark):
    fields = (
        OutputField("a", "integer"),
        OutputField("b", "integer", required=False, default=7),
        OutputField("c", "string", required=False, nullable=True),
    )
    docs = [{"a": 1}, {"a": 1, "b": None}, {"a": 1, "c": None}, {"b": 1}]
    df = spark.createDataFrame([(i, ok(f"row_{i}", d)) for i, d in enumerate(docs)], "n int, value string")
    got = {r.n: (r.error, r.a, r.b, r.c) for r in parse_responses(df, LabelSpec("s", "{t}", fields)).collect()}
    assert got[0] == (None, 1, 7, None)
    assert got[1][0] == "Field b: null is not allowed"
    assert got[2] == (None, 1, 7, None)
    assert got[3][0] == "Field a: missing"


class Part(pydantic.BaseModel):
    word: str
    weight: float


class Whole(pydantic.BaseModel):
    parts: list[Part]
    main: Part


NESTED = [
    {"parts": [{"word": "a: STRING, weight", "weight": 1}], "main": {"a: STRING, weight": 1}},
    {"parts": [], "main": {"word: STRING, weight": 2, "extra": 1}},
    {"parts": [], "main": {"word": "b", "weight": 2, "extra": 1}},
    {"parts": [{"word": "a", "weight": 1}], "main": {"word": "b", "weight": "2"}},
    {"parts": [], "main": {"word": "b", "weight": 2.5}},
    {"parts": [{"word": "a", "weight": 1}, {"word": 3, "weight": 1}], "main": {"word": "b", "weight": 2}},
    {"parts": [{"word": "a", "weight": 1}, None], "main": {"word": "b", "weight": 2}},
    {"parts": {}, "main": {"word": "b", "weight": 2}},
    {"parts": [], "main": {"word": "b"}},
    {"parts": [], "main": []},
    {"parts": []},
]


def test_nested(spark):
    spec = LabelSpec("s", "{t}", fields_from_class(Whole))
    df = spark.createDataFrame([(i, ok(f"row_{i}", d)) for i, d in enumerate(NESTED)], "n int, value string")
    got = {r.n: r for r in parse_responses(df, spec).collect()}
    for i, d in enumerate(NESTED):
        try:
            want = Whole.model_validate(d)
        except pydantic.ValidationError:
            want = None
        assert (got[i].error is None) == (want is not None), (d, got[i].error)
        if want is not None:
            row = got[i].asDict(recursive=True)
            assert {"parts": row["parts"], "main": row["main"]} == json.loads(want.model_dump_json())
