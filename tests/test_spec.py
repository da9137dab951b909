import json
from dataclasses import dataclass
from typing import Literal, Optional

import pytest
from pyspark.sql import types as T

from labelmill import LabelSpec, OutputField, SpecError, fields_from_class, fields_from_struct, spec_from_dict
from labelmill.functions.template import check_template, template_columns
from labelmill.functions.tokens import cached_tokens, output_tokens, text_tokens


def spec(*fields, **args):
    return LabelSpec(system="s", template="{text}", fields=fields, **args)


def test_json_schema():
    doc = spec(
        OutputField("category", "string", "The category", enum=("a", "b")),
        OutputField("score", "integer", "From 1 to 5", minimum=1, maximum=5),
        OutputField("weight", "number", "0 to 1"),
        OutputField("valid", "boolean", "Valid"),
    ).json_schema()
    assert doc == {
        "type": "object",
        "properties": {
            "category": {"type": "string", "description": "The category", "enum": ["a", "b"]},
            "score": {"type": "integer", "description": "From 1 to 5"},
            "weight": {"type": "number", "description": "0 to 1"},
            "valid": {"type": "boolean", "description": "Valid"},
        },
        "required": ["category", "score", "weight", "valid"],
        "additionalProperties": False,
    }


def test_reasoning_order():
    fields = OutputField("a", "string"), OutputField("b", "integer")
    assert list(spec(*fields, reasoning=True).json_schema()["properties"]) == ["a", "a_reasoning", "b", "b_reasoning"]
    doc = spec(*fields, reasoning=True, reasoning_order="appended").json_schema()
    assert doc["required"] == ["a", "b", "a_reasoning", "b_reasoning"]
    assert doc["properties"]["b_reasoning"] == {"type": "string", "description": "Reasoning for b"}


@pytest.mark.parametrize("bad", [
    lambda: OutputField("a", "text"),
    lambda: OutputField("a", "integer", enum=("x",)),
    lambda: OutputField("a", "string", minimum=1),
    lambda: OutputField("a", "object"),
    lambda: OutputField("a", "integer", multiple_of=0),
    lambda: spec(),
    lambda: spec(OutputField("a", "string"), OutputField("A", "string")),
    lambda: spec(OutputField("a", "string"), batch_size=0),
    lambda: spec(OutputField("a", "string"), batch_size=100_001),
    lambda: spec(OutputField("a", "string"), OutputField("a_reasoning", "string"), reasoning=True),
])
def test_bad_specs(bad):
    with pytest.raises(SpecError):
        bad()


def test_from_dict():
    doc = {
        "settings": {"reasoning": True, "model": "m"},
        "input": {"columns": ["text"], "id_column": "k"},
        "prompt": {"system": "s", "template": "{text}"},
        "output": {"fields": [{"name": "a", "type": "integer", "description": "d", "enum": [1, 2, 3]}]},
    }
    got = spec_from_dict(doc)
    assert (got.model, got.reasoning, got.batch_size, got.columns, got.id_column) == ("m", True, 10_000, ("text",), "k")
    assert got.fields[0].enum == (1, 2, 3)
    with pytest.raises(SpecError, match="unknown type"):
        spec_from_dict(doc | {"output": {"fields": [{"name": "a", "type": "date"}]}})
    with pytest.raises(SpecError, match="Missing sections: prompt"):
        spec_from_dict({k: v for k, v in doc.items() if k != "prompt"})
    with pytest.raises(SpecError, match="needs 'columns'"):
        spec_from_dict(doc | {"input": {}})
    with pytest.raises(SpecError, match="needs 'type'"):
        spec_from_dict(doc | {"output": {"fields": [{"name": "a"}]}})


def test_from_struct():
    schema = T.StructType([
        T.StructField("a", T.StringType(), False, {"description": "A", "enum": ["x", "y"]}),
        T.StructField("b", T.LongType(), True, {"minimum": 1}),
        T.StructField("c", T.ArrayType(T.DoubleType(), False), False),
    ])
    a, b, c = fields_from_struct(schema)
    assert (a.type, a.enum, a.required) == ("string", ("x", "y"), True)
    assert (b.type, b.minimum, b.required, b.nullable) == ("integer", 1, False, True)
    assert c.items.type == "number" and not c.items.nullable
    with pytest.raises(SpecError):
        fields_from_struct(T.StructType([T.StructField("d", T.DateType())]))


def test_from_class():
    @dataclass
    class Answer:
        mood: Literal["good", "bad"]
        rating: Literal[1, 2, 3]
        title: str
        score: Optional[float]
        count: int = 3

    mood, rating, title, score, count = fields_from_class(Answer)
    assert mood.json_schema() == {"type": "string", "enum": ["good", "bad"]}
    assert rating.json_schema() == {"type": "integer", "enum": [1, 2, 3]}
    assert title.name == "title" and title.required
    assert score.nullable and score.required
    assert (count.required, count.default) == (False, 3)


def test_templates():
    assert template_columns("From {sender} to {city}") == ["sender", "city"]
    assert template_columns("{unit}/{unit}") == ["unit"]
    assert template_columns("Set {{braces}}") == []
    assert check_template("{a} {b}", ["a"]) == (False, "Template references undefined variable: 'b'")
    assert check_template("{a}", ["a"]) == (True, "")
    for bad in ("{", "{a!r}", "{a:>5}", "{a.b}", "{a[0]}", "{}"):
        assert check_template(bad, ["a"])[0] is False


def test_token_counts():
    assert [text_tokens(t) for t in ("", "abc", "abcd" * 5)] == [1, 1, 5]
    one = spec(OutputField("a", "string"), OutputField("b", "string"))
    assert output_tokens(one) == 100 and output_tokens(one.replace(reasoning=True)) == 300
    assert cached_tokens(one) == 1 + len(json.dumps(one.json_schema())) // 4
