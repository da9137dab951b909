"""What a labelling job asks for: output fields, prompt, model settings.

Specs are small driver-side objects. Operators turn them into column expressions and literals; no spec object is ever shipped to
executors.
"""

from __future__ import annotations

import enum
import json
import types as pytypes
import typing
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from labelmill.errors import SpecError

# Names of the scalar output types, and the Spark type each one becomes.
SCALAR_TYPES: dict[str, T.DataType] = {
    "integer": T.LongType(),
    "number": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
}

# Job defaults, and the largest batch the labelling service takes.
DEFAULT_MODEL = "claude-sonnet-4-5"
DEFAULT_BATCH_SIZE = 10_000
MAX_BATCH_SIZE = 100_000
MAX_TOKENS = 4096

REASONING_SUFFIX = "_reasoning"

#: Columns of the results that no answer field can stand for.
RESERVED = ("_row_id", "_is_good", "_round", "_round_no", "_stream")

_BOUNDS = ("minimum", "maximum", "exclusive_minimum", "exclusive_maximum", "multiple_of")


@dataclass(frozen=True)
class OutputField:
    """One field of the answer.

    ``type`` is a scalar type name, ``object`` (with ``fields``) or ``array`` (with ``items``). Bounds are checked by
    ``functions.constraints`` and are not part of the schema sent to the service, which does not accept them.
    """

    name: str
    type: str
    description: str | None = None
    enum: tuple[Any, ...] | None = None
    minimum: float | None = None
    maximum: float | None = None
    exclusive_minimum: float | None = None
    exclusive_maximum: float | None = None
    multiple_of: float | None = None
    required: bool = True
    nullable: bool = False
    default: Any = None
    fields: tuple[OutputField, ...] = ()
    items: OutputField | None = None

    def __post_init__(self) -> None:
        if self.type not in SCALAR_TYPES and self.type not in ("object", "array"):
            raise SpecError(f"Field '{self.name}': unknown type '{self.type}'")
        if self.type == "object" and not self.fields:
            raise SpecError(f"Field '{self.name}': an object needs fields")
        if self.type == "array" and self.items is None:
            raise SpecError(f"Field '{self.name}': an array needs items")
        if self.multiple_of is not None and self.multiple_of <= 0:
            raise SpecError(f"Field '{self.name}': multiple_of must be positive")
        if self.has_bounds and self.type not in ("integer", "number"):
            raise SpecError(f"Field '{self.name}': bounds need a numeric type")
        if self.enum is not None:
            object.__setattr__(self, "enum", tuple(self.enum))
            self._check_enum()
        object.__setattr__(self, "fields", tuple(self.fields))

    def _check_enum(self) -> None:
        wanted = {"string": str, "boolean": bool, "integer": int, "number": (int, float)}.get(self.type)
        if not self.enum or wanted is None:
            raise SpecError(f"Field '{self.name}': enum needs a scalar type and at least one value")
        for v in self.enum:
            if not isinstance(v, wanted) or (self.type != "boolean" and isinstance(v, bool)):
                raise SpecError(f"Field '{self.name}': enum value {v!r} is not of type {self.type}")

    @property
    def has_bounds(self) -> bool:
        return any(getattr(self, b) is not None for b in _BOUNDS)

    @property
    def spark_type(self) -> T.DataType:
        if self.type == "object":
            return T.StructType([T.StructField(f.name, f.spark_type, True) for f in self.fields])
        if self.type == "array":
            return T.ArrayType(self.items.spark_type, True)
        return SCALAR_TYPES[self.type]

    def json_schema(self) -> dict[str, Any]:
        """The field as JSON schema, with the keys in the order type, description, enum."""
        doc: dict[str, Any] = {"type": self.type}
        if self.description is not None:
            doc["description"] = self.description
        if self.enum:
            doc["enum"] = list(self.enum)
        if self.type == "object":
            doc.update(_object_schema({f.name: f.json_schema() for f in self.fields}, [f.name for f in self.fields if f.required]))
        elif self.type == "array":
            doc["items"] = self.items.json_schema()
        if self.nullable:
            inner = {k: v for k, v in doc.items() if k != "description"}
            doc = {"anyOf": [inner, {"type": "null"}]} | ({"description": self.description} if self.description else {})
        return doc


def _object_schema(properties: dict[str, Any], required: list[str]) -> dict[str, Any]:
    return {"type": "object", "properties": properties, "required": required, "additionalProperties": False}


@dataclass(frozen=True)
class LabelSpec:
    """A whole job: prompt, output fields, model settings.

    ``reasoning_order`` places the ``<field>_reasoning`` strings right after their field (``"interleaved"``) or all at the end
    (``"appended"``). It matters to the model, which fills the fields in order, and to the column order of the results.
    """

    system: str
    template: str
    fields: tuple[OutputField, ...]
    model: str = DEFAULT_MODEL
    reasoning: bool = False
    reasoning_order: str = "interleaved"
    batch_size: int = DEFAULT_BATCH_SIZE
    max_tokens: int = MAX_TOKENS
    columns: tuple[str, ...] | None = None
    id_column: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "fields", tuple(self.fields))
        if self.columns is not None:
            object.__setattr__(self, "columns", tuple(self.columns))
        if not self.fields:
            raise SpecError("A spec needs at least one output field")
        if not 1 <= self.batch_size <= MAX_BATCH_SIZE:
            raise SpecError(f"batch_size must be between 1 and {MAX_BATCH_SIZE}")
        if self.reasoning_order not in ("interleaved", "appended"):
            raise SpecError("reasoning_order must be 'interleaved' or 'appended'")
        names = [f.name.lower() for f in self.answer_fields]
        if taken := sorted({n for n in names if n in RESERVED}):
            raise SpecError(f"Reserved names of output fields: {', '.join(taken)}")
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise SpecError(f"Duplicate output fields: {', '.join(twice)}")

    @property
    def reasoning_fields(self) -> tuple[OutputField, ...]:
        if not self.reasoning:
            return ()
        return tuple(OutputField(f.name + REASONING_SUFFIX, "string", f"Reasoning for {f.name}") for f in self.fields)

    @property
    def answer_fields(self) -> tuple[OutputField, ...]:
        """Declared fields together with the reasoning strings, in answer order."""
        if self.reasoning and self.reasoning_order == "interleaved":
            return tuple(x for pair in zip(self.fields, self.reasoning_fields) for x in pair)
        return self.fields + self.reasoning_fields

    def json_schema(self) -> dict[str, Any]:
        fields = self.answer_fields
        return _object_schema({f.name: f.json_schema() for f in fields}, [f.name for f in fields if f.required])

    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type, True) for f in self.answer_fields])

    def replace(self, **changes: Any) -> LabelSpec:
        return replace(self, **changes)

    def schema_text(self) -> str:
        """The JSON schema as text; its length feeds the token estimate."""
        return json.dumps(self.json_schema())


def field_from_dict(doc: Mapping[str, Any]) -> OutputField:
    """Read one field from a plain mapping, as a settings file would hold it."""
    known = set(OutputField.__dataclass_fields__)
    unknown = sorted(set(doc) - known)
    if unknown:
        raise SpecError(f"Unknown field settings: {', '.join(unknown)}")
    for key in ("name", "type"):
        if key not in doc:
            raise SpecError(f"Output field needs '{key}'")
    args = dict(doc)
    if args.get("fields"):
        args["fields"] = tuple(field_from_dict(d) for d in args["fields"])
    if args.get("items"):
        args["items"] = field_from_dict({"name": "item", **args["items"]})
    return OutputField(**args)


def spec_from_dict(doc: Mapping[str, Any]) -> LabelSpec:
    """Read a job from nested mappings with the sections ``settings``, ``input``, ``prompt`` and ``output``."""
    missing = [s for s in ("settings", "input", "prompt", "output") if s not in doc]
    if missing:
        raise SpecError(f"Missing sections: {', '.join(missing)}")
    settings, source, prompt = doc["settings"], doc["input"], doc["prompt"]
    for section, key in (("input", "columns"), ("prompt", "system"), ("prompt", "template"), ("output", "fields")):
        if key not in doc[section]:
            raise SpecError(f"Section '{section}' needs '{key}'")
    return LabelSpec(
        system=prompt["system"],
        template=prompt["template"],
        fields=tuple(field_from_dict(d) for d in doc["output"]["fields"]),
        model=settings.get("model", DEFAULT_MODEL),
        reasoning=settings.get("reasoning", False),
        batch_size=settings.get("batch_size", DEFAULT_BATCH_SIZE),
        columns=tuple(source["columns"]),
        id_column=source.get("id_column"),
    )


def fields_from_struct(schema: T.StructType) -> tuple[OutputField, ...]:
    """Read output fields from a Spark schema.

    Column metadata may hold ``description``, ``enum``, bounds, ``required`` and ``default``. A nullable column is an optional
    field; mark it ``nullable=False`` to make it required.
    """
    return tuple(_from_spark(f.name, f.dataType, f.nullable, f.metadata or {}) for f in schema.fields)


def _from_spark(name: str, dtype: T.DataType, nullable: bool, meta: Mapping[str, Any]) -> OutputField:
    args: dict[str, Any] = {k: meta[k] for k in ("description", "enum", "default", *_BOUNDS) if k in meta}
    args["nullable"] = nullable
    args["required"] = meta.get("required", not nullable)
    if isinstance(dtype, T.StructType):
        return OutputField(name, "object", fields=fields_from_struct(dtype), **args)
    if isinstance(dtype, T.ArrayType):
        return OutputField(name, "array", items=_from_spark("item", dtype.elementType, dtype.containsNull, {}), **args)
    for kind, spark in SCALAR_TYPES.items():
        if isinstance(dtype, type(spark)):
            return OutputField(name, kind, **args)
    if isinstance(dtype, T.IntegerType):
        return OutputField(name, "integer", **args)
    raise SpecError(f"Field '{name}': {dtype.simpleString()} is not an answer type")


def fields_from_class(cls: type) -> tuple[OutputField, ...]:
    """Read output fields from an annotated class: a plain class, a dataclass or a model class with ``model_fields``.

    Types: ``str int float bool``, ``Literal``, ``Enum``, ``Optional``, lists and nested annotated classes. A class attribute is the
    field's default and makes it optional. ``model_fields`` entries also give descriptions and bounds.
    """
    models = getattr(cls, "model_fields", None)
    out = []
    for name, hint in typing.get_type_hints(cls).items():
        if models is not None and name not in models:
            continue
        args: dict[str, Any] = {}
        if models is not None:
            info = models[name]
            args["description"] = info.description
            args |= _class_bounds(name, info)
            if not info.is_required():
                args |= {"required": False, "default": info.get_default(call_default_factory=True)}
        elif hasattr(cls, name):
            args |= {"required": False, "default": getattr(cls, name)}
        out.append(_from_hint(name, hint, args))
    return tuple(out)


# Constraint names of model classes and what they are called here.
_CLASS_BOUNDS = {"ge": "minimum", "gt": "exclusive_minimum", "le": "maximum", "lt": "exclusive_maximum", "multiple_of": "multiple_of"}


def _class_bounds(name: str, info: Any) -> dict[str, Any]:
    """Bounds of a model class's field. What cannot be kept is refused."""
    if getattr(info, "alias", None) or getattr(info, "validation_alias", None):
        raise SpecError(f"Field '{name}': aliases are not supported")
    out: dict[str, Any] = {}
    for part in getattr(info, "metadata", None) or ():
        found = {b: getattr(part, a) for a, b in _CLASS_BOUNDS.items() if getattr(part, a, None) is not None}
        if not found:
            raise SpecError(f"Field '{name}': {part!r} is not supported")
        out |= found
    return out


def _from_hint(name: str, hint: Any, args: dict[str, Any]) -> OutputField:
    origin = typing.get_origin(hint)
    if origin in (typing.Union, pytypes.UnionType):
        rest = [a for a in typing.get_args(hint) if a is not type(None)]
        if len(rest) != 1:
            raise SpecError(f"Field '{name}': only Optional unions are supported")
        return _from_hint(name, rest[0], args | {"nullable": True})
    if origin is typing.Literal:
        values = typing.get_args(hint)
        return OutputField(name, _literal_type(name, values), enum=values, **args)
    if isinstance(hint, type) and issubclass(hint, enum.Enum):
        values = tuple(m.value for m in hint)
        if isinstance(args.get("default"), enum.Enum):
            args = args | {"default": args["default"].value}
        return OutputField(name, _literal_type(name, values), enum=values, **args)
    if origin is tuple and typing.get_args(hint)[1:] != (...,):
        raise SpecError(f"Field '{name}': a tuple needs one type, tuple[x, ...]")
    if origin in (list, tuple, Iterable):
        return OutputField(name, "array", items=_from_hint("item", typing.get_args(hint)[0], {}), **args)
    scalar = {str: "string", int: "integer", float: "number", bool: "boolean"}.get(hint)
    if scalar:
        return OutputField(name, scalar, **args)
    if isinstance(hint, type) and typing.get_type_hints(hint):
        return OutputField(name, "object", fields=fields_from_class(hint), **args)
    raise SpecError(f"Field '{name}': {hint!r} is not an answer type")


def _literal_type(name: str, values: tuple[Any, ...]) -> str:
    for kind, py in (("string", str), ("boolean", bool), ("integer", int)):
        if all(type(v) is py for v in values):
            return kind
    if all(type(v) in (int, float) for v in values):
        return "number"
    raise SpecError(f"Field '{name}': literal values of mixed types")
