"""Field metadata over Spark schemas.

A ``Field`` is a name, a storage type (what Spark stores) and an analytical type (how the field is
used). The first two map to a ``StructField``; everything else lives in the field's metadata under
``META`` and so survives filters, groupings and renames.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .errors import ArgumentError, MetadataError, NoSuchFieldError

META = "fieldloom"

#: Storage types and what Spark stores for them.
SPARK_TYPES: dict[str, T.DataType] = {
    "unknown": T.StringType(), "string": T.StringType(), "text": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "float": T.DoubleType(),
    "boolean": T.BooleanType(), "datetime": T.TimestampType(), "time": T.StringType(), "date": T.DateType(), "array": T.ArrayType(T.StringType()),
    "object": T.VariantType(), "binary": T.BinaryType(), "geopoint": T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]),
}
STORAGE_TYPES = tuple(SPARK_TYPES)
ANALYTICAL_TYPES = ("default", "typeless", "flag", "discrete", "measure", "nominal", "ordinal")
#: Analytical type of a storage type, unless one is given.
DEFAULT_ANALYTICAL = {
    "unknown": "typeless", "string": "typeless", "text": "typeless", "integer": "discrete", "number": "measure", "float": "measure", "date": "typeless",
    "datetime": "typeless", "time": "typeless", "boolean": "flag", "array": "typeless", "object": "typeless", "binary": "typeless", "geopoint": "typeless",
}


def storage_type(kind: T.DataType) -> str:
    """The storage type of a Spark type."""
    table = (
        (T.BooleanType, "boolean"), ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "integer"), ((T.FloatType, T.DoubleType, T.DecimalType), "number"),
        (T.DateType, "date"), ((T.TimestampType, T.TimestampNTZType), "datetime"), (T.ArrayType, "array"), (T.BinaryType, "binary"),
        ((T.StructType, T.MapType, T.VariantType), "object"), (T.StringType, "string"),
    )
    return next((name for kinds, name in table if isinstance(kind, kinds)), "unknown")


@dataclasses.dataclass(frozen=True)
class Field:
    name: str
    storage_type: str = "unknown"
    analytical_type: str | None = None
    label: str | None = None
    concrete_storage_type: str | None = None
    size: int | None = None
    missing_value: object = None
    info: dict | None = None
    origin: str | None = None
    description: str | None = None

    def __post_init__(self):
        if self.storage_type not in SPARK_TYPES:
            raise MetadataError(f"unknown storage type {self.storage_type!r} of field {self.name!r}")
        if self.analytical_type in (None, "default"):
            object.__setattr__(self, "analytical_type", DEFAULT_ANALYTICAL[self.storage_type])
        elif self.analytical_type not in ANALYTICAL_TYPES:
            raise MetadataError(f"unknown analytical type {self.analytical_type!r} of field {self.name!r}")

    def __str__(self) -> str:
        return self.name

    def clone(self, **changes) -> Field:
        if "storage_type" in changes and "analytical_type" not in changes:
            changes["analytical_type"] = None
        return dataclasses.replace(self, **changes)

    def to_dict(self) -> dict:
        return {k: v for k, v in dataclasses.asdict(self).items() if v is not None}

    def to_spark(self) -> T.StructField:
        extra = {k: v for k, v in self.to_dict().items() if k != "name"}
        return T.StructField(self.name, SPARK_TYPES[self.storage_type], True, {META: extra})

    @staticmethod
    def from_spark(field: T.StructField) -> Field:
        extra = (field.metadata or {}).get(META, {})
        found = storage_type(field.dataType)
        kept = extra if SPARK_TYPES.get(extra.get("storage_type")) == field.dataType else {k: v for k, v in extra.items() if k not in ("storage_type", "analytical_type")} | {"analytical_type": extra.get("analytical_type") if extra.get("storage_type") in (None, found) else None}
        return Field(field.name, **({"storage_type": found, "concrete_storage_type": field.dataType.simpleString()} | kept))


def to_field(value) -> Field:
    """A field from a name, (name, storage, analytical), a dict, a StructField or a field."""
    if isinstance(value, Field):
        return value
    if isinstance(value, T.StructField):
        return Field.from_spark(value)
    if isinstance(value, str):
        return Field(value)
    if isinstance(value, dict):
        known = {f.name for f in dataclasses.fields(Field)}
        extra = set(value) - known - {"type"}
        if "name" not in value or extra:
            raise MetadataError(f"field needs a name and knows no {sorted(extra)}")
        return Field(**({"storage_type": value["type"]} if "type" in value else {}) | {k: v for k, v in value.items() if k != "type"})
    if isinstance(value, Sequence) and 1 <= len(value) <= 3:
        return Field(*value)
    raise MetadataError(f"no field can be made from {value!r}")


class FieldList:
    """Fields in order, found by name or place."""

    def __init__(self, *fields):
        self._fields: list[Field] = []
        for f in fields:
            self.append(f)

    @staticmethod
    def of(df: DataFrame) -> FieldList:
        return FieldList(*df.schema.fields)

    def to_spark(self) -> T.StructType:
        return T.StructType([f.to_spark() for f in self])

    def append(self, field) -> None:
        field = to_field(field)
        if field.name in self.names():
            raise MetadataError(f"field {field.name!r} is there twice")
        self._fields.append(field)

    def names(self, indexes: Iterable[int] | None = None) -> list[str]:
        names = [f.name for f in self._fields]
        return names if indexes is None else [names[i] for i in indexes]

    def index(self, field) -> int:
        try:
            return self.names().index(str(field))
        except ValueError:
            raise NoSuchFieldError(f"no field {str(field)!r} in {self.names()}") from None

    def indexes(self, fields: Iterable) -> list[int]:
        return [self.index(f) for f in fields]

    def index_map(self) -> dict[str, int]:
        return {n: i for i, n in enumerate(self.names())}

    def mask(self, fields: Iterable | None = None) -> list[bool]:
        found = {str(f) for f in fields} if fields is not None else set(self.names())
        return [n in found for n in self.names()]

    def field(self, name) -> Field:
        return self._fields[self.index(name)]

    def fields(self, names: Iterable | None = None, storage_type: str | None = None, analytical_type: str | None = None) -> list[Field]:
        """The fields of these names (all for None, none for an empty list), narrowed by type."""
        found = list(self._fields) if names is None else [self.field(n) for n in names]
        return [f for f in found if storage_type in (None, f.storage_type) and analytical_type in (None, f.analytical_type)]

    def aggregated_fields(self, measures, include_count: bool = True, count_field: str = "record_count") -> FieldList:
        out = FieldList()
        for name, how in prepare_aggregation_list(measures):
            out.append(self.field(name).clone(name=f"{name}_{how}", analytical_type="measure"))
        if include_count:
            out.append(Field(count_field, "integer", "measure"))
        return out

    def copy(self) -> FieldList:
        return FieldList(*self._fields)

    def clone(self, fields: Iterable | None = None, **changes) -> FieldList:
        return FieldList(*[f.clone(**changes) for f in self.fields(fields)])

    def __getitem__(self, key) -> Field:
        return self._fields[key] if isinstance(key, int) else self.field(key)

    def __delitem__(self, key) -> None:
        del self._fields[key if isinstance(key, int) else self.index(key)]

    def __iter__(self):
        return iter(self._fields)

    def __len__(self) -> int:
        return len(self._fields)

    def __contains__(self, field) -> bool:
        return str(field) in self.names()

    def __eq__(self, other) -> bool:
        return isinstance(other, FieldList) and list(self) == list(other)

    def __add__(self, other) -> FieldList:
        return FieldList(*self, *other)

    def __repr__(self) -> str:
        return f"FieldList({', '.join(map(repr, self.names()))})"


class FieldFilter:
    """What to keep or to drop, by the old names, and what to rename; fields stay in their order."""

    def __init__(self, keep=None, drop=None, rename: dict | None = None):
        if keep and drop:
            raise MetadataError("keep and drop exclude each other")
        self.keep = None if not keep else prepare_key(keep)
        self.drop = None if not drop else prepare_key(drop)
        self.rename = {str(k): str(v) for k, v in (rename or {}).items()}

    def pairs(self, names: Sequence[str]) -> list[tuple[str, str]]:
        """(old, new) of each field that is left."""
        for n in [*(self.keep or ()), *(self.drop or ())]:
            if n not in names:
                raise NoSuchFieldError(f"no field {n!r} in {list(names)}")
        left = [n for n in names if (self.keep is None or n in self.keep) and n not in (self.drop or ())]
        out = [(n, self.rename.get(n, n)) for n in left]
        if len({new for _, new in out}) < len(out):
            raise MetadataError(f"renaming gives the same name twice: {[new for _, new in out]}")
        return out

    def filter(self, fields: FieldList) -> FieldList:
        return FieldList(*[fields.field(old).clone(name=new) for old, new in self.pairs(fields.names())])

    def field_mask(self, fields: FieldList) -> list[bool]:
        left = {old for old, _ in self.pairs(fields.names())}
        return [n in left for n in fields.names()]


def prepare_key(key) -> list[str]:
    """A list of names from a name, a field or a sequence of them."""
    if key is None:
        return []
    return [str(key)] if isinstance(key, str | Field) else [str(k) for k in key]


def _tuples(value, default: str) -> list[tuple[str, str]]:
    if value is None:
        return []
    if isinstance(value, str | Field):
        return [(str(value), default)]
    return [(str(v), default) if isinstance(v, str | Field) else (str(v[0]), v[1] if len(v) > 1 else default) for v in value]


def prepare_aggregation_list(measures) -> list[tuple[str, str]]:
    """(measure, aggregate) pairs; the default is a sum. A bare tuple of two names is two measures."""
    return [(m, a) for m, how in _tuples(measures, "sum") for a in ([how] if isinstance(how, str) else how)]


def prepare_order_list(order) -> list[tuple[str, str]]:
    """(field, "asc" or "desc") pairs; directions may be longer words and of any case."""
    out = []
    for name, how in _tuples(order, "asc"):
        found = next((d for d in ("asc", "desc") if str(how).lower().startswith(d)), None)
        if found is None:
            raise ArgumentError(f"order of {name!r} is {how!r}, neither asc nor desc")
        out.append((name, found))
    return out


def distill_aggregate_measures(measures) -> list[tuple[str, list[str]]]:
    """(measure, [aggregates]), each measure once, in order."""
    out: dict[str, list[str]] = {}
    for m, a in prepare_aggregation_list(measures):
        if a not in out.setdefault(m, []):
            out[m].append(a)
    return list(out.items())
