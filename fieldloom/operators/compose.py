"""Union and master-detail joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError, FieldError
from ..metadata import prepare_key
from ..registry import operation
from .util import col, fresh, present


@operation(0)
def append(objects: Sequence[DataFrame], distinct: bool = False) -> DataFrame:
    """Rows of all tables, by the position of their fields, named as in the first; duplicates stay unless distinct."""
    if not objects:
        raise ArgumentError("nothing to append")
    if len({len(df.columns) for df in objects}) > 1:
        raise FieldError(f"tables of {[len(df.columns) for df in objects]} fields")
    out = reduce(DataFrame.unionAll, objects)
    return out.distinct() if distinct else out


def renamed_apart(detail: DataFrame, keys: list[str], *taken) -> tuple[DataFrame, list[str]]:
    """``detail`` with key fields under names that occur nowhere else; joins of a table with a part of itself need that."""
    names = []
    for k in keys:
        names.append(fresh(f"__{k}", *taken, detail.columns, names))
    pairs = dict(zip(keys, names, strict=True))
    return detail.select(*[col(c).alias(pairs.get(c, c)) for c in detail.columns]), names


@operation(2)
def join_details(master: DataFrame, detail: DataFrame | Sequence[DataFrame], master_key=None, detail_key=None, joins: Sequence[dict] | None = None, how: str = "inner") -> DataFrame:
    """Join on equal keys; the detail's key fields drop out. Null keys match nothing.

    Several details with ``joins`` of {"master": key, "detail": key} are joined one after the other.
    Which side is broadcast is left to the optimizer, which knows their sizes.
    """
    if isinstance(detail, Sequence):
        if joins is None or len(joins) != len(detail):
            raise ArgumentError(f"{len(detail)} details and {len(joins or ())} joins")
        return reduce(lambda m, x: join_details(m, x[0], x[1]["master"], x[1]["detail"], how=how), zip(detail, joins, strict=True), master)
    if how not in ("inner", "left"):
        raise ArgumentError(f"how is {how!r}, neither inner nor left")
    left, right = present(master, prepare_key(master_key)), present(detail, prepare_key(detail_key if detail_key is not None else master_key))
    if not left or len(left) != len(right):
        raise ArgumentError(f"keys {left} and {right}")
    if clash := [c for c in detail.columns if c in master.columns and c not in right]:
        raise FieldError(f"fields {clash} are in both tables")
    other, names = renamed_apart(detail, right, master.columns)
    test = reduce(lambda a, b: a & b, [col(a) == col(b) for a, b in zip(left, names, strict=True)])
    return master.join(other, test, how).drop(*names)


def null_safe(left: list[str], right: list[str]):
    return reduce(lambda a, b: a & b, [F.equal_null(col(a), col(b)) for a, b in zip(left, right, strict=True)])
