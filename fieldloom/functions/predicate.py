"""Predicate text: a small dialect of operators, compiled to Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs of the dialect that SQL writes differently.
SIGNS = {"≤": "<=", "≥": ">=", "≠": "!=", "¬": " NOT ", "==": "="}
TOKEN = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|<<|>>|==|[≤≥≠¬]|[A-Za-z_][\w.]*|[0-9.]+(?:[eE][+-]?[0-9]+)?|\s+|.")


def normalised(text: str) -> str:
    """The text as SQL; quoted parts stay. Shifts bind one plain operand on either side."""
    parts = [SIGNS.get(t, t) for t in TOKEN.findall(text)]
    out = "".join(parts)
    for sign, name in (("<<", "shiftleft"), (">>", "shiftright")):
        out = re.sub(rf"([\w.`]+)\s*{sign}\s*([\w.`]+)", rf"{name}(\1, \2)", out)
    return out


def compile_predicate(text: str) -> Column:
    return F.expr(normalised(text))
