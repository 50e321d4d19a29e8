"""Canonical JSON of a row, as an expression: keys sorted, ", " and ": " between, no escapes but those JSON needs.

The keys are sorted when the expression is built, so that a hash over the text is one pass in the JVM and every row's can be
taken anew on its own. Numbers are written as JSON libraries commonly do: a double in its shortest form, without an exponent
from 1e-4 to 1e16. Days and times are texts. Nulls are null, not left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_RARE = [chr(c) for c in range(32) if chr(c) not in _SHORT]


def _text(value: Column) -> Column:
    for raw, told in _SHORT.items():
        value = F.replace(value, F.lit(raw), F.lit(told))
    whole = value
    for c in _RARE:
        whole = F.replace(whole, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return F.concat(F.lit('"'), F.when(value.rlike("[\\x00-\\x1f]"), whole).otherwise(value), F.lit('"'))


def _double(value: Column) -> Column:
    raw = value.cast("string")
    plain = F.regexp_replace(F.regexp_replace(raw.try_cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    parts = F.split(raw, "E")
    power = F.get(parts, F.lit(1)).try_cast("int")
    sign, size = F.when(power < 0, "-").otherwise("+"), F.abs(power).cast("string")
    digits = F.regexp_replace(F.get(parts, F.lit(0)), r"\.0$", "")
    wide = F.concat(digits, F.lit("e"), sign, F.when(F.length(size) < 2, F.lpad(size, 2, "0")).otherwise(size))
    return F.when(~raw.contains("E"), raw).when((power >= -4) & (power < 16), plain).otherwise(wide)


def _object(pairs: list[tuple[str, Column]]) -> Column:
    if not pairs:
        return F.lit("{}")
    parts: list[Column] = []
    for i, (key, value) in enumerate(pairs):
        quoted = key.replace("\\", "\\\\").replace('"', '\\"')
        parts += [F.lit(("{" if i == 0 else ", ") + f'"{quoted}": '), value]
    return F.concat(*parts, F.lit("}"))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """The JSON text of a value of a type; "null" for null."""
    if isinstance(kind, T.StructType):
        told = _object([(f.name, canonical_json(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)])
    elif isinstance(kind, T.ArrayType):
        told = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pair = lambda e: F.concat(_text(e["key"].cast("string")), F.lit(": "), canonical_json(e["value"], kind.valueType))
        told = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)), pair), ", "), F.lit("}"))
    elif isinstance(kind, T.FloatType | T.DoubleType):
        told = _double(value.cast("double"))
    elif isinstance(kind, T.BooleanType | T.IntegralType | T.DecimalType):
        told = value.cast("string")
    else:
        told = _text(value.cast("string"))
    return F.when(value.isNull(), "null").otherwise(told)


def row_json(schema: T.StructType, names: list[str], around: str | None = None) -> Column | tuple[Column, Column]:
    """The JSON object of these columns. With `around`, the name of one text column of them: what stands before and after its
    value inside the quotes."""
    pairs = [(n, canonical_json(F.col(f"`{n}`"), schema[n].dataType)) for n in sorted(names)]
    if around is None:
        return _object(pairs)
    at = next(i for i, (n, _) in enumerate(pairs) if n == around)
    blank = "\x00"  # no column's JSON holds it: it is escaped there
    whole = _object([*pairs[:at], (around, F.lit(f'"{blank}"')), *pairs[at + 1 :]])
    return F.substring_index(whole, blank, 1), F.substring_index(whole, blank, -1)
