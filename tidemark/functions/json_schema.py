"""JSON schemas as column expressions: what is wrong with a document, told without leaving the JVM.

A schema (a dict in the vocabulary of JSON Schema: type, required, properties, additionalProperties, items, minItems,
maxItems, enum, minimum, maximum, minLength, pattern, format, $ref) is compiled once into one expression over a variant, so
that documents of any shape can be checked, those included that no fixed Spark type would fit. Formats other than `date`
aren't checked, nor are unknown keywords.

Defined cases: a text that is no JSON, or null, has the one error that says so; a key that is there with null isn't missing;
numbers are integers if they have no fraction, and true isn't 1.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = "(全体)"  # how the document as a whole is named; a fixed value
NO_JSON = "not JSON"
_FOUND = "array<struct<key:string,path:string,text:string>>"


def _bound(value: Column, use: Callable[[Column], Column], kind: str = _FOUND) -> Column:
    """use(value), of this type, with the value taken once. Expressions inside lambdas are interpreted, and one such as flatten or an
    element of an array asks all that is below it for its type at each value; an aggregate doesn't, nor does what is asked of
    a bound variable."""
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, v: use(v))


class _Place:
    """A value of the document, a lambda variable that is taken once, and its names for people and for sorting. So are its forms
    that checks ask for: `kind`, `text`, `number` (a double), `object` (a map of its values) and `array`; null where the value has no
    such form."""

    def __init__(self, value: Column, shown: Column | None = None, order: Column | None = None, **forms: Column) -> None:
        self.value, self.root, self.forms = value, shown is None, forms
        self.shown, self.order = (F.lit("") if c is None else c for c in (shown, order))

    def having(self, name: str, form: Column) -> _Place:
        return _Place(self.value, None if self.root else self.shown, self.order, **self.forms, **{name: form})

    def at(self, key: str, value: Column) -> _Place:
        return _Place(value, self._named(F.lit(key)), F.concat(self.order, F.lit(f"\x01{key}")))

    def item(self, value: Column, i: Column) -> _Place:
        return _Place(value, self._named(i.cast("string")), F.concat(self.order, F.lit("\x01"), F.lpad(i.cast("string"), 9, "0")))

    def _named(self, name: Column) -> Column:
        return name if self.root else F.concat(self.shown, F.lit("/"), name)

    def error(self, text: str | Column) -> Column:
        told = F.struct(self.order.alias("key"), self.shown.alias("path"), (F.lit(text) if isinstance(text, str) else text).alias("text"))
        return F.array(told)


_OF_OBJECTS, _OF_ARRAYS = {"properties", "required", "additionalProperties"}, {"items", "minItems", "maxItems"}
_OF_KINDS = {"enum", "minimum", "maximum", "minLength", "pattern", "format"}


def _forms(schema: dict) -> dict[str, Callable[[_Place], Column]]:
    """The forms of a value that a schema's checks ask for, by name, in an order in which each may use those before it."""
    kinds, values = schema.get("type", []), schema.get("enum", [])
    kinds = {kinds} if isinstance(kinds, str) else set(kinds)
    got = lambda place, kind: F.try_variant_get(place.value, "$", kind)
    out: dict[str, Callable[[_Place], Column]] = {}
    if kinds - {"object", "array", "null"} or _OF_KINDS & schema.keys():
        out["kind"] = lambda p: F.schema_of_variant(p.value)
    if {"minLength", "pattern", "format"} & schema.keys() or any(isinstance(v, str) for v in values):
        out["text"] = lambda p: F.when(_is(p, "string"), got(p, "string"))
    if "integer" in kinds or {"minimum", "maximum"} & schema.keys() or any(not isinstance(v, str) for v in values):
        out["number"] = lambda p: F.when(p.forms["kind"] == "BIGINT", got(p, "bigint").cast("double")).when(_is(p, "number"), got(p, "double"))
    if "object" in kinds or _OF_OBJECTS & schema.keys():
        out["object"] = lambda p: got(p, "map<string,variant>")
    if "array" in kinds or _OF_ARRAYS & schema.keys():
        out["array"] = lambda p: got(p, "array<variant>")
    return out


def _is(place: _Place, name: str) -> Column:
    forms = place.forms
    number = lambda: forms["kind"].isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(forms["kind"], F.lit("DECIMAL"))
    return {
        "object": lambda: forms["object"].isNotNull(),
        "array": lambda: forms["array"].isNotNull(),
        "string": lambda: forms["kind"] == "STRING",
        "boolean": lambda: forms["kind"] == "BOOLEAN",
        "null": lambda: F.is_variant_null(place.value),
        "number": number,
        "integer": lambda: (forms["kind"] == "BIGINT") | (forms["number"] % 1 == 0),
    }[name]()


def _found(schema: dict, place: _Place, defs: dict) -> Column:
    """The errors of a place, each form of its value taken once."""
    if "$ref" in schema:
        schema = defs[schema["$ref"].rsplit("/", 1)[-1]]

    def told(place: _Place, forms: list) -> Column:
        if forms:
            (name, form), *rest = forms
            return _bound(form(place), lambda c: told(place.having(name, c), rest))
        checks, parts = _checks(schema, place), _object_parts(schema, place, defs) + _array_parts(schema, place, defs)
        if checks:
            some = reduce(or_, [F.coalesce(wrong, F.lit(False)) for wrong, _ in checks])  # mostly none, so their arrays aren't made
            own = F.when(some, _joined([F.when(wrong, place.error(text)) for wrong, text in checks]))
            parts = [own, *parts]
        return parts[0] if len(parts) == 1 else _joined(parts)

    return told(place, list(_forms(schema).items()))


def _checks(schema: dict, place: _Place) -> list[tuple[Column, str]]:
    """What is wrong with the value itself: when, and the text."""
    out = []
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        fits = reduce(or_, [_is(place, k) for k in kinds])
        out.append((~F.coalesce(fits, F.lit(False)), "not of type " + ", ".join(kinds)))
    if "enum" in schema:
        texts, numbers = [v for v in schema["enum"] if isinstance(v, str)], [v for v in schema["enum"] if not isinstance(v, str)]
        fits = F.lit(False)
        if texts:
            fits = fits | place.forms["text"].isin(texts)
        if numbers:
            fits = fits | place.forms["number"].isin([float(v) for v in numbers])
        out.append((~F.coalesce(fits, F.lit(False)), "not one of " + ", ".join(map(str, schema["enum"]))))
    for key, low in (("minimum", True), ("maximum", False)):
        if key in schema:
            value, bound = place.forms["number"], schema[key]
            outside = value < bound if low else value > bound
            out.append((outside, f"{'less' if low else 'greater'} than the {key} of {bound}"))
    if "minLength" in schema:
        out.append((F.length(place.forms["text"]) < schema["minLength"], f"shorter than {schema['minLength']}"))
    if "pattern" in schema:
        out.append((~place.forms["text"].rlike(schema["pattern"]), f"doesn't match {schema['pattern']}"))
    if schema.get("format") == "date":
        good = place.forms["text"].rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(place.forms["text"], "yyyy-MM-dd").isNotNull()
        out.append((place.forms["text"].isNotNull() & ~good, "not a date"))
    if "minItems" in schema:
        out.append((F.size(place.forms["array"]) < schema["minItems"], f"fewer than {schema['minItems']} items"))
    if "maxItems" in schema:
        out.append((F.size(place.forms["array"]) > schema["maxItems"], f"more than {schema['maxItems']} items"))
    return out


def _object_parts(schema: dict, place: _Place, defs: dict) -> list[Column]:
    """Arrays of errors of an object's keys and values, null where there are none."""
    known, required, values, out = schema.get("properties", {}), schema.get("required", []), place.forms.get("object"), []
    if schema.get("additionalProperties") is False:
        extra = F.filter(F.map_keys(values), lambda k: ~k.isin(*known) if known else F.lit(True))
        told = lambda e: F.when(F.size(e) > 0, place.error(F.concat(F.lit("not allowed: "), F.array_join(F.array_sort(e), ", "))))
        out.append(_bound(extra, told))

    def part(key: str) -> Column:
        def told(v: Column) -> Column:
            inner = F.when(v.isNotNull(), _found(known[key], place.at(key, v), defs) if key in known else F.lit(None).cast(_FOUND))
            return inner.when(_is(place, "object"), place.error(f"{key} is required")) if key in required else inner

        return _bound(F.try_element_at(values, F.lit(key)), told)

    return out + [part(k) for k in dict.fromkeys([*required, *known])]


def _array_parts(schema: dict, place: _Place, defs: dict) -> list[Column]:
    if "items" not in schema:
        return []
    inner = F.transform(place.forms["array"], lambda v, i: _found(schema["items"], place.item(v, i), defs))
    return [_bound(inner, _flat)]


def _flat(parts: Column) -> Column:
    return F.flatten(F.filter(parts, lambda p: p.isNotNull()))


def _joined(parts: list[Column]) -> Column:
    return _bound(F.array(*parts), _flat) if parts else F.lit(None).cast(_FOUND)


def violations(schema: dict, text: Column) -> Column:
    """array<string> of 'path: what is wrong' of a JSON text, sorted by path, items by their number; empty if it fits."""

    def lines(found: Column) -> Column:
        return F.transform(F.array_sort(found), lambda x: F.concat(F.when(x["path"] == "", WHOLE).otherwise(x["path"]), F.lit(": "), x["text"]))

    def told(doc: Column) -> Column:
        found = _found(schema, _Place(doc), schema.get("$defs", {}))
        return F.when(doc.isNull(), F.array(F.lit(f"{WHOLE}: {NO_JSON}"))).otherwise(_bound(F.coalesce(found, F.array().cast(_FOUND)), lines, "array<string>"))

    return _bound(F.try_parse_json(text), told, "array<string>")  # parsed once, not for each check
