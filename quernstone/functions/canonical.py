"""Canonical JSON, call signatures and leaves of nested values, as Column expressions without Python.

A variant keeps the fields of an object in the order of their names and numbers by value, so its JSON is the
same for all ways of writing a value. Texts that are no JSON have no canonical form (null).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of compact JSON: strings (a name keeps its colon), numbers and words.
PARTS = r'"(?:[^"\\]|\\.)*":?|-?[0-9][0-9.eE+-]*|true|false|null'


def canonical(c: str | Column) -> Column:
    """Compact JSON with sorted names; null for a null or unreadable text."""
    return F.to_json(F.try_parse_json(c))


def digest(c: str | Column) -> Column:
    """Upper-case SHA-256 of the canonical JSON."""
    return F.upper(F.sha2(canonical(c), 256))


def kind(c: str | Column) -> Column:
    """OBJECT, ARRAY, STRING, or another name of the JSON value's type; null for an unreadable text."""
    return F.regexp_extract(F.schema_of_variant(F.try_parse_json(c)), "^([A-Z]+)", 1)


def content_text(c: str | Column) -> Column:
    """Text of a message's content given as JSON: '' for null, the lines of a list, a string or a text that is no JSON itself, else canonical JSON."""
    col = F.col(c) if isinstance(c, str) else c
    value = F.try_parse_json(c)
    lines = F.array_join(F.try_variant_get(value, "$", "array<string>"), "\n")
    of = kind(c)
    return F.when(value.isNull(), F.coalesce(col, F.lit(""))).when(of == "VOID", "").when(of == "ARRAY", lines).when(of == "STRING", F.try_variant_get(value, "$", "string")).otherwise(canonical(c))


def arguments_object(c: str | Column) -> Column:
    """Arguments of a call as canonical JSON of an object: an object itself or in a string, other values under _value, other texts under _raw."""
    col = F.col(c) if isinstance(c, str) else c
    inner = F.try_variant_get(F.try_parse_json(col), "$", "string")
    within = F.when((kind(col) == "STRING") & (kind(inner) == "OBJECT"), canonical(inner))
    wrapped = F.when(kind(col).isNull(), F.to_json(F.struct(col.alias("_raw")))).otherwise(F.concat(F.lit('{"_value":'), canonical(col), F.lit("}")))
    return F.when(F.coalesce(F.trim(col), F.lit("")) == "", "{}").when(kind(col) == "OBJECT", canonical(col)).otherwise(F.coalesce(within, wrapped))


def signature(name: Column, arguments: Column) -> Column:
    """name:arguments, the same for every way of writing the same arguments."""
    return F.concat(F.coalesce(name, F.lit("")), F.lit(":"), arguments_object(arguments))


def loose_signature(name: Column, arguments: Column) -> Column:
    """signature without regard to the order of items: item_ids sorted, with new_item_ids as sorted pairs if there are as many."""
    value = F.try_parse_json(arguments_object(arguments))
    old, new = (F.try_variant_get(value, f"$.{k}", "array<string>") for k in ("item_ids", "new_item_ids"))
    paired = new.isNotNull() & (F.size(old) == F.size(new))
    pairs = F.transform(F.array_sort(F.arrays_zip(old.alias("a"), new.alias("b"))), lambda p: F.concat_ws(">", p["a"], p["b"]))
    items = F.when(paired, F.array_join(pairs, ",")).otherwise(F.concat(F.array_join(F.array_sort(old), ","), F.lit("|"), F.coalesce(F.array_join(new, ","), F.lit(""))))
    rest = F.map_filter(F.from_json(F.to_json(value), "map<string,string>"), lambda k, _: ~k.isin("item_ids", "new_item_ids"))
    named = F.array_join(F.array_sort(F.transform(F.map_entries(rest), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("null"))))), ",")
    return F.when(old.isNotNull(), F.concat_ws(":", F.coalesce(name, F.lit("")), named, items)).otherwise(signature(name, arguments))


def leaves(c: str | Column) -> Column:
    """Values without parts of a JSON text, in canonical order: strings without their quotes, numbers and words as written."""
    parts = F.regexp_extract_all(canonical(c), F.lit(PARTS), F.lit(0))
    values = F.filter(parts, lambda p: ~F.endswith(p, F.lit('":')))
    return F.transform(values, lambda p: F.when(F.startswith(p, F.lit('"')), F.try_variant_get(F.try_parse_json(p), "$", "string")).otherwise(p))
