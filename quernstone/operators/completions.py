"""Actions in the texts of a model: extraction, strictness, schema, comparison with what was expected."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quernstone.functions.canonical import canonical, kind


@F.pandas_udf(StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first JSON object of each text, from its first brace on; what follows it is left out. Null if there is none.

    A prefix that is JSON with any text behind it has no built-in parser, so this is done over Arrow batches.
    """
    decoder = json.JSONDecoder()

    def one(text: str | None) -> str | None:
        at = text.find("{") if text else -1
        if at < 0:
            return None
        try:
            value, end = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            return None
        return text[at:end] if isinstance(value, dict) else None

    return texts.map(one, na_action="ignore")


def tagged_call(c: str | Column) -> Column:
    """JSON between the first <tool_call> tags, if it is an object with a text `name` and an object `arguments`; else null."""
    inside = F.nullif(F.trim(F.regexp_extract(c, r"(?s)<tool_call>(.*?)</tool_call>", 1)), F.lit(""))
    name, arguments = part(inside, "name"), part(inside, "arguments")
    return F.when((kind(inside) == "OBJECT") & (kind(name) == "STRING") & (kind(arguments) == "OBJECT"), inside)


def part(c: Column, name: str) -> Column:
    """A field of a JSON object, as canonical JSON; null if it isn't there."""
    return F.to_json(F.try_variant_get(F.try_parse_json(c), f"$.{name}", "variant"))


def well_formed_action(c: Column, tools: list[str]) -> Column:
    """True for an object of exactly `tool`, one of the tools, and `arguments`, an object."""
    names = F.array_sort(F.json_object_keys(c))
    tool = F.try_variant_get(F.try_parse_json(c), "$.tool", "string")
    return F.coalesce((names == F.array(F.lit("arguments"), F.lit("tool"))) & tool.isin(*tools) & (kind(part(c, "arguments")) == "OBJECT"), F.lit(False))


def score(completion: Column, extracted: Column, expected: Column, tools: list[str]) -> dict[str, Column]:
    """Measures of a completion against the expected action, both JSON texts; extracted is its first_object."""
    strict = F.when(kind(F.trim(completion)) == "OBJECT", F.trim(completion))
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    tool = F.try_variant_get(F.try_parse_json(extracted), "$.tool", "string")
    return {
        "extractable": extracted.isNotNull(), "strict": strict.isNotNull(), "well_formed": well_formed_action(strict, tools), "registered": F.coalesce(tool.isin(*tools), F.lit(False)),
        "tool_match": same(part(extracted, "tool"), part(expected, "tool")), "arguments_match": same(part(extracted, "arguments"), part(expected, "arguments")),
        "exact": same(canonical(extracted), canonical(expected)), "strict_exact": same(canonical(strict), canonical(expected)),
    }


def normalised(c: str | Column) -> Column:
    """Text of a completion: of a JSON list of messages the last one's content, else the text itself; trimmed."""
    col = F.col(c) if isinstance(c, str) else c
    contents = F.try_variant_get(F.try_parse_json(col), "$", "array<struct<content: string>>")
    last = F.coalesce(F.get(contents, F.size(contents) - 1)["content"], F.lit(""))
    return F.trim(F.when(F.size(contents) > 0, last).otherwise(col))


def prefix_arguments(c: str | Column, extracted: Column) -> Column:
    """Arguments at the beginning of a logged text: its first_object if it starts with one, else its first line under _raw."""
    col = F.ltrim(F.col(c) if isinstance(c, str) else c)
    line = F.split(col, "\\r?\\n")[0]
    return F.when(F.startswith(col, F.lit("{")) & extracted.isNotNull(), canonical(extracted)).otherwise(F.to_json(F.struct(line.alias("_raw"))))


def verdict(reward: str | Column) -> Column:
    """PASS for a reward of one or more, FAIL for less, NOT_EVALUATED for none or what is no number."""
    value = (F.col(reward) if isinstance(reward, str) else reward).try_cast("double")
    return F.when(value.isNull() | F.isnan(value), "NOT_EVALUATED").when(value >= 1, "PASS").otherwise("FAIL")
