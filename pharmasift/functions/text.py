"""Text expressions: cleaning, tokens, JSON arrays, formatted numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pharmasift.functions.rounding import half_even

# Fixed value: the characters a Unicode-aware whitespace split breaks on: the
# White_Space property and the four separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def blank_to_null(c: Column) -> Column:
    """Whitespace-only text counts as missing."""
    return F.when(F.trim(c) != "", c)


def words(c: Column) -> Column:
    """Whitespace-separated words, empty pieces dropped, case kept."""
    return F.array_remove(F.split(c, f"(?U){SPACE}+"), "")


def tokens(c: Column) -> Column:
    """Lower-cased words; null text gives an empty array."""
    return F.coalesce(words(F.lower(c)), F.array().cast("array<string>"))


def first_component(c: Column) -> Column:
    """First part of a backslash-joined combination name."""
    return F.substring_index(c, "\\", 1)


def name_join_key(c: Column) -> Column:
    """Key used on both sides of the name-map join."""
    return F.upper(F.trim(first_component(c)))


def contains_ci(c: Column, needle: str) -> Column:
    """Literal, case-insensitive substring test."""
    return F.lower(c).contains(needle.lower())


def any_of(c: Column, needles: list[str]) -> Column:
    """True when the text contains at least one of the given pieces."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | c.contains(needle)
    return hit


def fixed(c: Column, digits: int) -> Column:
    """Number with a fixed count of decimals, rounded as `half_even` does."""
    return F.format_string(f"%.{digits}f", half_even(c, digits))


def float_text(c: Column) -> Column:
    """Shortest text of a double, without exponent up to 1e16."""
    return F.when(F.abs(c) < 1e7, c.cast("string")).otherwise(F.format_string("%.1f", c))


def unfence(raw: Column) -> Column:
    """Drop a Markdown code fence and its optional `json` tag around a reply."""
    body = strip(raw)
    inner = F.split(body, "```", -1)[1]
    inner = F.when(inner.startswith("json"), F.substring(inner, 5, 2**31 - 1)).otherwise(inner)
    return strip(F.when(body.startswith("```"), inner).otherwise(body))


def json_strings(raw: Column) -> Column:
    """Parse a JSON array made of strings only; anything else gives null."""
    parsed = F.try_parse_json(raw)
    return F.when(
        F.schema_of_variant(parsed).isin("ARRAY<STRING>", "ARRAY<VOID>"),
        F.from_json(raw, "array<string>"),
    )


def json_array_or_empty(raw: Column) -> Column:
    """JSON array column to an array; null or unreadable text gives an empty array."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))
