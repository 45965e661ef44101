"""Content hashes, ids and buckets.

JSON texts are built with sorted keys; ``compact`` ones have no blanks after separators. Non-ASCII characters
are kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalized

#: Fields of the hash of a sample (fixed values).
SAMPLE_FIELDS = ("title", "category", "subcategory", "context", "question", "answer")


def json_string(c: Column) -> Column:
    """A JSON string literal: quotes, backslashes and control characters escaped, all else as it is."""
    x = c.cast("string")
    for raw, esc in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        x = F.replace(x, F.lit(raw), F.lit(esc))
    for n in (*range(0x00, 0x08), 0x0B, *range(0x0E, 0x20)):
        x = F.replace(x, F.lit(chr(n)), F.lit(f"\\u{n:04x}"))
    return F.concat(F.lit('"'), x, F.lit('"'))


def json_object(fields: dict[str, Column], compact: bool = True, missing: str = "") -> Column:
    """{"key":"value",...} with keys in order; null values are written as the text ``missing``."""
    comma, colon = (",", ":") if compact else (", ", ": ")
    parts = [F.concat(F.lit(f'"{k}"{colon}'), json_string(F.coalesce(fields[k].cast("string"), F.lit(missing)))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(comma, *parts), F.lit("}"))


def sample_hash(columns: dict[str, Column], null: str = "None") -> Column:
    """SHA-256 of the compact JSON of the sample's fields. A field that isn't given is "", a null one is ``null``."""
    fields = {f: F.coalesce(columns[f].cast("string"), F.lit(null)) if f in columns else F.lit("") for f in SAMPLE_FIELDS}
    return F.sha2(json_object(fields), 256)


def behavior_id(category: Column, subcategory: Column, statement: Column) -> Column:
    """SHA-256 of the spaced JSON of category and normalized subcategory and statement."""
    return F.sha2(json_object({"category": category, "subcategory": normalized(subcategory), "canonical_behavior": normalized(statement)}, compact=False), 256)


def item_key(*parts: Column, sep: str = "::") -> Column:
    """The parts joined; nulls are empty."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def short_id(*parts: Column, length: int = 16) -> Column:
    """The first hex digits of the SHA-256 of the joined parts."""
    return F.substring(F.sha2(item_key(*parts), 256), 1, length)


def position_uid(index: Column, suffix: Column) -> Column:
    return F.format_string("%06d_%s", index, F.coalesce(suffix, F.lit("")))


def seeded(seed: str | int, *parts: Column) -> Column:
    """SHA-256 of "seed:part:..."; as text it orders rows in a fixed random order."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def stable_bucket(c: Column, buckets: int) -> Column:
    """The first 64 bits of the SHA-256 as an unsigned number, modulo ``buckets``; null counts as empty."""
    head = F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, 16)
    hi, lo = F.conv(F.substring(head, 1, 8), 16, 10).cast("long"), F.conv(F.substring(head, 9, 8), 16, 10).cast("long")
    return F.pmod(F.pmod(hi, F.lit(buckets)) * F.lit(2**32 % buckets) + F.pmod(lo, F.lit(buckets)), F.lit(buckets))


def unit(h: Column) -> Column:
    """A hex digest as a number in [0, 1): its first 52 bits."""
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
