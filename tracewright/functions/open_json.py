"""Open JSON: objects as maps of variants, where a missing key and a null differ, and their values as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def as_map(v: Column) -> Column:
    """An object's values by key; null for what is no object."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_text(v: Column) -> Column:
    return F.coalesce(kind_of(v) == "STRING", F.lit(False))


def number(v: Column) -> Column:
    """A number's value; null for flags, texts and anything else."""
    return let(v, lambda x: F.when(~kind_of(x).isin("STRING", "BOOLEAN", "VOID"), F.try_variant_get(x, "$", "double")))


def flag(v: Column) -> Column:
    """A flag's value; null for anything else."""
    return let(v, lambda x: F.when(kind_of(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean")))


def text(v: Column) -> Column:
    """A value as text: null is None, flags are True and False, lists and objects are JSON; null only where there is no value."""
    plain = lambda x: F.try_variant_get(x, "$", "string")
    return let(v, lambda x: F.when(F.is_variant_null(x), "None").when(kind_of(x) == "BOOLEAN", F.initcap(plain(x))).otherwise(plain(x)))


def filled(v: Column) -> Column:
    """Whether there is a value that is neither null nor an empty text."""
    blank = lambda x: F.is_variant_null(x) | F.coalesce((kind_of(x) == "STRING") & (F.try_variant_get(x, "$", "string") == ""), F.lit(False))
    return let(v, lambda x: x.isNotNull() & ~F.coalesce(blank(x), F.lit(True)))


def truthy(v: Column) -> Column:
    """Whether a value is there and is not null, false, zero or empty."""
    no = lambda x, raw: ((kind_of(x) == "BOOLEAN") & (raw == "false")) | F.coalesce(number(x) == 0, F.lit(False)) | raw.isin("[]", "{}")
    return let(v, lambda x: F.coalesce(filled(x) & ~no(x, F.try_variant_get(x, "$", "string")), F.lit(False)))


def pick(m: Column, keys: tuple[str, ...]) -> Column:
    """The first value that is neither null nor an empty text."""
    return F.coalesce(*[F.when(filled(m[k]), m[k]) for k in keys])


def pick_present(m: Column, keys: tuple[str, ...]) -> Column:
    """The value of the first key that is there, null values too."""
    return F.coalesce(*[m[k] for k in keys])


def has_any(m: Column, keys: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.map_contains_key(m, k)
    return F.coalesce(out, F.lit(False))


def as_object(m: Column) -> Column:
    """A map of variants as an object."""
    return F.parse_json(F.to_json(m))
