"""Fields of records that are JSON of any shape: not there, there and null, or there with a value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parsed(line: Column) -> Column:
    """A record (``VARIANT``) from its line; null where the line isn't JSON."""
    return F.try_parse_json(line)


def field(record: Column, name: str) -> Column:
    """A field as it is: null where the record has none of that name, a variant null where it has a null."""
    if "'" in name and '"' in name:
        raise ValueError(f"no path for a name with both quotes: {name}")
    return F.try_variant_get(record, f"$[\"{name}\"]" if "'" in name else f"$['{name}']", "variant")


def has(record: Column, *names: str) -> Column:
    """Whether all fields are there, with a value or with null."""
    out = F.lit(True)
    for name in names:
        out = out & field(record, name).isNotNull()
    return F.coalesce(out, F.lit(False))


def text(value: Column) -> Column:
    """A field's value as Python's ``str`` writes it: a null as ``None``, booleans with a capital, texts as they are, the rest as in JSON; null if it isn't there."""
    kind = F.schema_of_variant(value)
    plain = F.try_variant_get(value, "$", "string")
    return F.when(value.isNull(), F.lit(None).cast("string")).when(F.is_variant_null(value), "None").when(kind == "BOOLEAN", F.initcap(plain)).otherwise(plain)


def first_text(record: Column, *names: str, default: str = "") -> Column:
    """``text`` of the first of the fields that is there, be it null; the default if none is."""
    return F.coalesce(*[text(field(record, n)) for n in names], F.lit(default))
