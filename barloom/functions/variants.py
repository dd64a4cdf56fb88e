"""Typed access to semi-structured provider payloads held as VARIANT.

VARIANT keeps the good elements of a list with one bad element, where a fixed
JSON schema would null the whole list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field(doc: Column, name: str) -> Column:
    """Field as VARIANT: SQL NULL when absent, a variant null when JSON null."""
    return F.try_variant_get(doc, f"$.{name}", "variant")


def text_field(doc: Column, name: str) -> Column:
    """Field as text; NULL when absent or JSON null."""
    return F.try_variant_get(doc, f"$.{name}", "string")


def objects_field(doc: Column, name: str, texts: list[str], variants: tuple[str, ...] = ()) -> Column:
    """Field as array of structs of the given fields as text or VARIANT; NULL when absent or not a list.

    An element that is no object is NULL. All fields of an element are taken in one step.
    """
    kind = ",".join([*[f"`{f}`:string" for f in texts], *[f"`{f}`:variant" for f in variants]])
    return F.try_variant_get(doc, f"$.{name}", f"array<struct<{kind}>>")


def is_object(doc: Column) -> Column:
    """True for a JSON object; false for a list, a scalar, JSON null or SQL NULL."""
    return F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))


def computed_once(rows: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` plus the given columns, each evaluated once per row.

    A filter on a plain projected column is pushed below the projection with the
    whole expression in it, so a parsed document would be parsed again for every
    reference. Filters do not cross a generator, and this is the smallest one.
    """
    one = F.struct(*[value.alias(name) for name, value in columns.items()])
    return rows.select(*keep, F.inline(F.array(one)))
