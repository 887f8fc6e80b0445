"""Property maps: values are JSON scalars so that their types survive."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def json_text(col: Column) -> Column:
    """A string column as a JSON string; null stays null."""
    packed = F.to_json(F.array(col))
    return F.when(col.isNotNull(), F.substring(packed, F.lit(2), F.length(packed) - 2))


def plain(col: Column) -> Column:
    """A JSON scalar as text, without quotes and escapes."""
    return F.when(col.startswith('"'), F.element_at(F.from_json(F.concat(F.lit("["), col, F.lit("]")), "array<string>"), 1)).otherwise(col)


def prop(name: str, props: str = "props") -> Column:
    return plain(F.try_element_at(F.col(props), F.lit(name)))


def props_map(**columns: Column) -> Column:
    """Map of the given JSON scalars without nulls."""
    pairs = [x for name, col in columns.items() for x in (F.lit(name), col.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull())


def kind(col: Column) -> Column:
    """boolean, integer, decimal or string, read off a JSON scalar."""
    return (F.when(col.startswith('"'), "string").when(col.isin("true", "false"), "boolean")
            .when(col.rlike(r"^-?\d+$"), "integer").otherwise("decimal"))
