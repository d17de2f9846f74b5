"""JSON text assembled from columns, for documents whose members differ in type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value(col: Column) -> Column:
    """JSON text of one value, ``null`` included."""
    whole = F.to_json(F.array(col), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def member(name: str, text: Column) -> Column:
    return F.concat(F.lit(f'"{name}":'), text)


def obj(*members: Column) -> Column:
    """An object of the given members; a null member is left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def lst(items: Column) -> Column:
    """An array out of JSON texts."""
    return F.concat(F.lit("["), F.concat_ws(",", items), F.lit("]"))


def payload(p: Column) -> Column:
    """Compact metric payload; history items are ``["HH:MM",value]`` pairs."""
    points = F.transform(
        p["H"], lambda h: F.concat(F.lit('["'), h["label"], F.lit('",'), F.coalesce(h["value"].cast("string"), F.lit("null")), F.lit("]"))
    )
    threshold = F.when(p["TH"].isNotNull(), member("TH", value(p["TH"])))
    return F.when(p.isNotNull(), obj(member("U", value(p["U"])), threshold, member("H", lst(points))))
