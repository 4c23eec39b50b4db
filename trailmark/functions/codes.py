"""Vocabularies and category mappings, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Agent classes and their codes.
CLASS_CODES = {
    "car": 0, "van": 0, "trailer": 0, "truck": 1, "truck_bus": 2, "bus": 2, "motorcycle": 3, "bicycle": 4,
    "pedestrian": 5, "tricycle": 6, "animal": 7, "undefined": 8,
}
# Edge types of lane graphs.
EDGE_TYPES = {
    "NONE": 1, "ROAD_BORDER": 2, "CURB": 3, "REGULATORY": 4, "VIRTUAL": 5, "LINE_THIN": 6, "LINE_THIN_DASHED": 7,
    "LINE_THICK": 8, "LINE_THICK_DASHED": 9, "PEDESTRIAN_MARKING": 10, "BIKE_MARKING": 11, "GUARD_RAIL": 12,
    "STOP": 13, "LINE_THIN_DOUBLE": 14, "LINE_THIN_DOUBLE_DASHED": 15,
}
# Words of map files that stand for an edge type under another name.
EDGE_WORDS = {
    "road_border": "ROAD_BORDER", "fence": "ROAD_BORDER", "wall": "ROAD_BORDER", "curbstone": "CURB", "guard_rail": "GUARD_RAIL",
    "regulatory_element": "REGULATORY", "virtual": "VIRTUAL", "pedestrian_marking": "PEDESTRIAN_MARKING",
    "bike_marking": "BIKE_MARKING", "stop_line": "STOP",
}
UNDEFINED = CLASS_CODES["undefined"]


def lookup(table: dict, key: Column, default=None) -> Column:
    """``table[key]`` with a default for keys that are missing or null."""
    if not table:
        return F.lit(default)
    found = F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), F.coalesce(key, F.lit("")))
    return found if default is None else F.coalesce(found, F.lit(default))


def class_code(name: Column, on_unknown: str = "undefined") -> Column:
    """The code of an agent class; unknown names are ``undefined``, or an error if on_unknown is "error"."""
    code = lookup(CLASS_CODES, F.lower(name))
    other = F.raise_error(F.concat(F.lit("unknown agent class: "), F.coalesce(name, F.lit("null")))) if on_unknown == "error" else F.lit(UNDEFINED)
    return F.when(code.isNotNull(), code).otherwise(other).cast("int")


def edge_type(kind: Column, subtype: Column | None = None) -> Column:
    """The edge type of a way's ``type`` and ``subtype`` tags; NONE for anything else."""
    codes = {word: EDGE_TYPES[name] for word, name in EDGE_WORDS.items()}
    dashed = F.coalesce(subtype == "dashed", F.lit(False)) if subtype is not None else F.lit(False)
    line = lambda plain, broken: F.when(dashed, EDGE_TYPES[broken]).otherwise(EDGE_TYPES[plain])
    return (
        F.when(kind == "line_thin", line("LINE_THIN", "LINE_THIN_DASHED"))
        .when(kind == "line_thick", line("LINE_THICK", "LINE_THICK_DASHED"))
        .otherwise(lookup(codes, kind, EDGE_TYPES["NONE"]))
        .cast("int")
    )


def dotted_category(name: Column, table: dict[str, dict[str, str] | str], default: str = "undefined") -> Column:
    """Two-level lookup of ``a.b.c``: by its first part, then by its second where the first maps to a table."""
    parts = F.split(name, r"\.")
    out = F.lit(default)
    for first, inner in table.items():
        value = F.lit(inner) if isinstance(inner, str) else lookup(inner, F.get(parts, F.lit(1)), default)
        out = F.when(F.get(parts, F.lit(0)) == first, value).otherwise(out)
    return F.when(name.isNull(), F.lit(default)).otherwise(out)


def first_status(tokens: Column, default: str = "unknown") -> Column:
    """The first of an array of attributes; the default where there is none."""
    return F.coalesce(F.get(tokens, F.lit(0)), F.lit(default))


def argmax(values: Column) -> Column:
    """Index of the greatest element of an array, the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def scoring_category(of_interest: Column) -> Column:
    return F.when(of_interest, 3).otherwise(0).cast("int")


def scored_categories(category: Column, sample: list[str], window) -> Column:
    """True for samples in which more than one agent has a category to be scored by: the sum is above 3."""
    return F.sum(category).over(window.partitionBy(*sample)) > 3


def category_mask(category: Column, valid: Column) -> Column:
    """Valid steps of agents whose category is above 1."""
    return (category > 1) & valid
