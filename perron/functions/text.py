"""Text expressions: Column -> Column, no UDF."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import NAME_CORRECTIONS


@functools.cache
def _unaccent() -> tuple[str, str]:
    """Letters with marks and their base letters; combining marks stand last and so are deleted."""
    pairs = []
    for c in map(chr, range(0xC0, 0x250)):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            pairs.append((c, base))
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


def unaccent(x: Column) -> Column:
    return F.translate(x, *_unaccent())


def station_form_1(x: Column) -> Column:
    """Upper case, single spaces, no accents; hyphens, apostrophes and dots stay. TXT-01."""
    return unaccent(F.upper(F.trim(F.regexp_replace(x, r"\s+", " "))))


def station_form_2(x: Column) -> Column:
    """Upper case without accents and punctuation, hyphens included. TXT-02."""
    plain = F.translate(F.upper(x), "ÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝÇÑ", "AAAAAAEEEEIIIIOOOOOUUUUYCN")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def station_form_3(x: Column) -> Column:
    """A-Z, digits, hyphens and single spaces; null where nothing is left. TXT-03."""
    plain = F.regexp_replace(F.upper(unaccent(x)), r"[^A-Z0-9\s-]", "")
    return F.nullif(F.trim(F.regexp_replace(plain, r"\s+", " ")), F.lit(""))


def line_name(x: Column) -> Column:
    """Upper case, trimmed, first space removed. TXT-04."""
    return F.upper(F.regexp_replace(F.trim(x), "^([^ ]*) ", "$1"))


def train_type(relation: Column) -> Column:
    """TXT-05."""
    out = None
    for pattern, name in ((r"(?i)^IC[\s-]", "IC"), (r"(?i)^S[\s\d]", "S"), (r"(?i)^L[\s]", "L"), (r"(?i)^P$", "P"), (r"(?i)^CR[\s]", "CR")):
        out = (F if out is None else out).when(relation.rlike(pattern), name)
    return out.otherwise("UNKNOWN")


def works_type(text: Column) -> Column:
    """Kind of impact by keywords, first hit wins. TXT-06."""
    t = F.lower(F.coalesce(text, F.lit("")))
    has = lambda *words: functools.reduce(lambda a, b: a | b, [t.contains(w) for w in words])
    return (
        F.when(has("total", "closure", "tlc"), "total_closure").when(has("single", "unique", "enkel"), "single_track")
        .when(has("speed", "vitesse"), "speed_reduction").when(t == "", "none").otherwise("other")
    )


def works_level(kind: Column) -> Column:
    return F.when(kind == "total_closure", 3).when(kind == "single_track", 2).when(kind == "speed_reduction", 1).otherwise(0)


def group_id(train: Column, station: Column) -> Column:
    """TXT-07: a missing train is UNKNOWN, a missing station empty."""
    return F.concat(F.coalesce(train.cast("string"), F.lit("UNKNOWN")), F.lit("_"), F.coalesce(station, F.lit("")))


def strict_group_id(train: Column, station: Column) -> Column:
    """TXT-08: null where either part is."""
    return F.concat(train.cast("string"), F.lit("_"), station)


def corrected_name(x: Column) -> Column:
    """TXT-11: known mismatches, compared raw and normalised; the result is in form 1."""
    norm = station_form_1(x)
    table = F.create_map(*[F.lit(v) for pair in NAME_CORRECTIONS.items() for v in pair])
    return F.coalesce(F.element_at(table, x), F.element_at(table, norm), norm)


def lenient_float(x: Column) -> Column:
    """TXT-13: first comma is a dot, the longest numeric prefix counts, else null."""
    dot = F.regexp_replace(x, "^([^,]*),", "$1.")
    return F.nullif(F.regexp_extract(dot, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double")


def pair_part(x: Column, i: int) -> Column:
    """TXT-09: element of a "lat, lon" text."""
    return F.get(F.split(x, ", "), F.lit(i)).try_cast("double")


def point(x: Column) -> Column:
    """TXT-12: struct(lat, lon) of a geometry text; "a , b", then POINT(a b), then a coordinates array (lon, lat)."""
    number = r"(-?\d+(?:\.\d+)?)"
    shapes = ((number + r"\s*,\s*" + number, 1, 2), (r"(?i)POINT\s*\(\s*" + number + r"\s+" + number, 1, 2), (r'"coordinates"\s*:\s*\[\s*' + number + r"\s*,\s*" + number, 2, 1))
    out = None
    for pattern, lat, lon in shapes:
        both = F.struct(F.regexp_extract(x, pattern, lat).try_cast("double").alias("lat"), F.regexp_extract(x, pattern, lon).try_cast("double").alias("lon"))
        out = (F if out is None else out).when(x.rlike(pattern), both)
    return out


def identifiers(*candidates: Column) -> Column:
    """TXT-14: trimmed distinct non-empty identifiers in order."""
    return F.array_distinct(F.filter(F.transform(F.array(*candidates), lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != "")))
