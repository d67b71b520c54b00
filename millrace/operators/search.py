"""Text, vector and geospatial search as exact expressions.

Points are ``[lon, lat]`` arrays or GeoJSON documents with ``coordinates``.
Nothing here needs an index: every search is one scan with a native
expression, and top-k is Spark's bounded heap per task.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import column_at

EARTH_METRES = 6378100.0

# text


def parse_text(search: str) -> tuple[list[str], list[str], list[str]]:
    """(words, phrases, excluded words) of a search string."""
    phrases = re.findall(r'"([^"]+)"', search)
    rest = re.sub(r'"[^"]*"', " ", search)
    terms = re.findall(r"(?<!\S)-?[^\s-]\S*", rest)
    return [t for t in terms if t[0] != "-"], phrases, [t[1:] for t in terms if t[0] == "-"]


_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def _folded(c: Column, spec: dict) -> Column:
    c = c if spec.get("$caseSensitive") else F.lower(c)
    return c if spec.get("$diacriticSensitive") else F.translate(c, *_ACCENTS)


def _fold(s: str, spec: dict) -> str:
    s = s if spec.get("$caseSensitive") else s.lower()
    return s if spec.get("$diacriticSensitive") else s.translate(str.maketrans(*_ACCENTS))


def text_fields(df: DataFrame, spec: dict) -> list[tuple[str, float]]:
    """Searched fields and weights: ``$fields`` or every string column."""
    given = spec.get("$fields")
    if isinstance(given, dict):
        return list(given.items())
    return [(f, 1.0) for f in given or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]]


def _hits(c: Column, word: str) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){re.escape(word)}(?![\p{{L}}\p{{N}}_])")), F.lit(0))


def text_filter(df: DataFrame, spec: dict) -> Column:
    words, phrases, without = ([_fold(x, spec) for x in xs] for xs in parse_text(spec["$search"]))
    cols = [_folded(column_at(df, f)[0].cast("string"), spec) for f, _ in text_fields(df, spec)]
    some = lambda x: F.greatest(*(_hits(c, x) for c in cols), F.lit(0)) > 0
    out = F.lit(bool(phrases))
    for w in words if not phrases else []:
        out = out | some(w)
    for p in phrases:
        out = out & some(p)
    for w in without:
        out = out & ~some(w)
    return out


def text_score(df: DataFrame, spec: dict) -> Column:
    """Weighted term frequency, damped by the text's length."""
    words, phrases, _ = ([_fold(x, spec) for x in xs] for xs in parse_text(spec["$search"]))
    total = F.lit(0.0)
    for f, weight in text_fields(df, spec):
        c = _folded(column_at(df, f)[0].cast("string"), spec)
        hits = sum((_hits(c, w) for w in words + phrases), F.lit(0))
        total = total + F.lit(float(weight)) * hits / (1 + F.ln(1 + F.coalesce(F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+")), F.lit(0)).cast("double")))
    return total


# vectors


def vector_score(c: Column, query: list[float], metric: str = "cosine") -> Column:
    """Similarity (cosine, inner product) or distance (euclidean) to a constant vector."""
    v = c.cast("array<double>")
    q = F.array(*(F.lit(float(x)) for x in query))
    fold = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    if metric in ("euclidean", "L2"):
        return F.sqrt(fold(F.zip_with(v, q, lambda a, b: (a - b) * (a - b))))
    dot = fold(F.zip_with(v, q, lambda a, b: a * b))
    if metric in ("dotProduct", "IP"):
        return dot
    return dot / (F.sqrt(fold(F.transform(v, lambda a: a * a))) * math.sqrt(sum(x * x for x in query)))


def vector_search(df: DataFrame, path: str, query: list[float], k: int, metric: str = "cosine", score: str = "__search_score", dimensions: int | None = None) -> DataFrame:
    """The k rows nearest to a vector, exactly: a scan and a bounded heap per task."""
    if len(query) > (dimensions or 16000):
        raise ValueError("a vector has 16000 dimensions at most")
    c, _ = column_at(df, path)
    scored = df.where(F.size(c) == len(query)).withColumn(score, vector_score(c, query, metric))
    by = F.col(score).asc() if metric in ("euclidean", "L2") else F.col(score).desc()
    return scored.orderBy(by).limit(k)


# places


def point(c: Column, kind: T.DataType | None) -> tuple[Column, Column]:
    if isinstance(kind, T.StructType):
        if "coordinates" in kind.names:
            c = c["coordinates"]
        else:
            return c[kind.names[0]].cast("double"), c[kind.names[1]].cast("double")
    return F.get(c, F.lit(0)).cast("double"), F.get(c, F.lit(1)).cast("double")


def planar(x: Column, y: Column, at: list[float]) -> Column:
    return F.sqrt((x - at[0]) * (x - at[0]) + (y - at[1]) * (y - at[1]))


def spherical(x: Column, y: Column, at: list[float]) -> Column:
    """Great-circle distance in metres."""
    a, b = F.radians(y), F.lit(math.radians(at[1]))
    h = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(x) - math.radians(at[0])) / 2), 2)
    return 2 * EARTH_METRES * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def _in_ring(x: Column, y: Column, ring: list[list[float]]) -> Column:
    """Even-odd rule; points on the border count as inside."""
    odd, border = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (x1, y1) == (x2, y2):
            continue
        if y1 != y2:
            cross = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            odd = odd + cross.cast("int")
        turn = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        border = border | ((F.abs(turn) < 1e-12) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
    return (odd % 2 == 1) | border


def _in_geometry(x: Column, y: Column, g: dict) -> Column:
    if g["type"] == "Polygon":
        if len(g["coordinates"]) > 1:
            raise ValueError("$geoWithin takes polygons without holes")
        return _in_ring(x, y, g["coordinates"][0])
    if g["type"] == "MultiPolygon":
        out = F.lit(False)
        for p in g["coordinates"]:
            out = out | _in_ring(x, y, p[0])
        return out
    raise ValueError(f"$geoWithin takes polygons, not {g['type']}")


def within(c: Column, kind, shape: dict) -> Column:
    x, y = point(c, kind)
    if "$box" in shape:
        (x1, y1), (x2, y2) = shape["$box"]
        out = x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2))
    elif "$center" in shape:
        at, r = shape["$center"]
        out = planar(x, y, at) <= r
    elif "$centerSphere" in shape:
        at, r = shape["$centerSphere"]
        out = spherical(x, y, at) <= r * EARTH_METRES
    elif "$polygon" in shape:
        out = _in_ring(x, y, shape["$polygon"])
    else:
        out = _in_geometry(x, y, shape["$geometry"])
    return F.coalesce(out, F.lit(False))


def intersects(c: Column, kind, shape: dict) -> Column:
    """A stored point against a constant geometry."""
    g, (x, y) = shape["$geometry"], point(c, kind)
    if g["type"] == "Point":
        return F.coalesce((x == g["coordinates"][0]) & (y == g["coordinates"][1]), F.lit(False))
    if g["type"] == "LineString":
        out = F.lit(False)
        for (x1, y1), (x2, y2) in zip(g["coordinates"], g["coordinates"][1:], strict=False):
            out = out | ((F.abs((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)) < 1e-12) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
        return F.coalesce(out, F.lit(False))
    return F.coalesce(_in_geometry(x, y, g), F.lit(False))


def near_spec(op: str, value, around: dict) -> tuple[list[float], bool, dict]:
    """(centre, spherical, distance bounds) of a $near condition."""
    if isinstance(value, dict) and "$geometry" in value:
        return value["$geometry"]["coordinates"], True, value
    at = list(value.values())[:2] if isinstance(value, dict) else value
    return at, op == "$nearSphere", around


def near_distance(c: Column, kind, op: str, value, around: dict) -> Column:
    at, sphere, _ = near_spec(op, value, around)
    x, y = point(c, kind)
    d = spherical(x, y, at) if sphere else planar(x, y, at)
    return d / EARTH_METRES if sphere and not (isinstance(value, dict) and "$geometry" in value) else d


def near_filter(c: Column, kind, op: str, value, around: dict) -> Column:
    d, bounds = near_distance(c, kind, op, value, around), near_spec(op, value, around)[2]
    out = d.isNotNull()
    if "$maxDistance" in bounds:
        out = out & (d <= bounds["$maxDistance"])
    if "$minDistance" in bounds:
        out = out & (d >= bounds["$minDistance"])
    return F.coalesce(out, F.lit(False))


def geo_near(df: DataFrame, spec: dict, matched) -> DataFrame:
    """$geoNear: rows by distance, with the distance in a field."""
    near = spec["near"]
    at = near["coordinates"] if isinstance(near, dict) and "coordinates" in near else near
    sphere = spec.get("spherical", isinstance(near, dict))
    c, kind = column_at(df, spec["key"])
    x, y = point(c, kind)
    d = (spherical(x, y, at) if sphere else planar(x, y, at)) * float(spec.get("distanceMultiplier", 1))
    if sphere and not isinstance(near, dict):
        d = d / EARTH_METRES
    name = spec.get("distanceField", "__distance")
    out = matched(df, spec.get("query", {})).withColumn(name, d).where(F.col(name).isNotNull())
    if "minDistance" in spec:
        out = out.where(F.col(name) >= spec["minDistance"] * spec.get("distanceMultiplier", 1))
    if "maxDistance" in spec:
        out = out.where(F.col(name) <= spec["maxDistance"] * spec.get("distanceMultiplier", 1))
    if "includeLocs" in spec:
        out = out.withColumn(spec["includeLocs"], c)
    return out.orderBy(name)
