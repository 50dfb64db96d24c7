"""Classify URLs by ordered route patterns.

Patterns are compiled to a table: segments (what stands between slashes) are literals or :names. Patterns
with the same number of segments and literals in the same places are one shape; a path is looked up once per
shape, by its segments in those places, and the least place in the list of what it finds is the first pattern that
matches. So the expression grows with the shapes, of which there are few, not with the routes. A * at the
end, in a segment of its own, is a shape open at its end; patterns with other stars, or names within a segment, are
compared one by one.

A path's percent codes are decoded in parameters, where a plus stays a plus; query keys and values are form-encoded, where it
is a space. Of repeated keys the first counts, of repeated names in a pattern the last. Codes that are no UTF-8 give null; such
a key is left out. A null URL is "/".
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.sources.tables import fresh

# A name within a pattern.
NAME = r":([A-Za-z_]+)"
_BETWEEN = "\x1e"


@dataclass
class Shape:
    """Patterns of so many segments with literals in these places; open at the end or not."""

    segments: int
    literals: tuple[int, ...]
    open: bool
    ranks: dict[str, int] = field(default_factory=dict)  # the literals, joined by slashes -> the first such pattern's place


@dataclass
class Routes:
    """A route list, compiled."""

    patterns: list[str]
    shapes: list[Shape]
    regexes: dict[int, str]  # of the patterns that have no shape
    names: list[list[str]]
    places: list[list[int]]  # of the names among the segments; for patterns without a shape, among the groups


def regex(pattern: str) -> tuple[str, list[str]]:
    """A pattern as a regular expression, and its names."""
    out = []
    for part in re.split(rf"({NAME[0]}{NAME[2:-1]}|\*)", pattern.rstrip("/")):
        out.append(".*" if part == "*" else "([^/]+)" if re.fullmatch(NAME, part) else re.sub(r"([.^$+?()\[\]{}|\\])", r"\\\1", part))
    return "^" + "".join(out) + "/?$", re.findall(NAME, pattern)


def compiled(patterns: list[str]) -> Routes:
    shapes: dict[tuple, Shape] = {}
    out = Routes(patterns, [], {}, [], [])
    for rank, pattern in enumerate(patterns):
        segments = pattern.rstrip("/").split("/")
        is_open = len(segments) > 1 and segments[-1] == "*"
        segments = segments[:-1] if is_open else segments
        named = [i for i, s in enumerate(segments) if re.fullmatch(NAME, s)]
        if any("*" in s or re.search(NAME, s) and i not in named for i, s in enumerate(segments)):
            text, names = regex(pattern)
            out.regexes[rank] = text
            places = list(range(1, len(names) + 1))
        else:
            literals = tuple(i for i in range(len(segments)) if i not in named)
            shape = shapes.setdefault((len(segments), literals, is_open), Shape(len(segments), literals, is_open))
            shape.ranks.setdefault("/".join(segments[i] for i in literals), rank)
            names, places = [segments[i][1:] for i in named], named
        last = dict(zip(names, places, strict=True))
        out.names.append(list(last))
        out.places.append(list(last.values()))
    out.shapes = list(shapes.values())
    return out


def _list(values: list[str]) -> Column:
    """A constant array; one literal, as a call per value would cost more than the planning."""
    return F.split(F.lit(_BETWEEN.join(values)), _BETWEEN)


def _map(pairs: dict[str, int]) -> Column:
    return F.map_from_arrays(_list(list(pairs)), _list([str(v) for v in pairs.values()]).cast("array<int>"))


def _rank(shape: Shape, parts: str, trimmed: str) -> Column:
    """The least rank of a shape's patterns that match; null if none does."""
    own = parts if shape.open else trimmed
    key = F.concat_ws("/", *[F.get(own, F.lit(i)) for i in shape.literals]) if shape.literals else F.lit("")
    fits = F.size(own) > shape.segments if shape.open else F.size(own) == shape.segments
    for i in range(shape.segments):
        if i not in shape.literals:
            fits = fits & (F.get(own, F.lit(i)) != "")
    return F.when(fits, F.try_element_at(_map(shape.ranks), key))


def decoded(c: Column) -> Column:
    """Percent codes decoded; a plus stays."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def first_of_each(pairs: Column) -> Column:
    """A map from structs (k, v): the first of each key."""
    keys = F.transform(pairs, lambda p: p["k"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1))


def query_map(asked: Column) -> Column:
    """The query of a URL as a map."""
    pieces = F.filter(F.split(asked, "&"), lambda x: x != "")
    value = lambda x: F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")
    pairs = F.transform(pieces, lambda x: F.struct(F.try_url_decode(F.substring_index(x, "=", 1)).alias("k"), F.try_url_decode(value(x)).alias("v")))
    return first_of_each(F.filter(pairs, lambda p: p["k"].isNotNull()))


def route_urls(df: DataFrame, url: str, routes: list[str]) -> DataFrame:
    """df with path, query (a map), route (the first pattern that matches, or null) and params (a map); columns of these names are replaced."""
    table = compiled(routes)
    rest, parts, trimmed, rank = fresh(df, "_rest", "_parts", "_trimmed", "_rank")
    # Each projection names what the one before has worked out once.
    rows = df.withColumn(rest, F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""))
    path, asked = F.regexp_extract(rest, r"^([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    rows = rows.withColumns({"path": F.when(path == "", "/").otherwise(path), "query": query_map(asked)})
    rows = rows.withColumns({parts: F.split("path", "/"), trimmed: F.split(F.regexp_replace("path", "/$", ""), "/")})
    ranks = [_rank(s, parts, trimmed) for s in table.shapes] + [F.when(F.col("path").rlike(r), F.lit(i)) for i, r in table.regexes.items()]
    none = F.lit(None).cast("int")
    rows = rows.withColumn(rank, F.least(*ranks, none, none))
    at = lambda values: F.get(_list(values), F.col(rank))
    names, places = (F.split(at(["/".join(map(str, x)) for x in each]), "/") for each in (table.names, table.places))
    texts = at([table.regexes.get(i, "") for i in range(len(routes))])

    def found(i: Column) -> Column:
        place = i.cast("int")
        segment = F.get(trimmed, place)
        return F.when(F.col(rank).isin(*table.regexes), F.call_function("regexp_extract", F.col("path"), texts, place)).otherwise(segment) if table.regexes else segment

    empty = F.create_map().cast("map<string,string>")
    params = F.when((F.size(names) > 0) & (names[0] != ""), F.map_from_arrays(names, F.transform(places, lambda i: decoded(found(i))))).otherwise(empty)
    return rows.withColumns({"route": at(routes), "params": params}).drop(rest, parts, trimmed, rank)
