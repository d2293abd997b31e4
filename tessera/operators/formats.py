"""One contract for a format: how it is recognised, where its metadata is, what that says, and what its tiles are called.

A registry holds the formats in the order of their priority and is passed along a plan; adding one, or putting another in
its place, makes a new registry, so plans of different registries don't disturb each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from tessera.operators import detect, discover, parse, tileurl


@dataclass(frozen=True)
class FormatSpec:
    """urls and contents: patterns of URLs and pages. discover: Columns that lead to the metadata URL. parse: a projection of
    (request_id, url, body) to descriptors. tile_url: a Column of a planned tile's URL; of a keyed format it takes a key."""

    name: str
    urls: tuple[str, ...] = ()
    contents: tuple[str, ...] = ()
    discover: Callable[[], discover.Discovery] = discover.itself
    parse: Callable[[DataFrame], DataFrame] | None = None
    tile_url: Callable[..., Column] | None = None
    keyed: bool = False


class Formats:
    """Formats by priority, the first one first."""

    def __init__(self, specs: tuple[FormatSpec, ...]):
        if len({s.name for s in specs}) < len(specs):
            raise ValueError("names of formats repeat")
        self.specs = specs

    def __iter__(self) -> Iterator[FormatSpec]:
        return iter(self.specs)

    def __getitem__(self, name: str) -> FormatSpec:
        return next(s for s in self.specs if s.name == name)

    def add(self, spec: FormatSpec, before: str | None = None) -> Formats:
        """A registry with one more format: last, or before the one named; one of the same name takes its place instead."""
        if any(s.name == spec.name for s in self.specs) and before is None:
            return Formats(tuple(spec if s.name == spec.name else s for s in self.specs))
        rest = [s for s in self.specs if s.name != spec.name]
        at = len(rest) if before is None else next(i for i, s in enumerate(rest) if s.name == before)
        return Formats((*rest[:at], spec, *rest[at:]))

    def only(self, *names: str) -> Formats:
        return Formats(tuple(s for s in self.specs if s.name in names))

    @property
    def names(self) -> list[str]:
        return [s.name for s in self.specs]

    @property
    def rules(self) -> tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...]:
        return tuple((s.name, s.urls, s.contents) for s in self.specs)

    @property
    def discoveries(self) -> dict[str, Callable[[], discover.Discovery]]:
        return {s.name: s.discover for s in self.specs}

    @property
    def parsers(self) -> dict[str, Callable[[DataFrame], DataFrame]]:
        return {s.name: s.parse for s in self.specs if s.parse}

    def builders(self, keys: dict | None = None) -> dict[str, Callable[[], Column]]:
        """By name, with the keys of formats that take one; those without theirs are left out."""
        plain = {s.name: s.tile_url for s in self.specs if s.tile_url and not s.keyed}
        return plain | {s.name: (lambda s=s: s.tile_url(keys[s.name])) for s in self.specs if s.tile_url and s.keyed and s.name in (keys or {})}


BUILT_IN = Formats(
    tuple(FormatSpec(name, urls, contents, discover.DISCOVERIES[name], parse.PARSERS.get(name), tileurl.BUILDERS.get(name) or tileurl.KEYED.get(name), name in tileurl.KEYED) for name, urls, contents in detect.RULES)
)

#: The grid of an image as a function of SQL. It is an expression, so that inline() of it is pipelined with the scan, where
#: a lateral call of a table function of SQL would be planned as a join.
GRID = """
    CREATE OR REPLACE TEMPORARY FUNCTION tile_grid(width BIGINT, height BIGINT, tile_size INT, overlap INT)
    RETURNS ARRAY<STRUCT<x INT, y INT, tile_index BIGINT, px INT, py INT, tile_w INT, tile_h INT>>
    RETURN if(width > 0 AND height > 0 AND tile_size > 0,
      transform(sequence(0, CAST(ceil(width / CAST(tile_size AS DOUBLE)) * ceil(height / CAST(tile_size AS DOUBLE)) AS INT) - 1), k -> transform(array(named_struct(
          'x', CAST(k % ceil(width / CAST(tile_size AS DOUBLE)) AS INT), 'y', CAST(k DIV ceil(width / CAST(tile_size AS DOUBLE)) AS INT))), t -> transform(array(named_struct(
          'px', t.x * tile_size - if(t.x > 0, overlap, 0), 'py', t.y * tile_size - if(t.y > 0, overlap, 0))), p -> named_struct(
          'x', t.x, 'y', t.y, 'tile_index', CAST(k AS BIGINT), 'px', p.px, 'py', p.py,
          'tile_w', CAST(least((t.x + 1) * tile_size + overlap, width) - p.px AS INT), 'tile_h', CAST(least((t.y + 1) * tile_size + overlap, height) - p.py AS INT)))[0])[0]),
      array())"""


def register_sql(spark: SparkSession) -> None:
    """Makes tile_grid(width, height, tile_size, overlap) a function of the session's SQL: an array of tiles in reading order.

    SELECT image_id, t.* FROM (SELECT image_id, tile_grid(width, height, 256, 1) AS tiles FROM images), LATERAL inline(tiles) t
    has a row for each tile, its place and its size; overlap is what a tile shares with each neighbour. Images without a
    size have no tiles.
    """
    spark.sql(GRID)
