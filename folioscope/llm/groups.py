"""Consolidating pairwise matches into groups (problem 3).

Connected components on a two-dimensional grid: both ends of a link are hashed into blocks, and each
partition holds the links of one pair of blocks (row, column). A local union-find replaces a partition's links
by stars: every vertex points to the vertex of least priority in its local component. Representatives are then
exchanged along rows and columns: of the several representatives of a vertex, that of least priority becomes
its parent, and the stars, with both ends replaced by their parents, are the links of the next round. Priorities
are scrambled anew in each round, so that long chains shrink by a constant factor a round; rounds go on until
the parents are stable, which is when no link is left.

The grid never has fewer than two blocks a side, so small inputs take the same way as large ones; more links give more blocks. It bounds the work of one task: a vertex that holds a third of all
links lies in one row of blocks, so its links are spread over all columns of that row. A round writes its links to the checkpoint folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut

#: Links that one partition of the grid should hold; the side of the grid follows from the number of links.
CELL_LINKS = 100_000


def side_of(total: int, cell_links: int = CELL_LINKS) -> int:
    """Blocks a side: enough cells for the links, and never fewer than two."""
    return max(2, math.isqrt(max(-(-total // cell_links), 1) - 1) + 1)


def priorities(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective scramble of 64-bit numbers, another order for each seed."""
    z = x.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xA3B195354A39B70D)
    return (z ^ (z >> np.uint64(32))).view(np.int64)


def local_stars(u: np.ndarray, v: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over links; for every vertex the vertex of least priority in its component."""
    ids = np.unique(np.concatenate([u, v]))
    names = ids[np.argsort(priorities(ids, seed), kind="stable")]
    place = np.empty(len(ids), dtype=np.int64)
    place[np.searchsorted(ids, names)] = np.arange(len(ids))
    a, b = place[np.searchsorted(ids, u)], place[np.searchsorted(ids, v)]
    parent = np.arange(len(names))
    while True:
        low = np.minimum(parent[a], parent[b])
        before = parent.copy()
        # Hook both roots to the smaller one, then halve the paths until they are flat.
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        if np.array_equal(parent, before):
            return names, names[parent]


def _cells(seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # All links of this task, contracted batch by batch, so that a task keeps stars and not links.
        u = v = np.empty(0, dtype=np.int64)
        for b in batches:
            if len(b):
                u, v = local_stars(np.concatenate([u, b["u"].to_numpy(np.int64)]), np.concatenate([v, b["v"].to_numpy(np.int64)]), seed)
        if len(u):
            yield pd.DataFrame({"x": u, "rep": v, "pr": priorities(v, seed)})

    return run


def components(links: DataFrame, u: str = "u", v: str = "v", cell_links: int = CELL_LINKS, most_rounds: int = 60, trace: list[dict] | None = None) -> DataFrame:
    """``x``, ``rep`` for every vertex in ``links`` (two bigint columns): equal ``rep`` means joined.

    Links with a null end join nothing and are left out; a vertex linked to itself is its own group; repeated
    links change nothing; an empty table gives an empty one. ``rep`` is a vertex of the group, not the smallest. ``trace`` gets
    the links and the side of the grid of each round.
    """
    edges = links.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u is not null and v is not null").distinct()
    edges = cut(edges)
    total, moves = edges.count(), []
    side = side_of(total, cell_links)
    for seed in range(most_rounds):
        if trace is not None:
            trace.append({"links": total, "side": side})
        row, col = F.pmod(F.xxhash64("u"), F.lit(side)), F.pmod(F.xxhash64("v"), F.lit(side))
        stars = cut(edges.repartition(side * side, row, col).mapInPandas(_cells(seed), "x long, rep long, pr long"))
        # Row and column exchange: of all representatives of a vertex, that of least priority is its parent.
        parents = cut(stars.groupBy("x").agg(F.min_by("rep", "pr").alias("p")))
        # A star (x, rep) becomes the link between both ends' parents. The pairs (p, rep) are made distinct, with
        # partial aggregation, before they meet the parents of their reps, so a hub arrives there as few rows.
        pairs = stars.filter("x <> rep").join(parents, "x").select(F.col("p").alias("u"), F.col("rep").alias("x")).distinct()
        edges = cut(pairs.join(parents, "x").filter("u <> p").select("u", F.col("p").alias("v")).distinct())
        moves.append(parents.select("x", F.col("p").alias("rep")))
        total = edges.count()
        if total == 0:
            # From the last round, which has the fewest vertices, back to the first: each round's vertices are followed once.
            out = moves.pop()
            while moves:
                out = _follow(moves.pop(), out)
            return out
        side = side_of(total, cell_links)
    raise RuntimeError("parents did not stabilise")


def _follow(known: DataFrame, moved: DataFrame, salts: int = 8) -> DataFrame:
    """``known`` with each representative replaced by the one it moved to; salted, as one may stand for most rows."""
    m = moved.filter("x <> rep").select(F.col("x").alias("_r"), F.col("rep").alias("_to"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"))
    k = known.withColumn("_k", F.pmod(F.xxhash64("x"), F.lit(salts)).cast("int"))
    return k.join(m, (F.col("rep") == F.col("_r")) & (F.col("_k") == F.col("_s")), "left").select("x", F.coalesce("_to", "rep").alias("rep"))


def groups(aliases: DataFrame, trace: list[dict] | None = None) -> DataFrame:
    """p3_found: ``entity_id``, ``group_id`` for every non-null entity_id of ``entity_aliases``.

    Entities and canonical records are separate series of numbers, so they become even and odd vertices.
    A null canonical_id joins nothing: an entity with no other link is a group by itself. ``group_id`` is the
    smallest entity_id of the group.
    """
    links = aliases.select((F.col("entity_id") * 2).alias("u"), (F.col("canonical_id") * 2 + 1).alias("v"))
    rep = components(links, trace=trace)
    ents = aliases.filter("entity_id is not null").select("entity_id").distinct()
    known = ents.join(rep.filter("x % 2 = 0").select((F.col("x") / 2).cast("long").alias("entity_id"), "rep"), "entity_id", "left")
    known = known.withColumn("rep", F.coalesce("rep", F.col("entity_id") * 2))
    least = known.groupBy("rep").agg(F.min("entity_id").alias("group_id"))
    return known.join(least, "rep").select("entity_id", "group_id")
