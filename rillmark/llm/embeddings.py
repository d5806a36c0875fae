"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative per group.

Centroids are fitted on a bounded sample and every vector goes to its nearest one. A pair above the threshold may
straddle cells; by the triangle inequality on angles, x has such a partner at home in cell j only if x is within
the threshold angle of the half-space nearer to c_j and within (cell radius + threshold angle) of c_j. x visits
exactly those cells, so no link is lost. Cells are split into blocks; members and visitors of a block meet in dense
double-precision products. Links are counted where they are found; a block emits counts and one edge per vector
towards the smallest id of its part of the block, never the pairs.

Large groups of copies do not cost the square of their size: vectors within half the threshold angle of one centre are
all linked with each other. Such balls are found on the sample and made cells of their own, whose inner links are
counted from their size; only vectors from outside are compared with their members.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import materialize, ragged, shuffle_width, table, tidy
from rillmark.llm.graph import connected_components

#: Cells grow with the square root of the table beyond MIN_CELLS; the sample holds SAMPLE_EACH rows a cell, at least
#: SAMPLE_ROWS and at most SAMPLE_NUMBERS numbers (128 MB).
THRESHOLD, BLOCK, MIN_CELLS, SAMPLE_NUMBERS, SAMPLE_ROWS, SAMPLE_EACH = 0.95, 2048, 1024, 16_000_000, 20_000, 8
MAX_BALLS, BALL_ROWS, DENSE = 256, 8_000, 16
FAR = np.iinfo(np.int64).max


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of equal length as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)  # squares of tiny or huge numbers stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, turns: int = 8, seed: int = 7, most: int = 1024) -> np.ndarray:
    """k unit centroids (fewer if there are fewer rows); an empty cell keeps its centroid. Beyond ``most`` cells the
    rows are first dealt to about sqrt(k) of them, and each part gets its share of the k."""
    if k > most:
        top = spherical_kmeans(x, int(np.ceil(np.sqrt(k))), turns, seed)
        home = (x @ top.T).argmax(axis=1)
        return np.vstack([spherical_kmeans(x[home == i], max(1, round(k * n / len(x))), turns, seed) for i, n in enumerate(np.bincount(home)) if n])
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(turns):
        home = np.concatenate([(x[i : i + 8192] @ c.T).argmax(axis=1) for i in range(0, len(x), 8192)])
        order = np.argsort(home, kind="stable")
        cells, first = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        norm = np.linalg.norm(sums, axis=1)
        c[cells[norm > 1e-12]] = (sums / np.maximum(norm, 1e-300)[:, None])[norm > 1e-12]
    return c


def dense_centres(x: np.ndarray, threshold: float, dense: int, most: int = MAX_BALLS) -> np.ndarray:
    """Centres of balls (of half the threshold angle) that hold at least ``dense`` rows of the sample, largest first."""
    half = np.sqrt((1 + threshold) / 2)
    count = np.concatenate([(x[i : i + 512] @ x.T >= half).sum(axis=1) for i in range(0, len(x), 512)]) if len(x) else np.zeros(0, int)
    free, out = np.ones(len(x), bool), []
    for i in np.argsort(-count, kind="stable"):
        if count[i] < dense or len(out) == most:
            break
        if free[i]:
            near = x @ x[i] >= half
            centre = x[near].mean(axis=0)
            centre /= np.linalg.norm(centre)
            free &= x @ centre < half
            out.append(centre)
    return np.array(out).reshape(-1, x.shape[1])


class Cells:
    """Where a vector is at home: in the first ball that holds it, else with the nearest centroid. Balls come last."""

    def __init__(self, centroids: np.ndarray, balls: np.ndarray, threshold: float):
        self.centroids, self.balls, self.angle = centroids, balls, float(np.arccos(threshold))
        self.inside = np.sqrt((1 + threshold) / 2) + 1e-9
        self.rows = max(16, min(4096, 4_000_000 // max(len(centroids), 1)))  # vectors that are handled at a time

    def __len__(self) -> int:
        return len(self.centroids) + len(self.balls)

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and the cosine with its centre."""
        dots = x @ self.centroids.T
        cell, dot = dots.argmax(axis=1), dots.max(axis=1)
        if len(self.balls):
            in_ball = x @ self.balls.T
            held = (in_ball >= self.inside).any(axis=1)
            ball = (in_ball >= self.inside).argmax(axis=1)
            cell = np.where(held, len(self.centroids) + ball, cell)
            dot = np.where(held, in_ball[np.arange(len(x)), ball], dot)
        return cell, dot

    def visits(self, x: np.ndarray, home: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Which cells of higher number each vector must visit (rows by cells): all that may hold a partner of it."""
        dots = x @ np.vstack([self.centroids, self.balls]).T
        near = np.arccos(np.clip(dots, -1, 1)) <= np.minimum(radius + self.angle, np.pi)[None, :] + 1e-6
        plain = dots[:, : len(self.centroids)]
        first = plain.argmax(axis=1)  # a partner at home in cell j is nearer to c_j than to the vector's nearest centroid
        gap = np.sqrt(np.maximum(2 - 2 * (self.centroids[first] @ self.centroids.T), 0))
        near[:, : len(self.centroids)] &= plain[np.arange(len(x)), first][:, None] - plain <= np.sin(self.angle) * gap + 1e-6
        return near & (np.arange(len(self))[None, :] > home[:, None])


def _components(links: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id of each row's and column's component in a block of links."""
    while True:
        was = rows.copy(), columns.copy()
        rows = np.minimum(rows, np.where(links, columns[None, :], FAR).min(axis=1))
        columns = np.minimum(columns, np.where(links, rows[:, None], FAR).min(axis=0))
        if (rows == was[0]).all() and (columns == was[1]).all():
            return rows, columns


class Block:
    """The members of a block, and what is found when vectors are compared with them."""

    def __init__(self, threshold: float):
        self.threshold, self.x, self.ids, self.copies = threshold, [], [], []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def join(self, x: np.ndarray, ids: np.ndarray, copies: np.ndarray, member: bool, ball: bool, rows: int = 512) -> None:
        """Compares the vectors with all members so far, and among each other if they are members too; members of a
        ball are known to be linked and are not compared."""
        for i in range(0, len(ids), rows):
            part = slice(i, i + rows)
            xs, ns, cs = x[part], ids[part], copies[part]
            if not (member and ball):
                for mx, mn, mc in zip(self.x, self.ids, self.copies, strict=True):
                    self._meet(xs @ mx.T >= self.threshold, ns, cs, mn, mc)
            if member:
                if not ball:
                    self._meet(np.triu(xs @ xs.T >= self.threshold, 1), ns, cs, ns, cs)
                self.x.append(xs)
                self.ids.append(ns)
                self.copies.append(cs)

    def _meet(self, links: np.ndarray, n: np.ndarray, c: np.ndarray, mn: np.ndarray, mc: np.ndarray) -> None:
        r, k = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
        if not len(r):
            return
        links = links[np.ix_(r, k)]
        low_r, low_k = _components(links, n[r], mn[k])
        self.found += [(n[r], (links * mc[k][None, :]).sum(axis=1), low_r), (mn[k], (links * c[r][:, None]).sum(axis=0), low_k)]

    def take(self) -> pa.RecordBatch:
        got = [np.concatenate(x) for x in zip(*self.found, strict=True)] if self.found else [np.zeros(0, np.int64)] * 3
        self.found = []
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in got], ["node", "links", "low"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK, max_cells: int | None = None, dense: int = DENSE) -> DataFrame:
    """(id, n_links, component_id, kept) for every row, over all links of cosine >= threshold.

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing, and no others than those
    of their own length. Equal vectors stand for one another in the comparison and are linked. Rows of equal id count
    as rows each; ids must be whole numbers (rows with others, or none, are left out). An empty table gives an empty one.
    """
    v = F.col("v")
    usable = F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null").withColumn("ok", usable)
    nodes = materialize(rows.where("ok").groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "vectors")
    sizes = nodes.groupBy(F.size("v").alias("d")).count()
    large = {r["d"]: r["count"] for r in sizes.where(F.col("count") > block).collect()}  # lengths of more than a block of vectors
    found = [_linked(nodes.where(F.size("v") == d), d, n, threshold, block, max_cells, dense) for d, n in sorted(large.items())]
    small = nodes.where(~F.size("v").isin([*large])) if large else nodes
    found.append(_met(small.select(F.size("v").cast("long").alias("unit"), F.lit(False).alias("visitor"), "v", "node", "copies"), threshold, FAR, shuffle_width(vectors.sparkSession)))
    found = materialize(reduce(DataFrame.union, found), "vector-links")
    roots = connected_components(found.where("low != node").select(F.col("node").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(links, "node", "left").join(roots, "node", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    out = rows.where("ok").join(named, "v").select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("id") == F.col("component_id"))


def _met(dealt: DataFrame, threshold: float, first_ball: int, width: int) -> DataFrame:
    """(node, links, low): what the vectors of each unit find among its members; units from ``first_ball`` on are balls."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Block(threshold)
        for batch in batches:
            unit, visitor = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((unit[1:] != unit[:-1]) | (visitor[1:] != visitor[:-1])) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(unit)], strict=True):
                if i == j:
                    continue
                if unit[i] != now:
                    now, held = unit[i], Block(threshold)
                part = batch.slice(i, j - i)
                held.join(matrix(part.column(2)), part.column(3).to_numpy(), part.column(4).to_numpy(), member=not visitor[i], ball=unit[i] >= first_ball)
                yield held.take()

    return dealt.repartition(width, "unit").sortWithinPartitions("unit", "visitor").mapInArrow(tidy(compare), "node long, links long, low long")


def _linked(nodes: DataFrame, dim: int, count: int, threshold: float, block: int, max_cells: int | None, dense: int) -> DataFrame:
    """(node, links, low) of the vectors of one length, through cells."""
    k = min(-(-count // block), max_cells or max(MIN_CELLS, 2 * math.isqrt(count)), max(1, SAMPLE_NUMBERS // dim // 4))
    limit = max(1, min(max(SAMPLE_ROWS, SAMPLE_EACH * k), SAMPLE_NUMBERS // dim))  # a sample of bounded size, whatever the table's
    sample = matrix(nodes.orderBy(F.xxhash64("node")).limit(limit).select("v").toArrow()["v"].combine_chunks())
    cells = Cells(spherical_kmeans(sample, k), dense_centres(sample[:BALL_ROWS], threshold, dense), threshold)
    n_plain = len(cells.centroids)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, cells.rows):
                part = batch.slice(i, cells.rows)
                home, dot = cells.home(matrix(part.column(0)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int32)), pa.array(dot)], ["v", "node", "copies", "cell", "dot"])

    kind = nodes.schema["v"].dataType.simpleString()
    homes = materialize(nodes.mapInArrow(tidy(assign), f"v {kind}, node long, copies long, cell int, dot double"), "cells")
    blocks, radius = np.zeros(len(cells), np.int64), np.full(len(cells), -10.0)
    inner, lowest = np.zeros(len(cells), np.int64), np.zeros(len(cells), np.int64)
    stats = homes.groupBy("cell").agg(F.count("*").alias("n"), F.min("dot").alias("dot"), F.sum("copies").alias("copies"), F.min("node").alias("low"))
    for r in stats.collect():  # one row a cell: their number is bounded by the sample's
        blocks[r["cell"]], radius[r["cell"]] = -(-r["n"] // block), np.arccos(np.clip(r["dot"], -1, 1))
        inner[r["cell"]], lowest[r["cell"]] = r["copies"], r["low"]
    base = np.cumsum(blocks) - blocks

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, cells.rows // 4):
                part = batch.slice(i, cells.rows // 4)
                x, node, home = matrix(part.column(0)), part.column(1).to_numpy(), part.column(3).to_numpy().astype(np.int64)
                own = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks[home]
                row, cell = np.nonzero(cells.visits(x, home, radius))
                row, cell = row[blocks[cell] > 0], cell[blocks[cell] > 0]
                later = np.where(home < n_plain, blocks[home] - own - 1, 0)
                unit = np.concatenate([base[home] + own, ragged(base[home] + own + 1, later), ragged(base[cell], blocks[cell])])
                who = np.concatenate([np.arange(len(x)), np.repeat(np.arange(len(x)), later), np.repeat(row, blocks[cell])])
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(np.arange(len(unit)) >= len(x)), *(part.column(c).take(take) for c in range(3))], ["unit", "visitor", "v", "node", "copies"])

    dealt = homes.mapInArrow(tidy(deal), f"unit long, visitor boolean, v {kind}, node long, copies long")
    first_ball = int(base[n_plain]) if len(cells.balls) else int(blocks.sum())

    def within_balls(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, copies, cell = (batch.column(c).to_numpy() for c in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(inner[cell] - copies), pa.array(lowest[cell])], ["node", "links", "low"])

    width = max(shuffle_width(nodes.sparkSession), min(int(blocks.sum()), 4096))
    balls = homes.where(F.col("cell") >= n_plain).select("node", "copies", "cell").mapInArrow(tidy(within_balls), "node long, links long, low long")
    return _met(dealt, threshold, first_ball, width).union(balls)


def op1(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95e0
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.x = e.vec_id)::BIGINT AS n_links,
  (SELECT min(y) FROM reach r WHERE r.x = e.vec_id)::BIGINT AS component_id,
  e.vec_id = (SELECT min(y) FROM reach r WHERE r.x = e.vec_id) AS kept
FROM embeddings e
"""
