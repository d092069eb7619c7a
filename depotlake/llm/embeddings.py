"""Near-duplicate embeddings by an inverted multi-index.

The two halves of the unit vectors have a codebook each; a cell of their product grid holds the vectors that are nearest to
both its centroids. A vector visits cells in the order of the sum of both distances (multi-sequence order) until the number
of cells is reached at which, on the sample, neighbours are found with the target recall: such as are placed at exactly the
threshold in random directions and in those in which the sample's vectors differ, and the sample's own similar pairs.
In each cell the cosine of every visitor with every member is computed in double precision; nothing below the threshold links.
A pair is found if either of the two visits the other's cell, and counts once.

Vectors of each length have a grid of their own. The codebooks are fitted on a bounded sample of each length (SAMPLE vectors by
hash, more for larger grids, within SAMPLE_BYTES); all vectors are indexed and all visit. A codebook has about the square
root of n / PER_CELL centroids, MOST_CENTROIDS at most: with over 5e8 vectors cells grow, which the chunks bear. Equal vectors
are one member with a number of copies. Cells are split into chunks of members and visitors, so that a task's work is bounded.

Vectors that are null, zero, or have null or non-finite components link with nothing. Rows with equal vectors, also of the same
id, are copies of each other. Labels and extra columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlake.llm.common import materialize, per_batch, small, table, unit_hash
from depotlake.llm.components import components, join_labels
from depotlake.llm.jaccard import by_block, spans

THRESHOLD, RECALL, PER_CELL, CHUNK = 0.9, 0.97, 32, 2048
#: Vectors of a sample at least, and for each centroid; bytes of a sample, and centroids of a codebook at most; rows of a slice on the driver.
SAMPLE, PER_CENTROID, SAMPLE_BYTES, MOST_CENTROIDS, SLICE = 4096, 16, 1 << 26, 4096, 1024


def distances(half: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum((half * half).sum(1)[:, None] - 2 * half @ book.T + (book * book).sum(1)[None, :], 0)


def sliced(n: int, rows: int) -> Iterator[slice]:
    return (slice(at, at + rows) for at in range(0, n, rows))


def codebook(half: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; a centroid without vectors stays where it is."""
    book = half[np.linspace(0, len(half) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([distances(half[at], book).argmin(1) for at in sliced(len(half), SLICE)])
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        some = np.flatnonzero(count)
        sums = np.add.reduceat(half[order], (np.cumsum(count) - count)[some], axis=0)
        book[some] = sums / count[some, None]
    return book


@lru_cache(8)
def corner(cells: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ranks that can be among the first cells: all pairs at or below (i, j) come before it, so (i + 1)(j + 1) is at most cells."""
    most = np.minimum(cells // np.arange(1, min(k, cells) + 1), k)
    i = np.repeat(np.arange(len(most)), most)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(most) - most, most)


def visits(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], cells: int) -> np.ndarray:
    """The first cells of each vector in multi-sequence order, nearest first; a cell's number is first x k + second."""
    k, middle = len(books[0]), books[0].shape[1]
    i, j = corner(cells, k)
    out = []
    for at in sliced(len(x), max(16, 2_000_000 // max(len(i), 2 * k))):
        d = [distances(x[at, :middle], books[0]), distances(x[at, middle:], books[1])]
        order = [y.argsort(1, kind="stable") for y in d]
        near = [np.take_along_axis(y, o, 1) for y, o in zip(d, order)]
        best = (near[0][:, i] + near[1][:, j]).argsort(1, kind="stable")[:, :cells]
        out.append(np.take_along_axis(order[0], i[best], 1) * k + np.take_along_axis(order[1], j[best], 1))
    return np.concatenate(out) if out else np.zeros((0, cells), int)


def ranks(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], cell: np.ndarray) -> np.ndarray:
    """How many cells are nearer to each vector than its given one, counted without listing them."""
    k, middle, out = len(books[0]), books[0].shape[1], []
    for row, c in zip(x, cell):
        first, second = distances(row[None, :middle], books[0])[0], distances(row[None, middle:], books[1])[0]
        out.append(np.searchsorted(np.sort(second), first[c // k] + second[c % k] - first).sum())
    return np.array(out)


def neighbours(x: np.ndarray, threshold: float, random: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of vectors (rows of the sample, their neighbours): placed at the threshold in a random direction, towards another vector of the sample, towards one of those that are near, against the one that is away from it, and pairs of the sample that are similar themselves."""
    some, n = x[:1024], len(x)
    cos = some @ x.T
    cos[np.arange(len(some)), np.arange(len(some))] = -2
    like = np.argwhere(cos >= threshold)
    near = np.where(cos < threshold, cos, -2).argpartition(-min(8, n), 1)[:, -min(8, n) :]
    other = random.integers(0, n, (3, len(some)))
    ways = [
        random.normal(size=some.shape), x[other[0]] - some, x[other[1]] - x[other[2]],
        x[np.take_along_axis(near, random.integers(0, near.shape[1], (len(some), 1)), 1)[:, 0]] - some,
    ]
    for way in ways:
        away = way - (way * some).sum(1, keepdims=True) * some
        size = np.linalg.norm(away, axis=1, keepdims=True)
        rows = np.flatnonzero(size[:, 0] > 1e-9)
        if len(rows):
            yield some[rows], threshold * some[rows] + np.sqrt(1 - threshold**2) * away[rows] / size[rows]
    if len(like):
        like = like[random.permutation(len(like))[:2048]]
        yield some[like[:, 0]], x[like[:, 1]]


def cells_for(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], threshold: float, recall: float, seed: int = 6) -> int:
    """Cells to visit so that of each kind of neighbours the target recall is found by either side: the sample's own directions, as real vectors differ in them, and random ones."""
    most = 1
    for a, b in neighbours(x, threshold, np.random.default_rng(seed)):
        there, back = visits(a, books, 1)[:, 0], visits(b, books, 1)[:, 0]
        rank = np.minimum(ranks(a, books, back), ranks(b, books, there))
        most = max(most, int(np.quantile(rank, recall, method="higher")) + 1)
    return most


def centroids(n: int, dim: int) -> int:
    """Centroids of each codebook for n vectors, a power of two."""
    most = min(MOST_CENTROIDS, max(2, SAMPLE_BYTES // (8 * dim) // 4))
    k = 2 ** round(np.log2(max(n / PER_CELL, 1)) / 2)
    return int(min(k, 2 ** int(np.log2(most))))


def sample_size(n: int, dim: int) -> int:
    return min(max(SAMPLE, PER_CENTROID * centroids(n, dim)), SAMPLE_BYTES // (8 * dim))


def fit(sample: np.ndarray, n: int, threshold: float, recall: float) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """Codebooks and the number of cells to visit, for n vectors."""
    k = min(centroids(n, sample.shape[1]), len(sample))
    middle = sample.shape[1] // 2
    books = codebook(sample[:, :middle], k), codebook(sample[:, middle:], k)
    return books, cells_for(sample, books, threshold, recall)


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(vectors: pa.Array) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # before squares, for very small and large numbers
    return x / np.linalg.norm(x, axis=1, keepdims=True)


Grid = tuple[tuple[np.ndarray, np.ndarray], int]


def grid_of(good: DataFrame, n: int, dim: int, threshold: float, recall: float) -> Grid:
    """Codebooks and cells to visit for the n vectors of one length."""
    own, size = good.where(F.size("v") == dim).select("set_key", "v"), sample_size(n, dim)
    sample = own.where(unit_hash("set_key", seed=6) < 0.9 * size / n).orderBy("set_key").limit(size).toArrow()
    if sample.num_rows < min(n, size) // 2:  # few vectors, of which the hash has taken fewer
        sample = own.orderBy("set_key").limit(size).toArrow()
    return fit(matrix(sample.column("v").combine_chunks()), n, threshold, recall)


def placed_in(good: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    """set_key, copies, v and visits: the cells of its length's grid that a vector visits, its own first."""

    def visit(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = batch.column(2)
        size, out = v.value_lengths().to_numpy(), [None] * len(v)
        for dim in np.unique(size).tolist():
            rows = np.flatnonzero(size == dim)
            for k, seen in zip(rows.tolist(), visits(matrix(v.take(pa.array(rows))), *grids[dim]).tolist()):
                out[k] = seen
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=["set_key", "copies", "v", "visits"])

    return good.select("set_key", "copies", "v").mapInArrow(per_batch(visit, 1024), "set_key long, copies long, v array<double>, visits array<int>")


def similar_vectors(rows: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, key_bits: int = 64) -> DataFrame:
    """key, n_links, component_id, kept and class_id (the smallest key with an equal vector) of each row."""
    rows = rows.select(F.col(key).alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    # a vector that can't link is a class of its own, by its id
    def keyed_by(clashes: list[int]) -> DataFrame:
        hashed = F.shiftright(F.xxhash64("v", F.lit(1)), 64 - key_bits)
        hashed = F.when(hashed.isin(clashes), F.xxhash64("v", F.lit(2))).otherwise(hashed) if clashes else hashed  # different vectors under one key go by another hash
        return rows.withColumn("good", usable(F.col("v"))).withColumn("set_key", F.when(F.col("good"), hashed).otherwise(F.xxhash64("vec_id", F.lit("alone"))))

    def grouped(keyed: DataFrame) -> DataFrame:
        other = F.xxhash64("v", F.lit(2))
        clash = F.first("good") & (F.min(other) != F.max(other))
        return materialize(keyed.groupBy("set_key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("good").alias("good"), F.first("v").alias("v"), clash.alias("clash")), "vectors")

    keyed = keyed_by([])
    classes = grouped(keyed)
    clashes = [r["set_key"] for r in classes.where("clash").select("set_key").collect()]  # none, but for 1 of 2e18 pairs of vectors
    if clashes:
        keyed = keyed_by(clashes)
        classes = grouped(keyed)
    good, members = classes.where("good"), keyed.select("vec_id", "set_key")
    lengths = good.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each length
    if not lengths:
        return members.select(F.col("vec_id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.col("vec_id").alias("class_id"))
    grids = {r["dim"]: grid_of(good, r["n"], r["dim"], threshold, recall) for r in lengths}
    placed = materialize(placed_in(good, grids).withColumns({"cell": F.element_at("visits", 1), "dim": F.size("v")}), "cells")
    own = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("members"))
    come = placed.select("dim", F.explode("visits").alias("cell")).groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("visitors"))
    sizes = own.join(come, ["dim", "cell"]).select("dim", "cell", F.ceil(F.col("members") / CHUNK).cast("int").alias("gm"), F.ceil(F.col("visitors") / CHUNK).cast("int").alias("gv"))
    sizes = materialize(sizes, "cell-sizes")
    sizes = small(sizes, sizes.count())
    part = lambda groups: F.pmod(F.xxhash64("set_key", F.lit(3)), F.col(groups)).cast("int")
    each = lambda groups: F.explode(F.sequence(F.lit(0), F.col(groups) - 1))
    shown = ["set_key", "copies", "v", "dim", "cell", "own", "visits", "here", "m", "q"]
    homes = placed.withColumn("own", F.col("cell")).withColumn("here", F.lit(True)).join(sizes, ["dim", "cell"]).withColumn("m", part("gm")).withColumn("q", each("gv")).select(shown)
    guests = placed.select("set_key", "copies", "v", "dim", F.col("cell").alias("own"), F.explode("visits").alias("cell"), F.array().cast("array<int>").alias("visits"))
    guests = guests.withColumn("here", F.lit(False)).join(sizes, ["dim", "cell"]).withColumn("q", part("gv")).withColumn("m", each("gm")).select(shown)
    blocks = homes.union(guests).withColumn("block", F.xxhash64("dim", "cell", "m", "q")).drop("m", "q", "cell", "dim")

    def compare(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by([("block", "ascending")]).combine_chunks()
        keys, copies, here, home = (rows.column(c).to_numpy() for c in ("set_key", "copies", "here", "own"))
        v, seen = rows.column("v").combine_chunks(), rows.column("visits").combine_chunks()
        unique, label_at = np.unique(keys, return_inverse=True)
        labels, links = np.arange(len(unique)), np.zeros(len(unique), np.int64)
        for a, b in spans(rows.column("block").to_numpy()):
            m, q = a + np.flatnonzero(here[a:b]), a + np.flatnonzero(~here[a:b])
            if not len(m) or not len(q):
                continue
            x = matrix(v.slice(a, b - a))
            known = seen.take(pa.array(m)).flatten().to_numpy().reshape(len(m), -1)  # all members of a cell visit as many
            for at in sliced(len(q), 512):
                i, j = np.nonzero(x[q[at] - a] @ x[m - a].T >= threshold)
                i, place = q[at][i], j
                j = m[j]
                other = keys[i] != keys[j]
                i, j, place = i[other], j[other], place[other]
                np.add.at(links, label_at[i], copies[j])
                alone = np.concatenate([np.zeros(0, bool), *[~(known[place[p]] == home[i[p]][:, None]).any(1) for p in sliced(len(i), 8192)]])  # the member doesn't visit the visitor
                np.add.at(links, label_at[j[alone]], copies[i[alone]])
                join_labels(labels, label_at[i], label_at[j])
        some = np.flatnonzero((links > 0) | (labels != np.arange(len(labels))))
        return pa.RecordBatch.from_arrays([pa.array(y) for y in (unique[some], links[some], unique[labels[some]])], names=["set_key", "links", "to"])

    found = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(by_block(compare), "set_key long, links long, to long")
    found = materialize(found, "vector-links")
    parts = components(found.select(F.col("set_key").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "set_key")
    links = found.groupBy("set_key").agg(F.sum("links").alias("links"))
    answer = classes.select("set_key", "rep", "copies", "good").join(links, "set_key", "left").join(parts, "set_key", "left")
    answer = materialize(answer.withColumn("root", F.coalesce("root", "set_key")), "vector-parts")
    first = answer.groupBy("root").agg(F.min("rep").alias("component_id"))
    count = F.when(F.col("good"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).cast("long")
    answer = materialize(answer.join(first, "root").select("set_key", count.alias("n_links"), "component_id", F.col("rep").alias("class_id")), "vector-answers")
    out = members.join(answer, "set_key")
    return out.select(F.col("vec_id").alias(key), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")


def op6_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))
