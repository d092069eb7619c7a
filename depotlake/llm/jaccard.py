"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity at or over the threshold.

1. Each document's shingles (five lower-case words, split at ASCII white space; a shorter text is one shingle) become
   64-bit hashes. Documents with equal sets are one class, found by a grouped minimum; only classes go on.
2. 32 bands of 5 MinHash values propose pairs: two classes at 0.8 share none of them with a chance of 3e-6.
3. Within a bucket, one byte of each of the 160 MinHash values is compared, 16 at a time. A pair goes as soon as the posterior
   probability (uniform prior) that its similarity reaches the threshold is below the tolerance.
4. What is left connects classes to candidate groups. Inside these, pairs that pass the same test are verified by exact
   intersections of the sets, which also finds pairs that shared no bucket.

Large buckets and groups are split into chunks, and each task compares two chunks; pairs never become rows: a task returns
a count of links and one edge for each class. A class of a group with many chunks goes only where step 3 has left it a partner
(a second pass over such groups' buckets finds these chunks), so that a long chain of similar texts costs a few copies of each.
Groups of exact copies of any size are one row from step 1 on.

Texts of candidates are fetched by a broadcast of their ids while these are few (common.small), else by a shuffled join.

Null, empty and wordless texts have no shingles and link with nothing. Rows with the same id and text count as copies of each
other; the same id with another text is another row. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlake.llm.common import materialize, per_batch, small, table
from depotlake.llm.components import components, join_labels

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS, ROUND = 32, 5, 16
VALUES = BANDS * ROWS
#: Classes of a bucket's chunk, classes and shingles of a candidate group's chunk, and pairs that a task holds at once.
BUCKET_CLASSES, CHUNK_CLASSES, CHUNK_SHINGLES, PAIRS_AT_ONCE = 1024, 256, 1_000_000, 500_000
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
WORD_GAPS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and its inverse modulo 2 ** 64, for k below n."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    data = np.frombuffer("".join(low.to_pylist()).encode("utf-8", "surrogatepass"), np.uint8)
    text_at = np.concatenate([[0], np.cumsum(pc.binary_length(low).to_numpy(zero_copy_only=False).astype(np.int64))])
    n = len(data)
    if not n:
        return [np.zeros(0, np.uint64)] * len(texts)
    gap = WORD_GAPS[data]
    first = np.zeros(n + 1, bool)
    first[text_at] = True
    begins = np.flatnonzero(~gap & (np.concatenate([[True], gap[:-1]]) | first[:-1]))
    ends = np.flatnonzero(~gap & (np.concatenate([gap[1:], [True]]) | first[1:])) + 1
    up, down = powers(max(1 << 19, 1 << n.bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n])])
    word = mix((sums[ends] - sums[begins]) * down[begins])
    word_at = np.searchsorted(begins, text_at)
    count = np.diff(word_at)
    shingles = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    shingle_at = np.concatenate([[0], np.cumsum(shingles)])
    start = np.repeat(word_at[:-1] - shingle_at[:-1], shingles) + np.arange(shingle_at[-1])
    limit = np.repeat(word_at[1:], shingles)
    total = np.zeros(len(start), np.uint64)
    for k in range(words):
        at = start + k
        inside = at < limit
        total = total * np.uint64(STEP) + np.where(inside, word[np.where(inside, at, 0)], np.uint64(k))
    total = mix(total)
    return [np.unique(total[a:b]) for a, b in zip(shingle_at, shingle_at[1:])]


@lru_cache(1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(BASE))
    return (seeds[:VALUES] >> np.uint64(32)).astype(np.uint32)[:, None], (seeds[VALUES:] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)


def minhash(shingles: np.ndarray, at_once: int = 2048) -> np.ndarray:
    flip, factor = permutations()
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), at_once):
        low = np.minimum(low, ((x[None, k : k + at_once] ^ flip) * factor).min(axis=1))
    return low


def bytes_of(low: np.ndarray) -> np.ndarray:
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def bands_of(low: np.ndarray) -> np.ndarray:
    rows, out = low.reshape(BANDS, ROWS).astype(np.uint64), np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out * np.uint64(STEP) + rows[:, k])
    return out.view(np.int64)


def set_keys(shingles: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two independent keys, equal for equal sets: the first one's upper bits are the key, the other tells sets apart that share it."""
    sums = [mix(shingles ^ np.uint64(STEP)).sum(), mix(shingles + np.uint64(BASE)).sum()]
    first, second = mix(np.array([s + np.uint64(len(shingles)) for s in sums], np.uint64)).view(np.int64).tolist()
    return first >> (64 - bits), second


@lru_cache(8)
def least_matches(threshold: float, tolerance: float) -> list[int]:
    """After each round, the matches below which the posterior chance of reaching the threshold is under the tolerance.

    With a uniform prior for the chance that two bytes match, P(chance >= c | m of n) = P(Binomial(n + 1, c) <= m).
    """
    c, out = threshold + (1 - threshold) / 256, []
    for n in range(ROUND, VALUES + 1, ROUND):
        total, m = 0.0, 0
        while (total := total + comb(n + 1, m) * c**m * (1 - c) ** (n + 1 - m)) < tolerance:
            m += 1
        out.append(m)
    return out


def likely(sketch: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that the incremental comparison of MinHash bytes leaves."""
    matches = np.zeros(len(i), np.int16)
    for k, least in enumerate(least_matches(threshold, tolerance)):
        cut = slice(k * ROUND, (k + 1) * ROUND)
        matches = matches + (sketch[i, cut] == sketch[j, cut]).sum(1, dtype=np.int16)
        stay = matches >= least
        i, j, matches = i[stay], j[stay], matches[stay]
    return i, j


def pairs(block: np.ndarray, chunk: np.ndarray, crossed: np.ndarray, at_once: int = PAIRS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers i < j of all pairs of rows of one block, some at a time. Rows are sorted by block; crossed: only pairs of different chunks."""
    n = len(block)
    end = np.searchsorted(block, block, "right")
    more = end - np.arange(n) - 1
    upto = np.concatenate([[0], np.cumsum(more)])
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] + at_once, "right")) - 1)
        count = more[at:stop]
        i = np.repeat(np.arange(at, stop), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(upto[at:stop] - upto[at], count)
        keep = ~crossed[i] | (chunk[i] != chunk[j])
        yield i[keep], j[keep]
        at = stop


def by_block(step: Callable[[pa.Table], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows sorted by their block column: step gets tables of whole blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            block = rows.column("block").to_numpy()
            cut = int(np.searchsorted(block, block[-1])) if len(block) else 0
            rest = rows.slice(cut)
            if cut and (out := step(rows.slice(0, cut).combine_chunks())) is not None:
                yield out
        if rest is not None and rest.num_rows and (out := step(rest.combine_chunks())) is not None:
            yield out

    return run


def chunk_of(chunks: F.Column) -> F.Column:
    return F.pmod(F.xxhash64("set_key", F.lit(2)), chunks).cast("int")


def between(rows: DataFrame, group: str) -> DataFrame:
    """rows with chunk and other, the chunk that theirs is compared with, get block and crossed."""
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    return rows.withColumn("block", F.xxhash64(group, low, high)).withColumn("crossed", low != high)


def in_blocks(rows: DataFrame, group: str, size: F.Column) -> DataFrame:
    """rows, each in the blocks of its chunk and each chunk of its group, with block, chunk and crossed; size: chunks of the group."""
    rows = rows.withColumn("chunks", F.greatest(F.lit(1), size).cast("int")).withColumn("chunk", chunk_of(F.col("chunks")))
    return between(rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))), group)


def row_key() -> F.Column:
    """Equal for rows of the same id and text."""
    return F.xxhash64("doc_id", "text")


def sketches(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, row_key (of id and text), set_key and other_key, n (shingles), bands and sketch (bytes) of each document."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(2))
        low = [minhash(s) for s in sets]
        keys = np.array([set_keys(s, bits) for s in sets], np.int64).reshape(-1, 2)
        bands = pa.array([bands_of(x).tolist() if len(s) else [] for s, x in zip(sets, low)], pa.list_(pa.int64()))
        columns = [batch.column(0), batch.column(1), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(list(map(len, sets)), pa.int32()), bands, pa.array([bytes_of(x).tobytes() for x in low], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "set_key", "other_key", "n", "bands", "sketch"])

    return docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(per_batch(step), "doc_id long, row_key long, set_key long, other_key long, n int, bands array<long>, sketch binary")


def sketch_matrix(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, VALUES)


EDGES = "a long, b long"


def in_buckets(classes: DataFrame) -> DataFrame:
    """Rows of classes in the blocks of each bucket that they share with another class."""
    banded = classes.where("n > 0").select("set_key", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = banded.join(shared, "bucket").join(classes.drop("bands", "n"), "set_key")
    return in_blocks(met.withColumnRenamed("chunk", "own_chunk") if "chunk" in met.columns else met, "bucket", F.ceil(F.col("members") / BUCKET_CLASSES))


def candidate_edges(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Edges between classes that share a bucket and pass the incremental comparison: a star for each connected part of a bucket."""
    rows = in_buckets(classes.select("set_key", "n", "bands", "sketch")).select("block", "chunk", "crossed", "set_key", "sketch")

    def step(rows: pa.Table) -> pa.RecordBatch | None:
        sketch, keys = sketch_matrix(rows), rows.column("set_key").to_numpy()
        labels = np.arange(len(keys))
        for i, j in pairs(*(rows.column(c).to_numpy() for c in ("block", "chunk", "crossed"))):
            join_labels(labels, *likely(sketch, i, j, threshold, tolerance))
        tied = np.flatnonzero(labels != np.arange(len(keys)))
        return pa.RecordBatch.from_arrays([pa.array(keys[tied]), pa.array(keys[labels[tied]])], names=["a", "b"])

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(by_block(step), EDGES)


def partner_chunks(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """set_key and other: the chunks in which a class has partners that the incremental comparison leaves. classes: set_key, n, bands, sketch and chunk."""
    rows = in_buckets(classes).select("block", "chunk", "crossed", "set_key", "sketch", "own_chunk")

    def step(rows: pa.Table) -> pa.RecordBatch:
        sketch, keys, own = sketch_matrix(rows), rows.column("set_key").to_numpy(), rows.column("own_chunk").to_numpy()
        found = [np.zeros((0, 2), np.int64)]
        for i, j in pairs(*(rows.column(c).to_numpy() for c in ("block", "chunk", "crossed"))):
            i, j = likely(sketch, i, j, threshold, tolerance)
            found.append(np.unique(np.concatenate([np.stack([keys[i], own[j]], 1), np.stack([keys[j], own[i]], 1)]), axis=0))
        every = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1].astype(np.int32))], names=["set_key", "other"])

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(by_block(step), "set_key long, other int").distinct()


def shared_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets i and j: exact products of 0/1 matrices for many pairs, sorted merges for few."""
    rows = np.unique(np.concatenate([i, j]))
    if len(i) < 4 * len(rows):
        return np.array([np.intersect1d(sets[a], sets[b], assume_unique=True).size for a, b in zip(i.tolist(), j.tolist())], np.int64)
    place = {r: k for k, r in enumerate(rows.tolist())}
    values, own = np.concatenate([sets[r] for r in rows]), np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    _, column, often = np.unique(values, return_inverse=True, return_counts=True)
    useful = np.flatnonzero(often > 1)  # what one set alone has is in no intersection
    narrow = np.full(len(often), -1)
    narrow[useful] = np.arange(len(useful))
    column, keep = narrow[column], narrow[column] >= 0
    column, own = column[keep], own[keep]
    order = np.argsort(column, kind="stable")
    column, own = column[order], own[order]
    total = np.zeros((len(rows), len(rows)), np.float32)
    for low in range(0, len(useful), 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((len(rows), min(4096, len(useful) - low)), np.float32)
        part[own[a:b], column[a:b] - low] = 1
        total += part @ part.T
    at = np.fromiter(map(place.__getitem__, i.tolist()), int, len(i)), np.fromiter(map(place.__getitem__, j.tolist()), int, len(j))
    return total[at].astype(np.int64)


def verified(grouped: DataFrame, docs: DataFrame, threshold: float, tolerance: float, bits: int = 64) -> DataFrame:
    """set_key, links (documents of other classes linked, in this block) and to, the smallest class of its connected part of the block.

    grouped: set_key, doc_id and row_key (of a document of the class), copies, n, root, bands and sketch of the classes in candidate groups.
    """
    sizes = grouped.groupBy("root").agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("classes"))
    chunks = F.greatest(F.ceil(F.col("shingles") / CHUNK_SHINGLES), F.ceil(F.col("classes") / CHUNK_CLASSES)).cast("int")
    wanted = materialize(grouped.join(sizes.select("root", chunks.alias("size")), "root").withColumn("chunk", chunk_of(F.col("size"))), "candidates")
    texts = docs.select(row_key().alias("row_key"), "text").join(small(wanted.select("row_key", "set_key"), wanted.count()), "row_key")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shingle_sets(batch.column(0))
        right = [k in set_keys(s, bits) for s, k in zip(found, batch.column(1).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array([s.tobytes() for s in found], pa.binary())], names=["set_key", "shingles"]).filter(pa.array(right))

    own = materialize(texts.select("text", "set_key").mapInArrow(per_batch(sets), "set_key long, shingles binary").dropDuplicates(["set_key"]), "shingles")  # repeated rows of a document
    shown = ["set_key", "root", "chunk", "copies", "sketch"]
    alone = wanted.where("size = 1").select(*shown, F.lit(0).alias("other"))
    large = wanted.where("size > 1")
    spread = large.select(shown).join(partner_chunks(large.select("set_key", "n", "bands", "sketch", "chunk"), threshold, tolerance), "set_key").select(*shown, "other")
    rows = between(alone.unionByName(spread).join(own, "set_key"), "root").select("block", "chunk", "crossed", "set_key", "copies", "shingles", "sketch")

    def step(rows: pa.Table) -> pa.RecordBatch:
        keys, block = rows.column("set_key").to_numpy(), rows.column("block").to_numpy()
        order = np.lexsort([keys, block])
        rows = rows.take(pa.array(order))
        keys, copies, sketch = keys[order], rows.column("copies").to_numpy(), sketch_matrix(rows)
        own = [np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()]
        size, labels, links = np.array(list(map(len, own))), np.arange(len(keys)), np.zeros(len(keys), np.int64)
        for i, j in pairs(*(rows.column(c).to_numpy() for c in ("block", "chunk", "crossed"))):
            i, j = likely(sketch, i, j, threshold, tolerance)
            for a, b in spans(block[order][i]):
                p, q = i[a:b], j[a:b]
                both = shared_counts(own, p, q)
                linked = both >= threshold * (size[p] + size[q] - both) - 1e-9
                np.add.at(links, p[linked], copies[q[linked]])
                np.add.at(links, q[linked], copies[p[linked]])
                join_labels(labels, p[linked], q[linked])
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[some], links[some], keys[labels[some]])], names=["set_key", "links", "to"])

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(by_block(step), "set_key long, links long, to long")


def spans(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """First and last place + 1 of each run of equal values."""
    cut = np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])
    return [(a, b) for a, b in zip(cut.tolist(), cut[1:].tolist()) if b > a]


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, key_bits: int = 64) -> DataFrame:
    """doc_id, class_id (smallest id with the same shingles), n_links (other rows linked directly), component_id (smallest id reachable), kept (one row of each component, or rows equal to it) and row_key."""
    docs = docs.select("doc_id", "text")
    sketched = materialize(sketches(docs, key_bits), "sketches")
    own = F.when(F.col("n") > 0, F.col("set_key")).otherwise(F.xxhash64("row_key", F.lit("alone")))  # texts without words don't meet
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")

    def grouped_by(key: Column) -> DataFrame:
        return materialize(sketched.withColumn("set_key", key).groupBy("set_key").agg(
            F.min(row).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
            (F.min("other_key") != F.max("other_key")).alias("clash"),
        ), "classes")

    classes = grouped_by(own)
    clashes = [r["set_key"] for r in classes.where("clash and n > 0").select("set_key").collect()]  # none, but for 1 of 2e18 pairs of sets
    if clashes:  # different sets under one key go by their other key
        own = F.when(own.isin(clashes), F.col("other_key")).otherwise(own)
        classes = grouped_by(own)
    groups = components(candidate_edges(classes, threshold, tolerance))
    grouped = groups.select(F.col("node").alias("set_key"), "root").join(classes.select("set_key", "rep.row_key", "copies", "n", "bands", "sketch"), "set_key")
    found = materialize(verified(grouped, docs, threshold, tolerance, key_bits), "links")
    parts = components(found.select(F.col("set_key").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("set_key").agg(F.sum("links").alias("links"))
    placed = classes.select("set_key", "rep", "copies", "n").join(links, "set_key", "left").join(parts.withColumnRenamed("node", "set_key"), "set_key", "left")
    placed = materialize(placed.withColumn("root", F.coalesce("root", "set_key")), "placed")
    first = placed.where("links is not null").groupBy("root").agg(F.min("rep").alias("first"))
    linked = F.when(F.col("n") > 0, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).alias("n_links")
    head = F.coalesce("first", "rep")
    of_class = placed.join(first, "root", "left").select("set_key", F.col("rep.doc_id").alias("class_id"), linked, head["doc_id"].alias("component_id"), head["row_key"].alias("kept_key"))
    out = sketched.select("doc_id", "row_key", own.alias("set_key")).join(materialize(of_class, "answers"), "set_key")
    return out.select("doc_id", "class_id", "n_links", "component_id", (F.col("row_key") == F.col("kept_key")).alias("kept"), "row_key")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that are kept: the smallest id of each group, once.

    Rows go by their id and the hash of id and text; rows that repeat another as a whole, id and text, are compared as such.
    While there are few to remove (common.small) the texts stay where they are.
    """
    similar = similar_documents(docs, threshold).select("doc_id", "row_key", "kept")
    gone = materialize(similar.where(~F.col("kept")).select("doc_id", "row_key").distinct(), "removed")
    repeated = materialize(similar.where("kept").groupBy("doc_id", "row_key").count().where("count > 1").select("doc_id", "row_key"), "repeated")
    own = docs.columns
    keyed = docs.withColumn("mark_row", row_key())
    same = lambda other: docs["doc_id"].eqNullSafe(other["doc_id"]) & (F.col("mark_row") == other["row_key"])
    some, many = small(gone, gone.count()), small(repeated, repeated.count())
    left = keyed.join(some, same(some), "left_anti")
    once = left.join(many, same(many), "left_anti").select(own)
    return once.union(left.join(many, same(many), "left_semi").dropDuplicates(["doc_id", "text"]).select(own))


def op2_bayesian_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).drop("row_key")
