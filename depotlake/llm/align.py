"""Alignment of two tokenizers' tokens over the same bytes, by diagonal run skipping, and how often ids are linked corpus-wide.

Both tokenizers read a blank and the text. The running byte lengths of their tokens are two ascending arrays of ends. At the
current shift between the two indices, ever longer stretches are compared (1, 2, 4, ... tokens); a stretch that differs is
halved down to the first difference. What was equal is one-to-one and is jumped over. There an irregular group begins: the end
that lags is moved on until both meet, which gives the new shift. Texts of a batch are one sequence, as each text's end is common.

Two tokens are linked where their bytes overlap. Texts are encoded and aligned once; a table keeps each row's figures and its
different id pairs with their numbers. The number of documents that hold a pair is summed in tasks and then over all; the most
frequent pairs (at most COMMON) go to all tasks, and rows' other pairs are joined by the pair.

Null and empty texts, and texts that a tokenizer does not give back byte for byte, have no tokens: zeros and an empty string.
Texts are taken whole; each row is a document, also where it repeats another; an empty table gives an empty result; only the
id and the text column are read, whatever the others are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlake.llm import bpe
from depotlake.llm.common import at_most, materialize, per_batch, per_bytes, table

#: A: byte-level BPE, whose ranks are its ids (the file has the entries of byte_bpe_50k.json). B: BPE of pieces with byte fallback.
FIRST, SECOND = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Id pairs that all tasks get, pairs of rows that a task gathers before it sums them, and bytes of the texts that are aligned together.
COMMON, GATHER, TOGETHER = 1 << 20, 1 << 21, 1 << 21
#: A pair is one number: the first id times 2 ** SHIFT, and the second id. Ids of the first tokenizer are below 2 ** (31 - SHIFT).
SHIFT = 15
BLANK, MARK = b" ", "▁"
VOCABULARY = 1 << 16


class Pieces:
    """The second tokenizer in one worker, with the ids of the words met so far. A word begins with a blank: no piece goes on from another character to a blank."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        if any(MARK in p.lstrip(MARK) for p in names):
            raise ValueError("a piece has a blank after another character")
        self.clear()

    def clear(self) -> None:
        """Forgets all words but the lone blank, which the model would read as nothing."""
        self.place: dict[bytes, int] = {BLANK: 0}
        self.flat, self.start, self.count, self.same = np.array([self.model.piece_to_id(MARK)], np.int32), np.zeros(1, np.int64), np.ones(1, np.int64), np.ones(1, bool)

    def learn(self, words: list[bytes]) -> None:
        """Ids of new words: word number k has count[k] ids from flat[start[k]] on. The model puts a blank before what it reads, so it gets a word without its first blank."""
        found = self.model.encode([w[1:].decode("utf-8", "replace") for w in words], num_threads=1)
        count = np.fromiter(map(len, found), np.int64, len(found))
        same = (b"".join([self.bytes[i] for i in ids]) == w for ids, w in zip(found, words))
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.start = np.append(self.start, len(self.flat) + np.cumsum(count) - count)
        self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(found), np.int32, count.sum()))
        self.count, self.same = np.append(self.count, count), np.append(self.same, np.fromiter(same, bool, len(words)))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.place) > bpe.CACHE_PIECES:
            self.clear()
        new = [w for w in words if w not in self.place]
        if new:
            self.learn(new)
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))


def cuts(data: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Where words begin: at a text's start, and at a blank after what is no white space. Neither tokenizer has a token across such a place, or looks past it."""
    blank = np.flatnonzero(data == 0x20)
    before = [data[np.maximum(blank - k, 0)] for k in (1, 2, 3)]
    # white space beyond ASCII has two bytes, of which the first is 0xC2, or three; what only looks like it may stay uncut
    white = (before[0] == 0x20) | ((before[0] >= 0x09) & (before[0] <= 0x0D)) | (before[1] == 0xC2) | ((before[2] >= 0xE1) & (before[2] <= 0xE3))
    begins = np.zeros(len(data), bool)
    begins[blank[~white]] = True
    begins[offset[:-1][np.diff(offset) > 0]] = True
    return np.flatnonzero(begins)


def spread(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat that begin at start, one after another, and where each begins in that (and the end)."""
    before = np.concatenate([[0], np.cumsum(count)])
    return flat[np.repeat(start - before[:-1], count) + np.arange(before[-1])], before


def groups(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of tokens before each group's end, in both of two ascending arrays of ends whose last ends are equal."""
    a, b, n = first.tolist(), second.tolist(), len(first)
    i = j = 0
    begin, upto, shifts = [], [], []
    while i < n:
        shift, width, k = j - i, 1, i
        while k < n and a[k : k + width] == b[k + shift : k + shift + width]:
            k += width
            width *= 2
        if k < n:
            while width > 16:
                width //= 2
                if a[k : k + width] == b[k + shift : k + shift + width]:
                    k += width
            while a[k] == b[k + shift]:
                k += 1
        else:
            k = n
        begin.append(i)
        upto.append(k)
        shifts.append(shift)
        if k < n:
            i, j = k, k + shift
            x, y = a[i], b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            i, j = i + 1, j + 1
        else:
            i = n
    # each stretch gives a group for each token, and then an irregular group that ends where the next stretch begins
    begin, upto, shifts = (np.array(x, np.int64) for x in (begin, upto, shifts))
    size = upto - begin + 1
    if len(size) and upto[-1] == n:
        size[-1] -= 1
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    ends_a = np.repeat(begin, size) + step + 1
    ends_b = ends_a + np.repeat(shifts, size)
    last = (np.cumsum(size) - 1)[upto < n]
    after = np.flatnonzero(upto < n) + 1
    ends_a[last] = np.append(begin, n)[after]
    ends_b[last] = np.append(begin + shifts, len(second))[after]
    return ends_a, ends_b


class Aligned:
    """The tokens of a batch of texts, one text after another: ids, where each text's begin, where each group ends, and the links."""

    def __init__(self, first: bpe.Encoder, sizes: np.ndarray, second: Pieces, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        read = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        self.encode(first, second, read)
        if not self.same.all():
            self.encode(first, second, pc.if_else(pa.array(self.same), read, ""))
        self.end_a, self.end_b = np.cumsum(sizes[self.a]), np.cumsum(second.size[self.b])
        self.group_a, self.group_b = groups(self.end_a, self.end_b)
        self.of_group = np.searchsorted(self.group_a, self.of_a, "right")
        self.of_link = self.of_a + self.of_b - self.of_group

    def encode(self, first: bpe.Encoder, second: Pieces, texts: pa.Array) -> None:
        """Ids of the texts, each empty or with a blank at its start, where each text's begin (and the end), and whether the second tokenizer gives it back. Equal words are encoded once."""
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        offset, data = np.concatenate([[0], np.cumsum(size)]), "".join(texts.to_pylist()).encode()
        at = cuts(np.frombuffer(data, np.uint8), offset)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]).dictionary_encode()
        which, of_text = words.indices.to_numpy(), np.searchsorted(at, offset)
        number, _, of_word = first.pieces(words.dictionary.cast(pa.large_string()))
        ids, before = first.ids(number)
        start = before[of_word]
        self.a, upto = spread(ids, start[:-1][which], np.diff(start)[which])
        self.of_a = upto[of_text]
        place = second.numbers(words.dictionary.to_pylist())[which]
        self.b, upto = spread(second.flat, second.start[place], second.count[place])
        self.of_b = upto[of_text]
        wrong = np.concatenate([[0], np.cumsum(~second.same[place])])
        self.same = wrong[of_text[1:]] == wrong[of_text[:-1]]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The places of the tokens of each link: bytes between two neighbouring ends of either tokenizer belong to one token of each."""
        at_a, at_b = (np.bincount(end, minlength=(self.end_a[-1] if len(self.end_a) else 0) + 1).astype(bool) for end in (self.end_a, self.end_b))
        ends = np.flatnonzero(at_a | at_b)
        return np.cumsum(at_a)[ends] - at_a[ends], np.cumsum(at_b)[ends] - at_b[ends]

    def codes(self) -> np.ndarray:
        """The id pair of each link as one number."""
        a, b = self.links()
        return self.a[a].astype(np.int64) << SHIFT | self.b[b]

    def texts(self) -> np.ndarray:
        """The text of each link."""
        return np.repeat(np.arange(len(self.of_a) - 1), np.diff(self.of_link))


@lru_cache(2)
def tools(first: str, second: str) -> tuple[bpe.Encoder, np.ndarray, Pieces]:
    own, other = bpe.encoder(first), Pieces(second)
    if len(own.tokens) > VOCABULARY or len(other.size) > 1 << SHIFT:
        raise ValueError("a pair of ids doesn't fit in 31 bits")
    return own, pc.binary_length(own.tokens).to_numpy().astype(np.int64), other


def aligner(first: str | None = None, second: str | None = None) -> Callable[[pa.Array], Aligned]:
    paths = first or public_tokenizers.path(FIRST), second or public_tokenizers.path(SECOND)
    return lambda texts: Aligned(*tools(*paths), texts)


def align(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """doc_id, the ids of both tokenizers, and for each group the number of tokens of either up to its end."""
    of = aligner(first, second)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = of(batch.column(1))
        g = x.of_group
        within = [bpe.ragged(e - np.repeat(s[:-1], np.diff(g)), g) for e, s in ((x.group_a, x.of_a), (x.group_b, x.of_b))]
        return pa.RecordBatch.from_arrays([batch.column(0), bpe.ragged(x.a, x.of_a), bpe.ragged(x.b, x.of_b), *within], names=["doc_id", "a", "b", "ends_a", "ends_b"])

    return docs.select("doc_id", "text").mapInArrow(per_bytes(step, 1, TOGETHER), "doc_id long, a array<int>, b array<int>, ends_a array<int>, ends_b array<int>")


@lru_cache(1)
def names() -> pa.Array:
    """An id and what follows it: number k * VOCABULARY + id has the k-th of these marks."""
    return pa.array([b"%d%c" % (i, c) for c in b",|;" for i in range(VOCABULARY)], pa.large_binary())


def digests(x: Aligned) -> list[str]:
    """The hash of each text's groups: ids of the first tokenizer, a bar, ids of the second, with a semicolon between groups."""
    n = VOCABULARY
    size = lambda ends: np.diff(ends, prepend=0)
    before_b = np.concatenate([[0], x.group_b[:-1]]) if len(x.group_b) else x.group_b
    symbol = np.zeros(len(x.a) + len(x.b), np.int64)
    kind_a, kind_b = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
    kind_a[x.group_a - 1], kind_b[x.group_b - 1] = n, 2 * n
    symbol[np.arange(len(x.a)) + np.repeat(before_b, size(x.group_a))] = x.a + kind_a
    symbol[np.arange(len(x.b)) + np.repeat(x.group_a, size(x.group_b))] = x.b + kind_b
    return [hashlib.sha256(s[:-1]).hexdigest() if len(s) else "" for s in bpe.joined(names(), pa.array(symbol), x.of_a + x.of_b)]


FIGURES = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


def figures(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """For each row its number, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its different pairs with how often it has each; written as a table."""
    of = aligner(first, second)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, rows = of(batch.column(2)), batch.num_rows
        own = np.sort(x.texts() << 31 | x.codes())
        new = np.flatnonzero(np.diff(own, prepend=-1))
        upto = pa.array(np.searchsorted(own[new], np.arange(rows + 1) << 31), pa.int32())
        lists = [pa.ListArray.from_arrays(upto, pa.array(v.astype(np.int32))) for v in (own[new] & (1 << 31) - 1, np.diff(np.append(new, len(own))))]
        numbers = [pa.array(np.diff(v).astype(np.int64)) for v in (x.of_a, x.of_b, x.of_group, x.of_link)]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *numbers, pa.array(digests(x), pa.string()), *lists], names=[c.split()[0] for c in FIGURES.split(", ")])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(per_bytes(step, 2, TOGETHER), FIGURES)
    return materialize(rows, "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, the documents that have it, and whether no pair of the same first id has more; from the rows of figures()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, gathered = [], 0

        def summed() -> pa.RecordBatch:
            pairs = np.sort(np.concatenate(parts))
            new = np.flatnonzero(np.diff(pairs, prepend=-1))
            return pa.RecordBatch.from_arrays([pa.array(pairs[new]), pa.array(np.diff(np.append(new, len(pairs))))], names=["pair", "docs"])

        for batch in batches:
            parts.append(batch.column(0).flatten().to_numpy())
            gathered += len(parts[-1])
            if gathered > GATHER:
                yield summed()
                parts, gathered = [], 0
        if gathered:
            yield summed()

    counts = rows.select("pairs").mapInArrow(run, "pair int, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = materialize(counts, "pairs").withColumn("a", F.shiftright("pair", SHIFT))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))  # one row for each id of the vocabulary
    return materialize(counts.join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "pair-counts")


def common_pairs(counts: DataFrame, most: int = COMMON) -> pa.Table:
    """The pairs of the most documents, at most so many, by pair."""
    return at_most(counts, "docs", most).toArrow().sort_by("pair")


def measure(rows: DataFrame, counts: DataFrame, most: int = COMMON) -> DataFrame:
    """For each row of figures() doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    found = common_pairs(counts, most)
    shared = rows.sparkSession.sparkContext.broadcast(tuple(found[c].to_numpy() for c in ("pair", "docs", "best")))
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = FIGURES.replace("pairs array<int>", "n_best long, count_sum long, rest array<int>")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs, times, (known, docs_of, best_of) = batch.column(7), batch.column(8).flatten().to_numpy().astype(np.int64), shared.value
        ends = pairs.offsets.to_numpy().astype(np.int64) - pairs.offsets[0].as_py()
        own = pairs.flatten().dictionary_encode()
        different, which = own.dictionary.to_numpy(), own.indices.to_numpy()
        at = np.minimum(np.searchsorted(known, different), max(len(known) - 1, 0))
        is_known = known[at] == different if len(known) else np.zeros(len(different), bool)
        value = np.where(is_known, docs_of[at], 0) if len(known) else np.zeros(len(different), np.int64)
        best = is_known & best_of[at] if len(known) else is_known
        total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[ends])
        rare = ~is_known[which]
        cut = pa.array(np.concatenate([[0], np.cumsum(rare)])[ends], pa.int32())
        lists = [pa.ListArray.from_arrays(cut, pa.array(v[rare].astype(np.int32))) for v in (different[which], times)]
        return pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(total(best[which] * times)), pa.array(total(value[which] * times)), *lists], names=[c.split()[0] for c in schema.split(", ")])

    summed = rows.select(*kept, "pairs", "times").mapInArrow(per_batch(step, 256), schema)
    summed = materialize(summed, "links")
    rest = summed.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.times").alias("times"))
    rest = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("docs")).alias("more"))
    return summed.join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256",
    )


def scored(docs: DataFrame, most: int = COMMON) -> DataFrame:
    rows = figures(docs)
    return measure(rows, pair_counts(rows), most)


def op12_diagonal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
