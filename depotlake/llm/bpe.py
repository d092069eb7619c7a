"""Byte-level BPE: pre-tokenisation without regex, cached pair merging, decoding, and the histogram of encoded lengths.

Pre-tokenisation follows public_tokenizers.PATTERN. Each code point becomes a symbol of a small automaton (its class, and
for white space and apostrophes what comes next); each symbol is a function from state to state. The functions that can
arise by composing them are few, so a composition is one look-up, and as it is associative, the states before all code
points of a batch of documents come from a blocked prefix scan over arrays. A boundary depends on state and symbol.

Null texts count as empty and have no tokens; texts of any length are taken whole; repeated rows are encoded each by
itself; an empty table gives an empty result; only the id and the text column are read, whatever the others are called.
"""

from __future__ import annotations

import hashlib
import heapq
from base64 import b64decode
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotlake.llm.common import materialize, per_batch, per_bytes, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces after which a worker forgets those it has met, and bytes of a piece from which merging uses a heap.
CACHE_PIECES, LONG_PIECE = 400_000, 96

# The pattern's white space (Unicode White_Space) and what its contractions have after the apostrophe.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT, LONG = "stmd", ("re", "ve", "ll")

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Symbols: letter, number, other, apostrophe before one or two letters of a contraction, blank before a non-space, white space before white space or the end, other white space before a non-space.
S_L, S_N, S_O, S_A1, S_A2, S_BLANK, S_INNER, S_LAST = range(8)
#: States: in a run of letters, numbers, others; after a blank that belongs to what follows; in white space; at a sure boundary; one or two letters before a contraction's end.
IN_L, IN_N, IN_O, JOIN, IN_W, CUT, LEFT1, LEFT2 = range(8)


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point. Letters and numbers are those of the library whose ids are to be matched, whichever Unicode version it has."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        only = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = only.decode_bytes(only.encode_ordinary(every)).decode().encode("utf-32-le")
        out[np.frombuffer(found, np.uint32)] = kind
    out[WHITE_SPACE] = SPACE
    return out


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """compose[f, g]: f, then g; apply[f, state]; code of each symbol, then of each symbol at a text's start; boundary[state, symbol]."""
    runs = {S_L: IN_L, S_N: IN_N, S_O: IN_O}
    step, boundary = np.zeros((8, 8), int), np.ones((8, 8), bool)  # by state, symbol
    for state in range(8):
        for s, own in runs.items():
            step[state, s], boundary[state, s] = own, state not in (own, JOIN)
        for s, after in ((S_A1, LEFT1), (S_A2, LEFT2)):
            joined = state in (IN_O, JOIN)
            step[state, s], boundary[state, s] = IN_O if joined else after, not joined
        step[state, [S_BLANK, S_INNER, S_LAST]] = JOIN, IN_W, CUT
        boundary[state, S_INNER] = state != IN_W
    step[LEFT2, S_L], step[LEFT1, S_L], boundary[[LEFT1, LEFT2], S_L] = LEFT1, CUT, False
    first = [tuple(step[:, s]) for s in range(8)] + [(step[CUT, s],) * 8 for s in range(8)]
    found = {tuple(range(8)): 0}
    todo = list(found)
    while todo:
        f = todo.pop()
        for g in first:
            h = tuple(g[x] for x in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    apply = np.array(list(found), np.uint8)
    compose = np.array([[found[tuple(g[x] for x in f)] for g in found] for f in found], np.uint8)
    return compose, apply, np.array([found[tuple(map(int, f))] for f in first], np.uint8), boundary


def scan(f: np.ndarray, compose: np.ndarray, width: int = 64) -> np.ndarray:
    """For each place, the composition of all functions before it, by blocks of so many places and their totals."""
    if len(f) <= width:
        out = np.zeros(len(f), np.uint8)
        for k in range(1, len(f)):
            out[k] = compose[out[k - 1], f[k - 1]]
        return out
    n, flat = compose.shape[0], compose.ravel()
    padded = np.zeros(-(-len(f) // width) * width, np.uint8)
    padded[: len(f)] = f
    across = np.ascontiguousarray(padded.reshape(-1, width).T)
    before = np.zeros_like(across)
    for k in range(1, width):
        before[k] = flat.take(before[k - 1].astype(np.intp) * n + across[k - 1])
    totals = flat.take(before[-1].astype(np.intp) * n + across[-1])
    into = scan(totals, compose, width).astype(np.intp) * n
    return flat.take(into + before).T.reshape(-1)[: len(f)]


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """True where a piece begins. points: code points of all texts, one after another; starts: where the non-empty texts begin."""
    compose, apply, codes, boundary = automaton()
    kind = classes()[points]
    n, last = len(points), np.zeros(len(points), bool)
    first = np.zeros(n, bool)
    first[starts] = True
    last[:-1], last[-1] = first[1:], True
    follows = np.append(kind[1:], SPACE)
    follows[last] = SPACE
    symbol = kind.copy()
    white = np.flatnonzero(kind == SPACE)
    symbol[white] = np.where(follows[white] == SPACE, S_INNER, np.where(points[white] == 0x20, S_BLANK, S_LAST))
    quotes = np.flatnonzero((points == 0x27) & ~last)
    if len(quotes):
        next1 = points[quotes + 1]
        next2 = np.where(last[quotes + 1], 0, points[np.minimum(quotes + 2, n - 1)])
        symbol[quotes[np.isin(next1, [ord(c) for c in SHORT])]] = S_A1
        for a, b in LONG:
            symbol[quotes[(next1 == ord(a)) & (next2 == ord(b))]] = S_A2
    before = apply[scan(codes[symbol + 8 * first.astype(np.uint8)], compose), CUT]
    return boundary[before, symbol] | first


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of a piece: the adjacent pair of the lowest rank is joined, leftmost first, until no pair has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    if len(piece) > LONG_PIECE:
        return merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks)
    pair = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pair:
        low = min(pair)
        if low == none:
            break
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return tuple(ranks[p] for p in parts)


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same in n log n: candidate pairs wait in a heap, and outdated ones are passed over."""
    n = len(piece)
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, i, upto = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != upto:
            continue
        alive[j], end[i] = 0, upto
        if upto < n:
            prev[upto] = i
        for a in (prev[i], i):
            if a >= 0 and end[a] < n and (r := ranks.get(piece[a : end[end[a]]])) is not None:
                heapq.heappush(heap, (r, a, end[end[a]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return tuple(out)


NONE = np.int32(2**31 - 1)
#: Pieces of at most so many bytes are merged together, in matrices of these widths.
WIDTHS = (8, 16, 32)
#: The first 0 to 8 bytes of a little-endian integer.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Merges:
    """The rank of each pair of tokens that a merge can join, for arrays of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    found[a << 32 | b] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.ranks = np.array([*(found[k] for k in self.keys.tolist()), NONE], np.int32)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        every = np.repeat(self.single, 256), np.tile(self.single, 256)
        self.of_bytes = self.of(*every).reshape(256, 256)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); NONE where there is none or either is negative."""
        key = a.astype(np.int64) << 32 | np.maximum(b, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def together(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, which are the rows of data up to size, one after another, and how many each has. Each round joins, in every word that has one, the leftmost pair of the lowest rank."""
        width = data.shape[1]
        inside = np.arange(width) < size[:, None]
        done = np.where(inside, self.single[data], -1).astype(np.int32)
        pair = np.where(inside[:, 1:], self.of_bytes[data[:, :-1], data[:, 1:]], NONE)
        pair = np.concatenate([pair, np.full((len(data), 1), NONE)], 1).astype(np.int32)
        rows, ids = np.arange(len(data)), done
        column = np.arange(width)
        while True:
            j = pair.argmin(1)
            low = pair[np.arange(len(rows)), j]
            live = low < NONE
            if not live.all():
                done[rows[~live]] = ids[~live]
                rows, ids, pair, j, low = rows[live], ids[live], pair[live], j[live], low[live]
            if not len(rows):
                break
            each, at = np.arange(len(rows)), j[:, None]
            ids = np.concatenate([ids, np.full((len(rows), 1), -1, np.int32)], 1)
            ids = np.take_along_axis(ids, column + (column > at), 1)
            pair = np.concatenate([pair, np.full((len(rows), 1), NONE)], 1)
            pair = np.take_along_axis(pair, column + (column >= at), 1)
            ids[each, j] = low
            pair[each, j] = self.of(low, np.where(j + 1 < width, ids[each, np.minimum(j + 1, width - 1)], -1))
            left = np.flatnonzero(j > 0)
            pair[left, j[left] - 1] = self.of(ids[left, j[left] - 1], low[left])
        used = done >= 0
        return done[used], used.sum(1)


class Encoder:
    """Ranks, their bytes by id, and the ids of the pieces met so far, in one worker: piece number k has count[k] ids from flat[start[k]] on."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        self.names = pa.array([b"%d," % i for i in range(len(tokens))], pa.large_binary())
        self.merges = Merges(self.ranks)
        self.clear()

    def clear(self) -> None:
        """Forgets all but the tokens of a word's length."""
        self.place: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 17, np.int32), 0
        self.start, self.count, self.known = np.zeros(1 << 17, np.int64), np.zeros(1 << 17, np.int64), 0
        short = [t for t in self.ranks if len(t) <= 8 and b"\0" not in t]
        keys = np.frombuffer(b"".join(t.ljust(8, b"\0") for t in short), "<u8")
        order = np.argsort(keys)
        ids = np.fromiter(map(self.ranks.__getitem__, short), np.int32, len(short))[order]
        self.keys, self.key_place = keys[order], self.add(ids, np.ones(len(ids), np.int64))

    def add(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Numbers of new pieces with these ids."""
        n, k, ends = self.known, len(count), self.used + np.cumsum(count)
        while n + k > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.start[n : n + k], self.count[n : n + k] = ends - count, count
        self.flat[self.used : self.used + len(ids)] = ids
        self.used, self.known = self.used + len(ids), n + k
        return np.arange(n, n + k)

    def short_numbers(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of pieces of at most 8 bytes without a zero byte; a key is such a piece as an integer."""
        different, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.keys, different)
        new = different[self.keys[np.minimum(at, len(self.keys) - 1)] != different]
        if len(new):
            data = new.view(np.uint8).reshape(-1, 8)
            added = self.add(*self.merges.together(data, (data != 0).sum(1)))
            places = np.searchsorted(self.keys, new)
            self.keys, self.key_place = np.insert(self.keys, places, new), np.insert(self.key_place, places, added)
            at = np.searchsorted(self.keys, different)
        return self.key_place[at][back]

    def long_numbers(self, words: pa.LargeBinaryArray) -> np.ndarray:
        """Numbers of any other pieces; new ones of up to the last width are merged together, by width."""
        words = words.dictionary_encode()
        different = words.dictionary.to_pylist()
        by_width: dict[int, list[bytes]] = {w: [] for w in WIDTHS}
        alone: dict[bytes, tuple[int, ...]] = {}
        for piece in different:
            if piece not in self.place:
                whole = self.ranks.get(piece)
                if whole is not None:
                    alone[piece] = (whole,)
                elif len(piece) > WIDTHS[-1]:
                    alone[piece] = merge(piece, self.ranks)
                else:
                    by_width[next(w for w in WIDTHS if len(piece) <= w)].append(piece)
        count = np.fromiter(map(len, alone.values()), np.int64, len(alone))
        self.place.update(zip(alone, self.add(np.fromiter(chain.from_iterable(alone.values()), np.int32, count.sum()), count).tolist()))
        for width, pieces in by_width.items():
            if pieces:
                data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
                size = np.fromiter(map(len, pieces), np.int64, len(pieces))
                self.place.update(zip(pieces, self.add(*self.merges.together(data, size)).tolist()))
        return np.fromiter(map(self.place.__getitem__, different), np.int64, len(different))[words.indices.to_numpy()]

    def numbers(self, data: bytes, at: np.ndarray) -> np.ndarray:
        """Numbers of the pieces of data that begin at these places."""
        end = np.append(at[1:], len(data))
        size = end - at
        short = size <= 8
        if b"\0" in data:
            zeros = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8) == 0)])
            short &= zeros[end] == zeros[at]
        out = np.zeros(len(at), np.int64)
        eight = np.ndarray((len(data),), "<u8", data + bytes(8), strides=(1,))  # the 8 bytes from each place on
        out[short] = self.short_numbers(eight[at[short]] & MASKS[size[short]])
        rest = np.flatnonzero(~short)
        if len(rest):
            every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)])
            out[rest] = self.long_numbers(every.take(pa.array(rest)))
        return out

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each piece, each piece's first byte in its text, and where each text's pieces begin in these lists (and the end)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        data = "".join(texts.to_pylist())
        points = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32)
        data = data.encode("utf-8", "surrogatepass")
        text_at = np.concatenate([[0], np.cumsum(size)])
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(size) + 1, np.int64)
        byte_at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64)])
        starts = np.searchsorted(byte_at, text_at[:-1][size > 0])
        at = byte_at[np.flatnonzero(boundaries(points, starts))]
        if self.known > CACHE_PIECES:
            self.clear()
        number = self.numbers(data, at)
        of_text = np.searchsorted(at, text_at)
        return number, at - np.repeat(text_at[:-1], np.diff(of_text)), of_text

    def ids(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after another, and where each piece's begin (and the end)."""
        count = self.count[number]
        before = np.concatenate([[0], np.cumsum(count)])
        return self.flat[np.repeat(self.start[number] - before[:-1], count) + np.arange(before[-1])], before


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def ragged(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, and offsets: the byte at which each piece begins. The ids' own bytes, as many as their tokens have, give theirs.

    Equal texts that come together, as repeats of a mix do, are encoded once.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, texts = encoder(path), pc.fill_null(batch.column(1).cast(pa.large_string()), "").dictionary_encode()
        number, offsets, of_text = own.pieces(texts.dictionary)
        ids, before = own.ids(number)
        columns = [batch.column(0), ragged(ids, before[of_text]).take(texts.indices), ragged(offsets, of_text).take(texts.indices)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "offsets"])

    return docs.select("doc_id", "text").mapInArrow(per_bytes(step, 1), "doc_id long, ids array<int>, offsets array<int>")


def joined(parts: pa.LargeBinaryArray, ids: pa.Array, ends: np.ndarray) -> Iterator[memoryview]:
    """For each list of ids, its parts one after another."""
    taken = parts.take(ids)
    at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8)[ends]
    data = memoryview(taken.buffers()[2] or b"")
    return (data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist()))


def decode(encoded: DataFrame, path: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id and the decoded bytes; with digests: counts of ids and pieces, and the hashes of the decimal ids and of the bytes instead."""
    path = path or public_tokenizers.path(VOCABULARY)
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_pieces long" if digests else "decoded binary"

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, ids = encoder(path), batch.column(1)
        ends = ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py()
        decoded = joined(own.tokens, ids.flatten(), ends)
        if not digests:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(bytes, decoded), pa.binary())], names=["doc_id", "decoded"])
        names = [hashlib.sha256(x[:-1]).hexdigest() for x in joined(own.names, ids.flatten(), ends)]
        columns = [pa.array(np.diff(ends)), pa.array(names, pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()), pc.list_value_length(batch.column(2)).cast(pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *(x.split()[0] for x in kinds.split(", "))])

    return encoded.select("doc_id", "ids", "offsets").mapInArrow(per_batch(step), f"doc_id long, {kinds}")


def counted(own: Encoder, texts: pa.Array) -> pa.Array:
    number, _, of_text = own.pieces(texts)
    before = np.concatenate([[0], np.cumsum(own.count[number])])
    return pa.array(np.diff(before[of_text]))


def token_counts(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and n_tokens of each row."""
    path = path or public_tokenizers.path(VOCABULARY)
    schema = docs.select(*keep).schema.add("n_tokens", "long")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], counted(encoder(path), batch.columns[-1])], names=[*keep, "n_tokens"])

    return docs.select(*keep, "text").mapInArrow(per_bytes(step, len(keep)), schema)


def length_histogram(counts: DataFrame, bucket: int = 128) -> DataFrame:
    """One row for each length that occurs: its documents and tokens, and the suffix sums that answer every context limit.

    docs_from, tokens_from: documents at least so long, and their tokens; truncated_tokens: tokens of the corpus when each
    document is cut at this length; docs_cut: documents that lose tokens; share_upto: share of documents no longer than this.
    The sums run inside buckets of lengths and over the buckets' totals, so no task gets all lengths. Null lengths are not counted.
    """
    by_length = counts.where("n_tokens is not null").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    by_length = by_length.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("bucket", F.floor(F.col("n_tokens") / bucket))
    by_length = materialize(by_length, "lengths")  # read twice below, so that the texts are encoded once
    later = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    totals = by_length.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    totals = totals.select("bucket", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_later"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_later"), F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = by_length.withColumn("d", F.sum("n_docs").over(inside)).withColumn("t", F.sum("tokens").over(inside)).join(totals, "bucket")
    out = out.withColumn("docs_from", F.col("d") + F.col("docs_later")).withColumn("tokens_from", F.col("t") + F.col("tokens_later"))
    return out.select(
        "n_tokens", "n_docs", "tokens", "docs_from", "tokens_from",
        (F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_tokens"),
        (F.col("docs_from") - F.col("n_docs")).alias("docs_cut"),
        ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("share_upto"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents, tokens, documents cut and tokens left after truncation; from the histogram alone, in one pass."""
    n, d, m = F.col("n_tokens"), F.col("n_docs"), F.col("limit")
    rows = histogram.select("n_tokens", "n_docs", F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("limit"))
    return rows.groupBy("limit").agg(F.sum(d).alias("docs"), F.sum(n * d).alias("tokens"), F.sum(F.when(n > m, d).otherwise(0)).alias("docs_cut"), F.sum(F.least(n, m) * d).alias("truncated_tokens"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """For each share: the least length that at least this share of the documents does not exceed."""
    rows = histogram.select("n_tokens", "share_upto", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    return rows.where("share_upto >= share - 1e-12").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op5_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_counts(table(spark, sf_dir, "documents")))


def op9_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(encode(table(spark, sf_dir, "documents")), digests=True)
