"""Scores of texts by a class-based bigram model: the chance of a word's class after the class before it, times that of the word in its class.

Words are what lies between ASCII white space, with A-Z in lower case; each text ends with an end token, which is also what comes
before its first word. All counts are over the whole of the training documents.

1. Words are counted. The most frequent ones (at most HEADS) are units of their own; of all others, those that hash alike by
   their last three characters form a unit (ENDINGS in number), so that every word, also one that was never seen, has a unit.
2. Pairs of neighbouring units are counted once over the corpus. That table is bounded by the number of units, whatever the input.
3. Exchange clustering: from the counts of all pairs, each unit's gain in likelihood in every other class is computed in tasks,
   and those that gain move. A quarter of the units, spread by a hash, moves at a time, as what moves together doesn't see each
   other; moves that don't raise the likelihood together are taken back. The end token keeps a class of its own.
4. Class transitions are smoothed by the classes' own shares, words in a class by adding 0.1 to each, and to one unseen word.
5. A text's transitions are summed where it is read, as are the words that all tasks know (at most COMMON); its other words are
   joined with the counts.

Null and empty texts have the end token only; texts are taken whole; rows that repeat count each; a row without an id is not held
out; equal counts are ordered by the word; an empty table gives an empty result; only the id and the text column are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlake.llm.common import at_most, materialize, per_bytes, slices, table

#: Words that are units, units of other words, classes, parts of the units that move in turn, their turns, and words whose counts all tasks get.
HEADS, ENDINGS, CLASSES, PARTS, ROUNDS, COMMON = 1 << 13, 1 << 11, 64, 4, 16, 1 << 18
#: Added to each count of a word, weight of the classes' own shares, gain of all parts' turns in nats for each token under which exchange ends.
ADDED, WEIGHT, LEAST_GAIN = 0.1, 5.0, 5e-3
#: Characters of an ending, bytes from which a word is represented by a digest, pairs that a task gathers before it sums them, and bytes of the texts that it holds in arrays.
ENDING, LONG, GATHER, TOGETHER = 3, 64, 1 << 19, 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and where each text's begin (and the end). A long word is its digest after a blank, which no word has."""
    # a copy, as ascii_lower gives wrong bytes for a slice of an array
    own = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(own))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False)
    kept = size > 0
    upto = np.concatenate([[0], np.cumsum(kept)])[offsets - offsets[0]]
    if (size > LONG).any():
        digests = [" " + hashlib.sha256(w.encode()).hexdigest() for w in flat.filter(pa.array(size > LONG)).to_pylist()]
        flat = pc.replace_with_mask(flat, pa.array(size > LONG), pa.array(digests, flat.type))
    return flat.filter(pa.array(kept)), upto


def endings(different: pa.Array) -> np.ndarray:
    """For each word the number of its ending's unit."""
    last = pc.utf8_slice_codeunits(different, -ENDING).dictionary_encode()
    own = np.fromiter((zlib.crc32(e.encode()) % ENDINGS for e in last.dictionary.to_pylist()), np.int64, len(last.dictionary))
    return own[last.indices.to_numpy()] if len(own) else np.zeros(0, np.int64)


def ending(word: Column) -> Column:
    return F.crc32(F.right(word, F.lit(ENDING))) % ENDINGS


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n, its number in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pc.value_counts(words(batch.column(0))[0])
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """The words that all tasks know, most frequent first, with their counts; the first of them are units of their own."""

    def __init__(self, known: pa.Table, heads: int = HEADS):
        known = known.sort_by([("n", "descending"), ("word", "ascending")])
        self.words, self.counts = known["word"].combine_chunks().cast(pa.large_string()), known["n"].to_numpy()
        self.heads = int((self.counts > self.counts[heads]).sum()) if len(self.counts) > heads else len(self.counts)
        self.end = self.heads + ENDINGS  # the end token's unit; before it come the heads and the endings
        self.units = self.end + 1

    def look_up(self, found: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The different words among those found, which of them each is, their counts (0 for words not known here), and their units."""
        found = found.dictionary_encode()
        different = found.dictionary
        place = pc.fill_null(pc.index_in(different, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        count = np.where(place >= 0, self.counts[place], 0) if len(self.counts) else np.zeros(len(place), np.int64)
        unit = np.where((place >= 0) & (place < self.heads), place, self.heads + endings(different))
        return different, found.indices.to_numpy(), count, unit

    def sequence(self, units: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts with an end after each, and where each text's begin (and the end)."""
        return np.insert(units, upto[1:], self.end), upto + np.arange(len(upto))


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = (np.concatenate([p[i] for p in parts]) for i in range(2))
    parts.clear()
    order = codes.argsort(kind="stable")
    codes, n = codes[order], n[order]
    new = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[new], np.add.reduceat(n, new) if len(new) else n


def pair_counts(docs: DataFrame, shared) -> DataFrame:
    """before, after and n: how often one unit follows another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, parts, rows = shared.value, [], 0

        def record(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((codes // lexicon.units).astype(np.int32)), pa.array((codes % lexicon.units).astype(np.int32)), pa.array(n)], names=["before", "after", "n"])

        for texts in (part for batch in batches for part in slices(batch.column(0), TOGETHER)):
            found, upto = words(texts)
            _, which, _, unit = lexicon.look_up(found)
            after, _ = lexicon.sequence(unit[which], upto)
            before = np.concatenate([[lexicon.end], after[:-1]])
            parts.append(np.unique(before * lexicon.units + after, return_counts=True))
            rows += len(parts[-1][0])
            if rows > 2 * GATHER:
                known = summed(parts)
                rows = len(known[0])
                if rows > GATHER:
                    yield record(*known)
                    rows = 0
                else:
                    parts.append(known)
        if parts:
            yield record(*summed(parts))

    return docs.select("text").mapInArrow(run, "before int, after int, n long").groupBy("before", "after").agg(F.sum("n").alias("n"))


def neighbours(pairs: DataFrame) -> DataFrame:
    """One row for each unit: what follows it and what it follows, with counts, as arrays of the machine's integers. A row has two entries for each unit at most."""
    side = lambda own, other: pairs.groupBy(F.col(own).alias("unit")).agg(F.collect_list(F.struct(F.col(other).alias("u"), "n")).alias(other))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(0)]
            for lists in (batch.column(1), batch.column(2)):
                for field, kind in (("u", np.int32), ("n", np.int64)):
                    columns.append(pa.array([x.values.field(field).to_numpy().astype(kind).tobytes() if x.values else b"" for x in lists], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["unit", "after", "after_n", "before", "before_n"])

    both = side("before", "after").join(side("after", "before"), "unit")  # each unit that occurs is before one and after one
    return both.mapInArrow(step, "unit int, after binary, after_n binary, before binary, before_n binary")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for unit, *sides in zip(*(c.to_pylist() for c in batch.columns)):
            yield unit, *[np.frombuffer(x, k) for x, k in zip(sides, (np.int32, np.int64) * 2)]


def transitions(units: DataFrame, classes: np.ndarray) -> np.ndarray:
    """How often one class follows another."""
    k = int(classes[-1]) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k, k))
        for batch in batches:
            for unit, after, n in zip(*(c.to_pylist() for c in batch.columns)):
                out[classes[unit]] += np.bincount(classes[np.frombuffer(after, np.int32)], np.frombuffer(n, np.int64), k)
        a, b = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(out[a, b].astype(np.int64))], names=["a", "b", "n"])

    out = np.zeros((k, k))
    for r in units.select("unit", "after", "after_n").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # at most one row for each pair of classes
        out[r["a"], r["b"]] = r["n"]
    return out


def f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(n: np.ndarray) -> float:
    """What the classes decide of the training text's log likelihood."""
    return float(f(n).sum() - 2 * f(n.sum(1)).sum())


def gains(n: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, loops: float, k: int) -> np.ndarray:
    """The change of likelihood when a unit without a class enters each of the first k classes. n: transitions with the unit in its class (own); after, before: how often it is followed and led by each class, without itself; loops: how often it follows itself."""
    m, total, size = n.copy(), n.sum(1), after.sum() + loops
    m[own] -= after
    m[:, own] -= before
    m[own, own] -= loops
    total[own] -= size
    to, of, diagonal = np.flatnonzero(after), np.flatnonzero(before), m.diagonal()[:k]
    out = (f(m[:k, to] + after[to]) - f(m[:k, to])).sum(1) + (f(m[of, :k] + before[of, None]) - f(m[of, :k])).sum(0)
    a, b = after[:k], before[:k]
    out += f(diagonal + a + b + loops) - f(diagonal + a) - f(diagonal + b) + f(diagonal)
    return out - 2 * (f(total[:k] + size) - f(total[:k]))


def turn(unit: int, parts: int) -> int:
    return (unit * 0x9E3779B1 >> 7) % parts


def proposals(units: DataFrame, classes: np.ndarray, n: np.ndarray, part: int, parts: int) -> list[tuple[int, int]]:
    """Units of one part that another class suits better, and that class."""
    k, end = len(n), len(classes) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for unit, after, after_n, before, before_n in rows_of(batches):
            if unit != end and turn(unit, parts) == part:
                others, own = after != unit, int(classes[unit])
                a = np.bincount(classes[after[others]], after_n[others], k)
                b = np.bincount(classes[before[before != unit]], before_n[before != unit], k)
                gain = gains(n, own, a, b, float(after_n[~others].sum()), k - 1)
                best = int(gain.argmax())
                if gain[best] - gain[own] > 1e-6:
                    found.append((unit, best))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int32()) for i in range(2)], names=["unit", "best"])

    return [tuple(r) for r in units.mapInArrow(run, "unit int, best int").collect()]  # at most one row for each unit


def exchange(units: DataFrame, lexicon: Lexicon, classes: int = CLASSES, rounds: int = ROUNDS, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit, and the transitions between classes."""
    now = np.arange(lexicon.units) % classes
    now[lexicon.end] = classes
    n = transitions(units, now)
    value, done = likelihood(n), 0
    for r in range(rounds):
        tried = now.copy()
        moves = proposals(units, now, n, r % parts, parts)
        for unit, best in moves:
            tried[unit] = best
        then = transitions(units, tried) if moves else n
        gain = likelihood(then) - value
        if gain > 0:
            now, n, value, done = tried, then, value + gain, done + gain
        if r % parts == parts - 1:
            if done < LEAST_GAIN * n.sum():
                break
            done = 0
    return now, n


@dataclass
class Model:
    """Everything in logarithms to base 10: transitions, and for each class what a word's count plus ADDED is divided by."""

    lexicon: Lexicon
    classes: np.ndarray
    step: np.ndarray
    under: np.ndarray
    ends: int
    tokens: int
    vocabulary: int


def train(docs: DataFrame, counts: DataFrame, lexicon: Lexicon, classes: int = CLASSES, rounds: int = ROUNDS) -> Model:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    units = materialize(neighbours(materialize(pair_counts(docs, shared), "unit-pairs")), "unit-neighbours")
    own, n = exchange(units, lexicon, classes, rounds)
    # words of each class: the heads, and all others by their endings
    rest = counts if not lexicon.heads else counts.where(F.col("n") < int(lexicon.counts[lexicon.heads - 1]))
    kinds = np.bincount(own[: lexicon.heads], minlength=len(n)).astype(float)
    seen = {"kinds": 0, "n": 0}
    for r in rest.groupBy(ending(F.col("word")).alias("e")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).collect():  # at most ENDINGS rows
        kinds[own[lexicon.heads + r["e"]]] += r["kinds"]
        seen = {k: seen[k] + r[k] for k in seen}
    ends = int(n[-1].sum())
    kinds[-1] = ends > 0
    total = n.sum(1)
    shares = (total + 1) / (total.sum() + len(n))
    step = np.log10((n + WEIGHT * shares) / (total[:, None] + WEIGHT))
    tokens = int(lexicon.counts[: lexicon.heads].sum()) + seen["n"] + ends
    return Model(lexicon, own, step, np.log10(total + ADDED * (kinds + 1)), ends, tokens, lexicon.heads + seen["kinds"] + (ends > 0))


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and perplexity for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, class_logs double, rest array<string>, times array<long>"

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        found, upto = words(batch.column(3))
        different, which, count, unit = model.lexicon.look_up(found)
        units, begin = model.lexicon.sequence(unit[which], upto)
        own = model.classes[units]
        before = np.concatenate([[model.classes[-1]], own[:-1]])
        class_logs = np.add.reduceat(model.step[before, own] - model.under[own], begin[:-1]) if batch.num_rows else np.zeros(0)
        log = np.concatenate([np.where(count > 0, np.log10(count + ADDED), 0), [np.log10(model.ends + ADDED)]])
        number = np.insert(which, upto[1:], len(different))
        logs = np.add.reduceat(log[number], begin[:-1]) if batch.num_rows else np.zeros(0)
        known = np.append(count > 0, model.ends > 0)
        n_known = np.add.reduceat(known[number].astype(np.int64), begin[:-1]) if batch.num_rows else np.zeros(0, np.int64)
        # the words that are not known here, once for each text
        at = np.flatnonzero(count[which] == 0)
        text, kinds = np.searchsorted(upto, at, "right") - 1, max(len(different), 1)
        once, times = np.unique(text * kinds + which[at], return_counts=True)
        cut = pa.array(np.searchsorted(once, np.arange(batch.num_rows + 1) * kinds), pa.int32())
        rest = pa.ListArray.from_arrays(cut, different.take(pa.array(once % kinds)).cast(pa.string()))
        columns = [*batch.columns[:3], pa.array(np.diff(begin)), pa.array(n_known), pa.array(logs), pa.array(class_logs), rest, pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int64)))]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    rows = materialize(rows.mapInArrow(per_bytes(step, 3, TOGETHER), schema), "class-scores")
    rest = rows.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    rest = rest.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + ADDED)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    out = rows.join(rest, "row", "left").withColumn("logs", F.col("logs") + F.coalesce("more", F.lit(0.0)))
    under = float(np.log10(model.tokens + ADDED * (model.vocabulary + 1)))
    out = out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * under).alias("base_score"), (F.col("logs") + F.col("class_logs")).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def learn(docs: DataFrame, heads: int = HEADS, common: int = COMMON, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model and the word counts of the documents that are not held out."""
    train_docs = docs.where(~held_out(F.col("doc_id")))
    counts = materialize(word_counts(train_docs), "word-counts")
    lexicon = Lexicon(at_most(counts, "n", max(heads, common)).toArrow(), heads)
    return train(train_docs, counts, lexicon, classes, rounds), counts


def op11_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *learn(docs))
