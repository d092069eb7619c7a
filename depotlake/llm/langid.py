"""Hierarchical language identification: the language family first, then one-versus-one linear support vector machines in it.

Features are the shares of hashed letter pairs and triples of the whole lower-case text; whatever is not a letter is a blank.
Training takes a bounded sample: about PER_LANGUAGE documents of each language, chosen by the hash of their ids among those
with a language and with crc32(id) mod 3 other than 1. Rows of one id and language count as one document there, with the first
of their texts in order, however often they repeat. The machines are Spark ML's LinearSVC. In a prediction only the text counts.

Null texts and those without a letter get ``und`` with score 0, as does everything where there is nothing to learn from; equal
texts get equal answers; texts are taken whole; ties between languages go to the first in alphabetical order; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlake.llm.common import materialize, per_batch, table, unit_hash

# Families of languages. Any other language is a family of its own.
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"],
}
#: Length of the hashed feature vector, documents of each language in the training sample, and machines fitted at a time.
SIZE, PER_LANGUAGE, FITS = 2048, 300, 2


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


@lru_cache(1)
def letters() -> np.ndarray:
    """For each byte of lower-case UTF-8: itself if it is a letter or in one, else a blank."""
    return np.array([b if b >= 0x80 or 97 <= b <= 122 else 0x20 for b in range(256)], np.uint32)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of all texts, place by place (pairs, then triples, 0 where it would be blanks), where each text begins, and their counts."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    low = pc.binary_join_element_wise(low, pa.scalar("  ", pa.large_string()), pa.scalar("", pa.large_string()))
    data = letters()[np.frombuffer("".join(low.to_pylist()).encode("utf-8", "surrogatepass"), np.uint8)]
    starts = np.concatenate([[0], np.cumsum(pc.binary_length(low).to_numpy(zero_copy_only=False).astype(np.int64))])
    # each text ends with two blanks, of which the last begins no feature, and so none reaches into the next text
    blank = data == 0x20
    after, third = np.append(data[1:], 0x20).astype(np.uint32), np.append(data[2:], [0x20, 0x20]).astype(np.uint32)
    pair = (data * np.uint32(0x9E3779B1)) ^ (after * np.uint32(0x85EBCA77))
    triple = (pair * np.uint32(0xC2B2AE3D)) ^ (third * np.uint32(0x27D4EB2F))
    used = np.stack([~blank | (after != 0x20), ~blank & (after != 0x20)])
    used[:, starts[1:] - 1] = False
    shift = np.uint32(32 - (SIZE // 2).bit_length() + 1)
    spots = np.stack([(pair * np.uint32(0x165667B1)) >> shift, ((triple * np.uint32(0x165667B1)) >> shift) + np.uint32(SIZE // 2)])
    return np.where(used, spots, SIZE).astype(np.int64), starts, used


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; every text has two places at least."""
    return np.add.reduceat(values, starts[:-1], axis=0) if len(starts) > 1 else values[:0]


def feature_vectors(texts: pa.Array) -> np.ndarray:
    spots, starts, used = grams(texts)
    out = np.zeros((len(texts), SIZE + 1))
    row = np.repeat(np.arange(len(texts)), np.diff(starts))
    for s in spots:
        out += np.bincount(row * (SIZE + 1) + s, minlength=out.size).reshape(out.shape)
    return 100 * out[:, :SIZE] / np.maximum(sums(used.sum(0), starts), 1)[:, None]


@dataclass
class Machine:
    """Decides for ``first`` where the margin is not negative, else for ``second``."""

    first: str
    second: str
    weights: np.ndarray
    intercept: float


@dataclass
class Model:
    families: list[str]
    languages: dict[str, list[str]]
    among_families: list[Machine]
    within: dict[str, list[Machine]]

    def machines(self) -> list[Machine]:
        return [*self.among_families, *(m for f in self.families for m in self.within[f])]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sample_of(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 1) -> DataFrame:
    """doc_id, lang and features of about so many learnable documents of each language: one pass counts ids (a sketch that repeated rows don't change), one draws."""
    learnable = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = learnable.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("ids"))
    chance = {r["lang"]: per_language / max(r["ids"], 1) for r in counts.orderBy("lang").collect()}  # one row for each language
    drawn = F.lit(False)
    for lang, share in chance.items():
        drawn = drawn | ((F.col("lang") == lang) & (unit_hash("doc_id", seed=seed) < share))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(feature_vectors(batch.column(2)).tolist(), pa.list_(pa.float64()))], names=["doc_id", "lang", "x"])

    once = learnable.where(drawn).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    return once.mapInArrow(per_batch(step, 64), "doc_id long, lang string, x array<double>")


def machine(sample: DataFrame, label: Column, first: str, second: str) -> Machine:
    rows = sample.select(F.when(label == first, 1.0).when(label == second, 0.0).alias("label"), array_to_vector("x").alias("features")).where("label is not null")
    fitted = LinearSVC(maxIter=25, regParam=0.01).fit(rows)
    return Machine(first, second, fitted.coefficients.toArray(), fitted.intercept)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """None if there is no document to learn from."""
    # in one ordered partition, so that sums of gradients, and the weights, are the same in each run
    sample = materialize(sample_of(docs, per_language).repartition(1).sortWithinPartitions("lang", "doc_id"), "lang-sample").coalesce(1)
    langs = [r["lang"] for r in sample.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return None
    families = sorted({family_of(x) for x in langs})
    own = {f: [x for x in langs if family_of(x) == f] for f in families}
    family = F.lit(None).cast("string")
    for f in families:
        family = F.when(F.col("lang").isin(own[f]), f).otherwise(family)
    duels = [(family, a, b) for a, b in combinations(families, 2)] + [(F.col("lang"), a, b) for f in families for a, b in combinations(own[f], 2)]
    with ThreadPoolExecutor(FITS) as pool:  # each fit is many short jobs of one task
        fitted = iter(list(pool.map(lambda duel: machine(sample, *duel), duels)))
    among = [next(fitted) for _ in combinations(families, 2)]
    return Model(families, own, among, {f: [next(fitted) for _ in combinations(own[f], 2)] for f in families})


def vote(names: list[str], machines: list[Machine], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the winner's number, and its confidence: the mean probability it has in its own duels."""
    chance = np.zeros((len(margins), len(names)))
    for k, m in enumerate(machines):
        p = 1 / (1 + np.exp(-2 * np.clip(margins[:, k], -30, 30)))
        chance[:, names.index(m.first)] += p
        chance[:, names.index(m.second)] += 1 - p
    duels = max(len(names) - 1, 1)
    return chance.argmax(1), chance.max(1) / duels if machines else np.ones(len(margins))


def answers(model: Model):
    """A function from texts to language, score, family and the family's score, as arrays."""
    machines = model.machines()
    weights = np.stack([np.append(m.weights, 0.0) for m in machines], 1) if machines else np.zeros((SIZE + 1, 1))
    intercepts = np.array([m.intercept for m in machines] or [0.0])

    def of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        spots, starts, used = grams(texts)
        total = np.maximum(sums(used.sum(0), starts), 1)[:, None]
        margins = 100 * sum(np.stack([sums(w.take(s), starts) for w in weights.T], 1) for s in spots) / total + intercepts
        has_letter = np.fromiter((any(c.isalpha() for c in t or "") for t in texts.to_pylist()), bool, len(texts))
        n = len(model.among_families)
        won, sure = vote(model.families, model.among_families, margins[:, :n])
        langs, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
        for k, f in enumerate(model.families):
            rows, names = np.flatnonzero(has_letter & (won == k)), model.languages[f]
            best, share = vote(names, model.within[f], margins[rows, n : n + len(model.within[f])])
            langs[rows] = np.array(names, object)[best]
            scores[rows] = np.round(share * sure[rows], 6)
            n += len(model.within[f])
        return langs, scores, np.where(has_letter, np.array(model.families, object)[won], "und"), np.where(has_letter, np.round(sure, 6), 0.0)

    return of


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the family with its own score."""
    schema = "doc_id long, held_out boolean, lang_pred string, score double, family string, family_score double"
    if model is None:
        return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit("und").alias("family"), F.lit(0.0).alias("family_score"))
    of = answers(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores, family, sure = of(batch.column(2))
        columns = [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores), pa.array(family, pa.string()), pa.array(sure)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "family", "family_score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(per_batch(step), schema)


def accepted(docs: DataFrame, model: Model | None, least: float = 0.4) -> DataFrame:
    """The rows of docs, all columns, whose language is not und and whose score is least at least."""
    if model is None:
        return docs.limit(0)
    of, at = answers(model), docs.columns.index("text")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores, _, _ = of(batch.column(at))
        return batch.filter(pa.array((langs != "und") & (scores >= least)))

    return docs.mapInArrow(per_batch(step), docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))


def op1_hierarchical_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
