"""The class-based model against plain counts, its own likelihood, and held-out texts."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from depotlake.llm import classlm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def away(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def plain(rows, model=None):
    """doc_id, held_out, n_tokens, n_known, train_tokens and base_score; with a model's classes also the score, from counts made here."""
    counts = Counter(w for r in rows if not away(r.doc_id) for w in [*plain_words(r.text), None])
    total, kinds = sum(counts.values()), len(counts)
    lex = model.lexicon if model else None
    heads = {w: k for k, w in enumerate(lex.words.to_pylist()[: lex.heads])} if model else {}

    def class_of(w):
        return model.classes[lex.end if w is None else heads.get(w, lex.heads + zlib.crc32(w[-3:].encode()) % classlm.ENDINGS)]

    if model:
        n, k = np.zeros((int(model.classes[-1]) + 1,) * 2), Counter(class_of(w) for w in counts)
        for r in rows:
            if not away(r.doc_id):
                seq = [None, *plain_words(r.text), None]
                for a, b in zip(seq, seq[1:]):
                    n[class_of(a), class_of(b)] += 1
        size = n.sum(1)
        share = (size + 1) / (size.sum() + len(n))
    out = []
    for r in rows:
        seq = [*plain_words(r.text), None]
        base = sum(log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in seq)
        score = 0
        for a, b in zip([None, *seq], seq) if model else []:
            x, y = class_of(a), class_of(b)
            score += log10((n[x, y] + 5 * share[y]) / (size[x] + 5)) + log10((counts[b] + 0.1) / (size[y] + 0.1 * (k[y] + 1)))
        out.append((r.doc_id, away(r.doc_id), len(seq), sum(counts[w] > 0 for w in seq), total, round(base, 6), round(score, 6)))
    return Counter(out)


def ours(df):
    return Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("heads, common", [(classlm.HEADS, classlm.COMMON), (50, 80), (0, 0)])
def test_scores_against_plain_counts(spark, documents, heads, common):
    """With all words known to all tasks, some, or none."""
    model, counts = classlm.learn(documents, heads, common, classes=8, rounds=4)
    assert (model.lexicon.heads > 60) == (heads > 60)
    assert ours(classlm.score(documents, model, counts)) == plain(documents.collect(), model)


def test_op11_beats_counts_of_words(spark, data, documents):
    rows = classlm.op11_brown_classes(spark, data).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == Counter(dict.fromkeys((x[:6] for x in plain(documents.collect())), 1))
    for away_ in (True, False):
        own = [r for r in rows if r.held_out == away_]
        assert own and sum(r.score for r in own) > sum(r.base_score for r in own) + 0.1 * sum(r.n_tokens for r in own)
    assert all(abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in rows)


def test_gain_is_the_change_of_likelihood():
    rng = np.random.default_rng(5)
    pairs, k = rng.integers(0, 4, (12, 12)), 4
    classes = np.append(rng.integers(0, k, 11), k)

    def table(c):
        n = np.zeros((k + 1, k + 1))
        np.add.at(n, (c[:, None], c[None, :]), pairs)
        return n

    # as in a corpus, each unit is before another one as often as after one
    pairs[-1] += np.maximum(pairs.sum(1) - pairs.sum(0), 0)[: len(pairs)]
    pairs[:, -1] += np.maximum(pairs.sum(0) - pairs.sum(1), 0)
    pairs = np.maximum(pairs, pairs.T)
    for unit in range(11):
        n, rest = table(classes), np.arange(12) != unit
        after = np.bincount(classes[rest], pairs[unit, rest], k + 1)
        before = np.bincount(classes[rest], pairs[rest, unit], k + 1)
        got = classlm.gains(n, classes[unit], after, before, float(pairs[unit, unit]), k)
        for c in range(k):
            moved = classes.copy()
            moved[unit] = c
            assert abs((classlm.likelihood(table(moved)) - classlm.likelihood(n)) - (got[c] - got[classes[unit]])) < 1e-6


def test_exchange_raises_the_likelihood(spark, documents):
    train = documents.where(~classlm.held_out(documents["doc_id"]))
    counts = classlm.word_counts(train)
    lexicon = classlm.Lexicon(counts.toArrow(), 200)
    units = classlm.neighbours(classlm.pair_counts(train, spark.sparkContext.broadcast(lexicon))).cache()
    values = [classlm.likelihood(classlm.exchange(units, lexicon, 16, rounds)[1]) for rounds in (0, 2, 8)]
    assert values[0] < values[1] < values[2]
    a, b = classlm.exchange(units, lexicon, 16, 3), classlm.exchange(units.repartition(3), lexicon, 16, 3)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and (classlm.transitions(units, a[0]) == a[1]).all()
    units.unpersist()


def test_slices_of_a_batch(spark, documents):
    """Batches of far more bytes than are held in arrays at a time."""
    docs = documents.select("doc_id", F.repeat("text", 20).alias("text")).coalesce(1)
    model, counts = classlm.learn(docs, classes=4, rounds=2)
    assert ours(classlm.score(docs, model, counts)) == plain(docs.collect(), model)


def test_odd_rows(spark, odd, empty):
    model, counts = classlm.learn(empty)
    assert classlm.score(empty, model, counts).count() == 0
    scored = ours(classlm.score(odd, model, counts))  # nothing to learn from
    assert sum(scored.values()) == odd.count() and all(x[3] == 0 and x[4] == 0 for x in scored)
    model, counts = classlm.learn(odd)
    assert ours(classlm.score(odd, model, counts)) == plain(odd.collect(), model)


def test_words():
    many = pa.array([f"Été {k} À la  ƒin\n" * (k % 5) for k in range(400)])
    for a, n in ((0, 400), (123, 77), (399, 1), (5, 0)):  # slices of an array
        found, upto = classlm.words(many.slice(a, n))
        assert [found.to_pylist()[x:y] for x, y in zip(upto, upto[1:])] == [plain_words(t) for t in many.slice(a, n).to_pylist()]
    texts = ["", None, "  A b\tC\n", "É É\x0bx\x0cy\rz\x1fq", "w" * 70 + " w"]
    found, upto = classlm.words(pa.array(texts))
    assert [found.to_pylist()[a:b] for a, b in zip(upto, upto[1:])][:4] == [plain_words(t) for t in texts[:4]]
    assert found.to_pylist()[-1] == "w" and found.to_pylist()[-2].startswith(" ") and len(found) == upto[-1]
