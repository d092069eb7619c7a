"""The alignment against the libraries' own tokens and a comparison of all overlaps."""

from __future__ import annotations

import hashlib
from base64 import b64decode
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from depotlake.llm import align, bpe


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    second = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def of(text):
        enc = first.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(chars[c] for c in t)) for i, t in zip(enc.ids, enc.tokens)]
        ids = second.encode(text)
        b = [(i, bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()) for i in ids]
        return a, b

    return of


def brute(texts, of):
    found, pairs = [], []
    for text in texts:
        a, b = of(text) if text else ([], [])
        if not text or b"".join(x for _, x in a) != (" " + text).encode() or b"".join(x for _, x in b) != (" " + text).encode():
            a, b = [], []
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, x in side:
                own.append((at, at + len(x), i))
                at += len(x)
            spans.append(own)
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        inside = lambda own, s, e: ",".join(str(i) for x, y, i in own if s <= x and y <= e)
        groups = [f"{inside(spans[0], s, e)}|{inside(spans[1], s, e)}" for s, e in zip([0, *common], common)]
        links = [(i, j) for s, e, i in spans[0] for x, y, j in spans[1] if s < y and x < e]
        found.append((len(a), len(b), groups, links))
        pairs.append(set(links))
    docs = Counter(p for own in pairs for p in own)
    best = {}
    for (i, _), n in docs.items():
        best[i] = max(best.get(i, 0), n)
    return [
        (na, nb, len(g), len(links), sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for na, nb, g, links in found
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD = [
    "a  b", " a", "a\nb \n c", "ﬁ Å①", "tab\there", "a ", "  ", " ", "<s> </s> <0x41> <|endoftext|>", "▁x", "a▁ b", "é \xa0 x", "　x", "\x00z \x00", "﻿q", "it's they'll 'S", "日本語 テスト 😀😀", "x" * 300, "a\n  b\n\n   c", "1234 56,78",
    "Ünïcödé wörds wïth äccents", "word " * 50, "ꙮ ∑∫ 🇩🇪 é", "▁▁ mixed", "end\n", "\t\t  \t", "https://example.org/a?b=c&d=%20",
]


def rows_of(df):
    return Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in df.collect())


def test_same_vocabulary():
    ranks = bpe.read_ranks(P.path(align.FIRST))
    tokens = Tokenizer.from_file(P.path("byte_bpe_50k.json")).get_vocab()
    assert set(ranks.values()) | {50256} == set(tokens.values()) and len(b64decode("IQ==")) == 1 and ranks[b"!"] == tokens["!"]


@pytest.mark.parametrize("most", [align.COMMON, 40, 0])
def test_hard_texts(spark, libraries, most):
    """With all pairs in tasks, some, or none."""
    texts = [*HARD, HARD[0], None, "", "long " + "véry löng " * 3000]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, code string").repartition(3)
    want = brute_fast(texts, libraries)
    assert rows_of(align.scored(docs, most)) == Counter((k, *w) for k, w in enumerate(want))
    short = docs.where(F.col("doc_id") < len(texts) - 1)
    assert rows_of(align.scored(short, most)) == Counter((k, *w) for k, w in enumerate(brute(texts[:-1], libraries)))


def test_op12_against_brute_force(spark, data, documents, libraries):
    rows = documents.collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, brute_fast([r.text for r in rows], libraries)))
    assert rows_of(align.op12_diagonal_runs(spark, data)) == want


def brute_fast(texts, of):
    """As brute(), with links found in order of their ends."""
    found = []
    for text in texts:
        a, b = of(text) if text else ([], [])
        if b"".join(x for _, x in a) != b"".join(x for _, x in b):
            a, b = [], []
        groups, links, i, j, at, bt, own = [], [], 0, 0, 0, 0, ([], [])
        ends_a, ends_b = np.cumsum([len(x) for _, x in a]).tolist(), np.cumsum([len(x) for _, x in b]).tolist()
        while i < len(a):
            links.append((a[i][0], b[j][0]))
            at, bt = ends_a[i], ends_b[j]
            if at <= bt:
                own[0].append(a[i][0])
                i += 1
            if bt <= at:
                own[1].append(b[j][0])
                j += 1
            if at == bt:
                groups.append("|".join(",".join(map(str, x)) for x in own))
                own = ([], [])
        found.append((len(a), len(b), groups, links))
    docs = Counter(p for f in found for p in set(f[3]))
    best = {}
    for (i, _), n in docs.items():
        best[i] = max(best.get(i, 0), n)
    return [(na, nb, len(g), len(k), sum(docs[p] == best[p[0]] for p in k), sum(docs[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for na, nb, g, k in found]


def test_groups_of_random_ends():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40, 900):
        for share in (0.05, 0.5, 0.95):
            a, b = (np.union1d(np.flatnonzero(rng.random(n) < share) + 1, [n]) for _ in range(2))
            if share > 0.9:
                b = np.union1d(a, b)
            common = np.intersect1d(a, b)
            ga, gb = align.groups(a, b)
            assert (a[ga - 1] == common).all() and (b[gb - 1] == common).all() and len(ga) == len(common)
    assert [len(x) for x in align.groups(np.zeros(0, int), np.zeros(0, int))] == [0, 0]


def test_outputs_and_odd_rows(spark, odd, empty):
    assert align.scored(empty).count() == 0
    out = align.scored(odd).collect()
    assert len(out) == odd.count() and all(r.groups_sha256 == "" and r.n_links == 0 for r in out if r.doc_id in (1, 2))
    for r in align.align(odd).collect():
        assert (r.ends_a[-1], r.ends_b[-1]) == (len(r.a), len(r.b)) if r.a else not r.b and not r.ends_a
