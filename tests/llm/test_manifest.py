"""The manifest against a plain Merkle tree."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from depotlake.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])


def climb(nodes):
    """The root, and for each node its siblings (left, right) from the lowest level up."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = nodes[p - p % 3 : p - p % 3 + 3]
            ways[k].append(("".join(run[: p % 3]), "".join(run[p % 3 + 1 :])))
        nodes, at = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [p // 3 for p in at]
    return nodes[0], ways


def brute(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(by_source[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, plain_leaf(r, r.text)))
        trees[s] = own, *climb([plain_leaf(r, r.text) for r in own])
    root, upper = climb([trees[s][1] for s in names])
    out = []
    for s, more in zip(names, upper):
        own, subroot, ways = trees[s]
        for r, way in zip(own, ways):
            hurt = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.text is not None
            folded = plain_leaf(r, r.text.replace("\n", "") if hurt else r.text)
            for left, right in way + more:
                folded = h(left, folded, right)
            out.append((r.doc_id, plain_leaf(r, r.text), subroot, root, h(*[x for pair in way + more for x in pair]), folded, folded == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check(docs, ours):
    assert Counter(tuple(r) for r in ours.select(COLUMNS).collect()) == Counter(brute(docs.collect()))


def test_op13_against_plain_tree(spark, data, documents):
    ours = manifest.op13_merkle_manifest(spark, data)
    check(documents, ours)
    seen = {r["verified"] for r in ours.collect()}
    assert seen == {True, False}  # deleted line ends are found


def test_odd_rows(odd, empty):
    assert manifest.manifest(empty).count() == 0
    check(odd, manifest.manifest(odd))
    check(odd, manifest.manifest(odd.repartition(5)))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10])
def test_small_trees(spark, n):
    rows = [(k, "a\nb" * k, None, None if k % 2 else "s", k) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check(docs, manifest.manifest(docs))


def test_two_tiers_and_repeated_rows(spark):
    """More leaves than a page has, more sources than a page has, and one row many times."""
    base = "struct(id as doc_id, concat('t\n', id) as text, 'en' as lang, {} as source, 3L as n_chars)"
    many = spark.range(800).selectExpr(base.format("'one'") + " as r").union(spark.range(760).selectExpr(base.format("concat('s', id)") + " as r"))
    same = spark.range(900).selectExpr("struct(7L as doc_id, 'x\n' as text, 'en' as lang, 'one' as source, 2L as n_chars) as r")
    docs = many.union(same).select("r.*").repartition(3)
    check(docs, manifest.manifest(docs))


def test_a_changed_row_changes_the_root(odd):
    a = manifest.manifest(odd).select("root").first()
    b = manifest.manifest(odd.withColumn("text", F.when(F.col("doc_id") == 5, "other").otherwise(F.col("text")))).select("root").first()
    assert a != b
