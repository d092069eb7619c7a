"""A Merkle manifest of a dataset: one root for all rows, and a proof for each row, with DataFrame functions only.

Rows are leaves. The leaves of a source, in the order of their ids, form a tree of runs of three; the sources' roots, in the
order of the sources, form another one, whose root is the manifest's.

1. Rows get their place in their source from ranges of (source, id, leaf): places inside a range, and totals of the ranges before.
2. A page holds the runs of three between up to 729 neighbouring nodes and their common ancestor, as lists of digests, level by
   level. Pages are stored by the ancestor's digest; equal pages are stored once. The ancestors are the next tier's nodes.
3. Requests descend from the root page. In a page the digits of a place to base three choose a child at each level, and the
   children that were not chosen are collected; then the child's page is looked up by its digest. All requests for the leaves
   of one page go down together. At a leaf the collected segments are reversed, which gives the proof from the leaf up.

A null in any column is a value of its own ("-"), also as a source, which comes first, and as an id, which comes first in its
source and is never tampered with. Texts are hashed whole, however long. Rows that repeat an id are ordered by their leaves;
equal rows are neighbours, in any order, and each has its own proof. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotlake.llm.common import materialize, table

#: Children of a node, levels of a page, and nodes that a page has at its lowest level.
FAN, LEVELS = 3, 6
PAGE = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(docs: DataFrame, text: Column) -> Column:
    return digest(*[field(docs[c]) for c in FIELDS], field(text))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (its source, with a mark that keeps null apart), leaf, and shown, the leaf of what is there when it is verified; n equal rows are one."""
    hit = F.coalesce(F.crc32(docs["doc_id"].cast("string")) % 2 == 0, F.lit(False))
    tree = F.when(docs["source"].isNull(), "").otherwise(F.concat(F.lit("="), docs["source"]))
    rows = docs.select(docs["doc_id"], tree.alias("tree"), leaf(docs, docs["text"]).alias("leaf"), F.when(hit, leaf(docs, F.translate(docs["text"], "\n", ""))).alias("hurt"))
    return rows.groupBy("tree", "doc_id", "leaf").agg(F.count(F.lit(1)).alias("n"), F.first(F.coalesce("hurt", "leaf")).alias("shown"))


def height(n: Column) -> Column:
    """Levels of a tree of n leaves above them."""
    return F.size(F.filter(F.array(*[F.lit(FAN**k) for k in range(40)]), lambda x: x < n))


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with pos, their place (from 0) among those of their tree in this order, n copies of a row in n places, and their tree's height. Ranges of the order are sorted each by itself."""
    ranged = materialize(rows, f"{name}-keys").repartitionByRange("tree", *order).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, f"{name}-ranges")
    upto = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("m").over(Window.partitionBy("tree"))
    before = ranged.groupBy("tree", "range").agg(F.sum("n").alias("m")).select("tree", "range", F.coalesce(F.sum("m").over(upto), F.lit(0)).alias("before"), height(total).alias("height"))
    inside = Window.partitionBy("tree", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumn("last", F.sum("n").over(inside)).join(before, ["tree", "range"])
    first = F.col("before") + F.col("last") - F.col("n")
    return out.withColumn("pos", F.explode(F.sequence(first, first + F.col("n") - 1))).drop("n", "range", "last", "before")


def above(level: Column) -> Column:
    """The digests of the runs of three in a list."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int")), lambda i: F.sha2(F.array_join(F.slice(level, i * FAN + 1, FAN), ""), 256))


def pages(nodes: DataFrame, tier: int, extra: list[str] = []) -> DataFrame:  # noqa: B006
    """tree, page, height, members (pos, digest and the extra columns), levels from the lowest up, and digest, the page's own."""
    own = nodes.groupBy("tree", F.expr(f"pos div {PAGE}").alias("page"), "height").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", *extra))).alias("members"))
    steps = F.least(F.lit(LEVELS), F.col("height") - tier * LEVELS)
    lowest = F.array(F.col("members.digest"))
    up = F.aggregate(F.sequence(F.lit(1), steps), lowest, lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1)))))
    return own.withColumn("levels", F.when(steps > 0, up).otherwise(lowest)).withColumn("digest", F.element_at(F.element_at("levels", -1), 1))


def segment(levels: Column, k: Column) -> Column:
    """The way down to a page's member k: at each level, the digests left and right of the chosen child."""

    def chosen(level: Column) -> Column:
        at = F.floor(k / F.pow(F.lit(float(FAN)), level)).cast("int")
        digit, row = at % FAN, F.element_at(levels, level + 1)
        join = lambda first, n: F.array_join(F.slice(row, first, n), "")
        return F.struct(join(at - digit + 1, digit).alias("left"), join(at + 2, FAN - 1 - digit).alias("right"))

    way = F.transform(F.sequence(F.size(levels) - 2, F.lit(0), F.lit(-1)), chosen)
    return F.when(F.size(levels) > 1, way).otherwise(F.array().cast("array<struct<left:string,right:string>>"))


def store(*tiers: DataFrame) -> DataFrame:
    """The pages of all tiers by digest, written once."""
    every = tiers[0].select("digest", "levels")
    for t in tiers[1:]:
        every = every.union(t.select("digest", "levels"))
    return materialize(every.dropDuplicates(["digest"]), "manifest")


def descend(requests: DataFrame, dag: DataFrame) -> DataFrame:
    """From requests (tree, page, digest, way) to those for all members of their pages: tree, pos, digest, way."""
    down = requests.join(dag, "digest").select("tree", "page", "way", "levels", F.posexplode(F.element_at("levels", 1)).alias("k", "digest"))
    return down.select("tree", (F.col("page") * PAGE + F.col("k")).alias("pos"), "digest", F.concat("way", segment(F.col("levels"), F.col("k"))).alias("way"))


def tiers_of(nodes: DataFrame, name: str, extra: list[str] = []) -> list[DataFrame]:  # noqa: B006
    """Pages of the nodes (tree, pos, digest, height), of the pages' own digests, and so on up to the roots."""
    out = [materialize(pages(nodes, 0, extra), f"{name}-pages")]
    levels = out[0].agg(F.max("height")).first()[0] or 0
    for tier in range(1, -(-levels // LEVELS)):
        nodes = out[-1].where(F.col("height") > tier * LEVELS).select("tree", F.col("page").alias("pos"), "digest", "height")
        out.append(materialize(pages(nodes, tier), f"{name}-pages"))
    return out


def roots(tiers: list[DataFrame]) -> DataFrame:
    """tree, digest and tier of the last page of each tree."""
    every = None
    for k, t in enumerate(tiers):
        own = t.where(F.greatest(F.lit(1), F.col("height")) <= (k + 1) * LEVELS).select("tree", "digest", F.lit(k).alias("tier"))
        every = own if every is None else every.union(own)
    return every


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row."""
    nodes = placed(leaves(docs), ["doc_id", "leaf"], "leaf").withColumnRenamed("leaf", "digest")
    lower = tiers_of(nodes, "leaf", ["doc_id", "shown"])
    subroots = materialize(roots(lower), "subroots")
    ordered = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", "tier", F.lit(1).alias("n")), ["name"], "source")
    ordered = materialize(ordered, "sources")
    upper = tiers_of(ordered.select("tree", "pos", "digest", "height"), "source")
    dag = store(*lower, *upper)

    root = roots(upper).select("tree", "digest", "tier").withColumn("root", F.col("digest"))
    no_way = F.array().cast("array<struct<left:string,right:string>>")
    now = root.select("tree", F.lit(0).cast("long").alias("page"), "digest", no_way.alias("way"))
    for _ in upper:
        now = descend(now, dag).withColumnRenamed("pos", "page")
    named = ordered.select(F.col("pos").alias("page"), "name", "tier")
    start = now.drop("tree").join(named, "page").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("page"), "digest", "way", "tier")
    start = materialize(start, "manifest-sources")
    now = None
    for tier in reversed(range(len(lower))):
        own = start.where(F.col("tier") == tier).drop("tier")
        now = own if now is None else descend(now, dag).withColumnRenamed("pos", "page").unionByName(own)
        if tier:
            now = materialize(now, "manifest-requests")

    # the last tier's requests meet the rows of their pages
    rows = lower[0].select("tree", "page", "members").join(now, ["tree", "page"]).join(dag, "digest")
    rows = rows.select("tree", "way", "levels", F.posexplode("members").alias("k", "m"))
    up = F.reverse(F.concat("way", segment(F.col("levels"), F.col("k"))))
    rows = rows.select("tree", F.col("m.doc_id").alias("doc_id"), F.col("m.digest").alias("leaf"), F.col("m.shown").alias("shown"), up.alias("up"))
    rows = rows.select(
        "tree", "doc_id", "leaf", F.sha2(F.array_join(F.transform("up", lambda s: F.concat(s["left"], s["right"])), ""), 256).alias("proof_sha256"),
        F.aggregate("up", F.col("shown"), lambda own, s: digest(s["left"], own, s["right"])).alias("folded_root"),
    )
    out = rows.join(subroots.select("tree", F.col("digest").alias("subroot")), "tree").crossJoin(F.broadcast(root.select("root")))  # one root
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))
