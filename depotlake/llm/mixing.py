"""Temperature mixing of sources.

A source with a share p of the tokens gets a weight in proportion to p ** exponent. The exponent is bisected: it is the
largest up to 1 at which the weights have the target entropy, but not one at which a source is repeated more often than the
limit, which always holds. The weights become a budget of tokens for each source; a budget of 2.3 times a source's tokens is
two whole passes and 0.3 of a third one. Each pass goes through the source in another order: blocks of hash values, in turn,
each ordered by the hash.

Weights are never rounded. Sums over sources are exact decimals, so that they don't depend on the order of rows. A source of
any share gets its budget to within a document, and one document at least. Tokens are those of the byte-level BPE, unless the
caller counts others.

A null text has no tokens, null and empty sources are one source "", a source without tokens is taken once, documents of a
repeated id go through the passes together (ties in the order are taken or left together), an empty table gives an empty mix,
and further columns of the input are kept by mix_documents(), except those whose names begin with mix_, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotlake.llm.bpe import token_counts
from depotlake.llm.common import materialize, small, table

SECTIONS, ROUNDS = 32, 5
#: A source's blocks at most, so that a window over their totals stays small.
BLOCKS = 65_536


def exact_sum(x: Column) -> Column:
    return F.sum(x.cast("decimal(38,18)")).cast("double")


def at_exponents(shares: DataFrame, exponents: list[float]) -> list:
    """a, z (the sum of p ** a), s (of p ** a * ln p), most and least (of p ** (a - 1)) at each exponent a: one row for each, whatever the number of sources."""
    p, a = F.col("p"), F.col("a")
    rows = shares.where("p > 0").select("p", F.explode(F.array(*[F.lit(x) for x in exponents])).alias("a"))
    return rows.groupBy("a").agg(
        exact_sum(F.pow(p, a)).alias("z"), exact_sum(F.pow(p, a) * F.log(p)).alias("s"), F.max(F.pow(p, a - 1)).alias("most"), F.min(F.pow(p, a - 1)).alias("least"),
    ).orderBy("a").collect()


def bisect(shares: DataFrame, met, low_first: bool) -> float:
    """The last exponent in [0, 1] at which met holds, if it holds up to a point (low_first), else the first from which on it does."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
        holds = [met(r) for r in at_exponents(shares, grid)]
        if low_first:
            k = max((i for i, ok in enumerate(holds) if ok), default=0)
            low, high = grid[k], grid[min(k + 1, SECTIONS)]
        else:
            k = min((i for i, ok in enumerate(holds) if ok), default=SECTIONS)
            low, high = grid[max(k - 1, 0)], grid[k]
        if low == high:
            break
    return low if low_first else high


def exponent_for(shares: DataFrame, n: int, entropy: float | None, repeats: float, budget: float | None) -> float:
    """The exponent for n sources with tokens. Entropy falls and repetition falls as the exponent grows."""
    most_often = lambda r: (r["most"] / r["least"] if budget is None else budget * r["most"] / r["z"])
    limited = bisect(shares, lambda r: most_often(r) <= repeats + 1e-12, False)
    if entropy is None:
        return limited
    wanted = bisect(shares, lambda r: math.log(r["z"]) - r["a"] * r["s"] / r["z"] >= entropy * math.log(n) - 1e-12, True)
    return max(limited, wanted)


def mixing_plan(counted: DataFrame, entropy: float | None = 0.95, repeats: float = 4.0, budget: float | None = 1.0, block_tokens: int = 1_000_000, seed: int = 7) -> tuple[DataFrame, int]:
    """For each source: tokens, weight, whole passes and the largest order key of the last, partial pass; and the number of sources.

    counted: doc_id, source, tokens. entropy: target, as a share of that of equal weights; None: as near to equal weights as
    repeats, the limit of passes over a source, allows. budget: tokens of the mix as a share of the corpus; None: the least
    that passes once over all.
    """
    if repeats < (budget or 1.0):
        raise ValueError("a mix of this budget repeats sources more often than the limit allows")
    sums = materialize(counted.groupBy("source").agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("docs")), "mix-sources")
    whole = sums.agg(F.sum("total").alias("t"), F.count_if(F.col("total") > 0).alias("n"), F.count(F.lit(1)).alias("all")).first()
    everything, n, sources = whole["t"] or 0, whole["n"], whole["all"]
    shares = sums.withColumn("p", F.col("total") / F.lit(float(max(everything, 1))))
    exponent = exponent_for(shares, n, entropy, repeats, budget) if everything else 1.0
    norm = at_exponents(shares, [exponent])[0] if everything else {"z": 1.0, "least": 1.0}
    scale = 1 / norm["least"] if budget is None else budget / norm["z"]
    has = F.col("total") > 0
    often = F.when(has, F.pow("p", F.lit(exponent - 1)) * F.lit(scale)).otherwise(F.lit(1.0))
    plan = shares.withColumn("weight", F.when(has, F.pow("p", F.lit(exponent)) / F.lit(norm["z"])).otherwise(F.lit(0.0))).withColumn("often", often)
    # within rounding of whole passes is whole passes
    plan = plan.withColumn("passes", F.floor(F.col("often") + 1e-9).cast("long"))
    plan = plan.withColumn("rest", F.greatest(F.lit(0), F.round((F.col("often") - F.col("passes")) * F.col("total"))).cast("long"))
    blocks = F.least(F.lit(BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("total") / block_tokens))).cast("long")
    plan = plan.withColumn("blocks", blocks).withColumn("exponent", F.lit(exponent))
    plan = materialize(plan.select("source", "total", "docs", "weight", "passes", "rest", "blocks", "exponent"), "mix-plan")

    # Where the last pass ends: the block in which the running total passes the rest, then the document in that block.
    partial = plan.where("rest > 0 or passes = 0").withColumn("rest", F.greatest("rest", F.lit(1)))
    keyed = counted.join(small(partial, sources), "source").withColumn("key", order_key(F.col("doc_id"), F.col("passes") + 1, seed)).withColumn("block", block_of(F.col("key"), F.col("blocks")))
    so_far = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy("source", "block", "rest").agg(F.sum("tokens").alias("b")).withColumn("before", F.coalesce(F.sum("b").over(so_far), F.lit(0)))
    last = sizes.where("before < rest and before + b >= rest").select("source", "block", "before")
    inside = Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    ended = keyed.join(small(last, sources), ["source", "block"]).withColumn("upto", F.col("before") + F.sum("tokens").over(inside))
    # a source that no pass goes through as a whole gives the first document with tokens even if that is longer than its budget
    first = F.min(F.when((F.col("passes") == 0) & (F.col("before") == 0) & (F.col("tokens") > 0), F.col("key")))
    cut = ended.groupBy("source").agg(F.coalesce(F.max(F.when((F.col("upto") <= F.col("rest")) & (F.col("upto") > 0), F.col("key"))), first, F.min("key") - 1).alias("cut"))
    return materialize(plan.join(cut, "source", "left"), "mix-cuts"), sources


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    """A document's place in one pass over its source, from 0 to 2 ** 62."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, epoch.cast("long"), F.lit(seed)), 2)


def block_of(key: Column, blocks: Column) -> Column:
    return F.shiftrightunsigned(F.shiftrightunsigned(key, 31) * blocks, 31)


def source_name() -> Column:
    return F.coalesce(F.col("source"), F.lit(""))


def count_tokens(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    """doc_id, source and tokens of each row, written once. tokens: a column that counts; None: byte-level BPE tokens of the text."""
    named = docs.withColumn("source", source_name())
    if tokens is None:
        return materialize(token_counts(named, keep=("doc_id", "source")).withColumnRenamed("n_tokens", "tokens"), "mix-counts")
    return materialize(named.select("doc_id", "source", F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens")), "mix-counts")


def taken(rows: DataFrame, plan: DataFrame, sources: int, seed: int = 7) -> DataFrame:
    """rows, each as often as the plan takes it (repeats times at most, in a row), with mix_weight, mix_epoch, mix_block and mix_key, the place in that pass."""
    plan = plan.select(*[F.col(c).alias(f"mix_{c}") for c in ("source", "weight", "passes", "blocks", "cut")])
    own = [c for c in rows.columns if c not in ("mix_source", "mix_weight", "mix_epoch", "mix_block", "mix_key")]
    rows = rows.select(*own, source_name().alias("mix_source")).join(small(plan, sources), "mix_source")
    passes = F.col("mix_passes")
    partial = F.when(F.col("mix_cut").isNotNull() & (order_key(F.col("doc_id"), passes + 1, seed) <= F.col("mix_cut")), 1).otherwise(0)
    rows = rows.withColumn("mix_times", passes + partial).where("mix_times > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_times"))))
    rows = rows.withColumn("mix_key", order_key(F.col("doc_id"), F.col("mix_epoch"), seed)).withColumn("mix_block", block_of(F.col("mix_key"), F.col("mix_blocks")))
    return rows.select(*own, "mix_weight", "mix_epoch", "mix_block", "mix_key")


def mix_documents(docs: DataFrame, tokens: Column | None = None, entropy: float | None = 0.95, repeats: float = 4.0, budget: float | None = 1.0, block_tokens: int = 1_000_000, seed: int = 7) -> DataFrame:
    """The rows of docs as often as the mix takes them. The texts are not shuffled: the plan has one row for each source."""
    plan, sources = mixing_plan(count_tokens(docs, tokens), entropy, repeats, budget, block_tokens, seed)
    return taken(docs, plan, sources, seed)


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"))
    mixed = taken(counted.withColumnRenamed("tokens", "mix_tokens"), *mixing_plan(counted))
    return mixed.select("doc_id", "source", "mix_tokens", "mix_weight", "mix_epoch", "mix_block", "mix_key")
