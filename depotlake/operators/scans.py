"""Running quantities over keys that may have very many rows: sums inside blocks, and a scan over the blocks' totals.

No window here has more than one block of a key; the totals of a key's blocks are few and are scanned by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = Window.unboundedPreceding


def joined(df: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of its block; null keys match."""
    named = blocks.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return df.join(named, on, "left").drop(*[f"_key_{i}" for i in range(len(keys))])


def day_totals(facts: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """Sums of the values and the number of rows (_rows) of facts by keys and day (_day): all that means of any of the keys take from the facts."""
    return facts.groupBy(*keys, F.to_date(time).alias("_day")).agg(*[F.sum(c).alias(c) for c in values], F.count(F.lit(1)).alias("_rows"))


def means_before(df: DataFrame, facts: DataFrame, key: str, time: str, values: dict[str, str]) -> DataFrame:
    """df with the mean of each value (name: column) over the key's rows of an earlier second, null if there is none.

    The days' totals, from facts (the same rows, with fewer columns, or their day_totals), are summed over the days before; a window inside
    each day adds the day's own earlier rows. Rows without a time count as earlier than all others.
    """
    second = F.col(time).cast("long")
    totals = facts if "_rows" in facts.columns else day_totals(facts, [key], time, list(dict.fromkeys(values.values())))
    days = totals.groupBy(key, "_day").agg(*[F.sum(c).alias(f"_d_{n}") for n, c in values.items()], F.sum("_rows").alias("_d"))
    past = Window.partitionBy(key).orderBy("_day").rowsBetween(START, -1)
    days = days.select(key, "_day", *[F.sum(f"_d_{n}").over(past).alias(f"_b_{n}") for n in values], F.sum("_d").over(past).alias("_b"))
    out = joined(df.withColumn("_day", F.to_date(time)), days, [key, "_day"])
    # for rows without a time the frame has all that have none
    today = Window.partitionBy(key, "_day").orderBy(second).rangeBetween(START, -1)
    both = lambda before, now: F.coalesce(before, F.lit(0)) + F.coalesce(now, F.lit(0))
    n = both(F.col("_b"), F.count(F.lit(1)).over(today))
    means = {name: F.try_divide(both(F.col(f"_b_{name}"), F.sum(c).over(today)), n) for name, c in values.items()}
    return out.withColumns(means).drop("_day", "_b", *[f"_b_{n}" for n in values])


def ema(df: DataFrame, keys: list[str], day: str, value: str, name: str, alpha: float, days: int = 1024) -> DataFrame:
    """df with the exponential mean of value over each key's rows by date: the first row's value, then alpha of each value and the rest of the mean before it.

    A row maps the mean before it to (1 - alpha) * mean + alpha * value. Such maps compose to maps of the same form, so each block of a
    series (rows of so many days, and no more rows than days) becomes one map; the maps of a series are applied in order, which gives the
    mean before each block, from which the block's rows are walked. Null values count as 0.
    """
    rest = 1 - alpha
    block = [*keys, "_block", "_part"]
    own = df.columns
    rows = df.withColumn("_block", F.floor(F.datediff(F.to_date(day), F.lit("1970-01-01").cast("date")) / days)).withColumn("_x", F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(day, "_x")) - 1
    rows = rows.withColumn("_place", place).withColumn("_part", F.floor(F.col("_place") / days))  # repeated days may make a block of days longer
    of_block = rows.groupBy(*block).agg(F.array_sort(F.collect_list(F.struct("_place", F.struct("_x", *own).alias("row")))).alias("rows"))
    step = lambda mean, r: rest * mean + alpha * r["row"]["_x"]
    of_block = of_block.withColumns({"keep": F.pow(F.lit(float(rest)), F.size("rows")), "add": F.aggregate("rows", F.lit(0.0), step), "first": F.element_at("rows", 1)["row"]["_x"]})
    of_series = of_block.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "_part", "keep", "add", "first"))).alias("m"))
    # the first value's own step leaves it as it is
    into = F.aggregate(
        "m", F.struct(F.array().cast("array<double>").alias("into"), F.element_at("m", 1)["first"].alias("mean")),
        lambda done, b: F.struct(F.concat(done["into"], F.array(done["mean"])).alias("into"), (b["keep"] * done["mean"] + b["add"]).alias("mean")), lambda done: done["into"],
    )
    blocks = of_series.select(*keys, F.explode(F.arrays_zip(F.col("m._block").alias("_block"), F.col("m._part").alias("_part"), into.alias("_into"))).alias("b")).select(*keys, "b.*")
    walked = F.aggregate(
        "rows", F.struct(F.array().cast("array<double>").alias("means"), F.col("_into").alias("mean")),
        lambda done, r: F.struct(F.concat(done["means"], F.array(step(done["mean"], r))).alias("means"), step(done["mean"], r).alias("mean")), lambda done: done["means"],
    )
    out = joined(of_block.select(*block, "rows"), blocks, block)
    out = out.select(F.explode(F.arrays_zip(F.col("rows.row").alias("row"), walked.alias("_mean"))).alias("r"))
    return out.select(*[F.col(f"r.row.{c}") for c in own], F.col("r._mean").alias(name))


def auc_roc(df: DataFrame, label: str, score: str, ranges: int = 256) -> DataFrame:
    """One row: auc, the chance that a row with label 1 has a higher score than one with another label, where equal scores count half; null without rows of both kinds.

    Rows are counted by score; the scores are cut into ranges at their quantiles; the counts of the ranges below, and of the scores below
    inside the range, give each score the negatives below it. Rows without a label or a score don't count.
    """
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(F.col(score).cast("double").alias("s"), (F.col(label) == 1).alias("y"))
    counts = known.groupBy("s").agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("n"))
    cuts = counts.agg(F.percentile_approx("s", [k / ranges for k in range(1, ranges)], 8 * ranges).alias("cuts"))  # one row
    ranged = counts.join(F.broadcast(cuts)).withColumn("r", F.size(F.filter("cuts", lambda c: c <= F.col("s")))).drop("cuts")
    totals = ranged.groupBy("r").agg(F.sum("n").alias("m")).select("r", F.coalesce(F.sum("m").over(Window.orderBy("r").rowsBetween(START, -1)), F.lit(0)).alias("lower"))  # at most as many rows as ranges
    inside = Window.partitionBy("r").orderBy("s").rowsBetween(START, -1)
    below = F.col("lower") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("n") / 2
    area = ranged.join(F.broadcast(totals), "r").select("p", "n", (F.col("p") * below).alias("a")).agg(F.sum("a").alias("a"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return area.select(F.try_divide("a", F.col("p").cast("double") * F.col("n")).alias("auc"))


def as_of(facts: DataFrame, versions: DataFrame, key: str, at: str, since: str, columns: list[str], until: str | None = None, block: str = "month") -> DataFrame:
    """facts with the columns of the version of their key that was valid at their time: the last one that began then or before, if it hasn't ended (until).

    Facts and versions are one sequence, sorted by key and time, in which the last version is carried forward. The sequence is cut into
    blocks of time, so that a key of very many facts is many tasks; each block begins with the version that the block before it ends
    with. Facts without a key, a time or a version have nulls; of versions that begin at the same time the one that ends last counts.
    """
    version = F.struct(F.col(since).cast("timestamp").alias("t"), (F.col(until).cast("timestamp") if until else F.lit(None).cast("timestamp")).alias("end"), *columns)
    v = versions.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(F.col(key).alias("_key"), version.alias("v"))
    v = v.withColumns({"_t": F.col("v.t"), "_block": F.date_trunc(block, "v.t")})
    late = F.coalesce(F.col("v.end"), F.lit("9999-12-31").cast("timestamp"))
    own = facts.columns
    f = facts.withColumns({"_key": F.col(key), "_t": F.col(at).cast("timestamp")}).withColumn("_block", F.date_trunc(block, "_t"))
    # what each block begins with: one row for each key and block that has facts, and the versions
    needed = f.select("_key", "_block").distinct().select("_key", "_block", F.col("_block").alias("_t"), F.lit(None).cast(v.schema["v"].dataType).alias("v"), F.lit(True).alias("ask"), F.lit(None).cast("timestamp").alias("late"))
    seen = needed.unionByName(v.select("_key", "_block", "_t", "v", F.lit(False).alias("ask"), late.alias("late")))
    carried = Window.partitionBy("_key").orderBy("_t", F.col("ask").desc(), "late").rowsBetween(START, 0)
    begin = seen.withColumn("v", F.last("v", True).over(carried)).where("ask and v is not null").select("_key", "_block", F.col("_block").alias("_t"), "v")
    rows = f.select("_key", "_block", "_t", F.struct(*own).alias("f"), F.lit(None).cast(v.schema["v"].dataType).alias("v"), F.lit(2).alias("kind"), F.lit(None).cast("timestamp").alias("late"))
    of_facts = F.lit(None).cast(rows.schema["f"].dataType).alias("f")
    rows = rows.unionByName(begin.select("_key", "_block", "_t", of_facts, "v", F.lit(0).alias("kind"), F.lit(None).cast("timestamp").alias("late")))
    rows = rows.unionByName(v.select("_key", "_block", "_t", of_facts, "v", F.lit(1).alias("kind"), late.alias("late")))
    last = F.last("v", True).over(Window.partitionBy("_key", "_block").orderBy("_t", "kind", "late").rowsBetween(START, 0))
    rows = rows.withColumn("v", last).where("kind = 2")
    valid = F.col("_key").isNotNull() & F.col("_t").isNotNull() & (F.col("v.end").isNull() | (F.col("_t") < F.col("v.end")))
    return rows.select("f.*", *[F.when(valid, F.col(f"v.{c}")).alias(c) for c in columns])
