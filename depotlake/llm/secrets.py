"""Secret scans with DataFrame functions only: regular expressions, and multipart credentials joined by position.

Base kinds are assign, access and hex. Weak kinds are reported only next to what completes them: a ``secret`` (a lone run of
40 base-64 characters) within SCOPE characters of an access identifier, and an ``endpoint`` (a URL) within SCOPE of both an
access identifier and a secret (a weak one or an assigned one). What overlaps an access identifier, as a longer run of which
that is the first half does, is neither its complement nor a secret. The join is an interval join by sorting: each part is
two events, its start and its end, and windows over a text's events in order of position count the access identifiers that
end within SCOPE before a start, and begin within SCOPE after an end, so many parts in one text cost no pairs. Only texts with
an access identifier and a weak part go through it; all others are searched once and never shuffled.

Spans are code points, end exclusive. Null texts count as empty; a text without findings gives empty span lists; equal texts
have equal spans, so repeated rows and ids are all right; an empty table gives an empty result; extra columns are kept by
redact() and ignored by scan().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotlake.llm.common import table

# The base patterns, then those of weak parts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
SECRET = r"[A-Za-z0-9+/]{40,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?"
KINDS = ("assign", "access", "hex", "secret", "endpoint")
LEAST, SECRET_LENGTH, SCOPE = 8, 40, 200
SPAN = "array<struct<start:int,kind:int,end:int>>"


def matches(text: Column, pattern: str, kind: str, keep=None, group: int = 0) -> Column:
    """Spans of a pattern's leftmost matches that don't overlap; keep: a condition on the group."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = [F.transform(gaps, F.length).alias("gap"), F.transform(found, F.length).alias("size"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("group")]
    rows = F.slice(F.arrays_zip(*parts), F.lit(1), F.size(found))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + x["size"]).alias("end")))
        kept = F.concat(acc["out"], span)
        return F.struct((start + x["size"]).alias("at"), (kept if keep is None else F.when(keep(x["group"]), kept).otherwise(acc["out"])).alias("out"))

    empty = F.array().cast(SPAN)
    spans = F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def parts_of(text: Column) -> tuple[Column, Column]:
    """Base spans, and those of weak parts, each by start and kind."""
    base = F.concat(matches(text, ASSIGN, "assign", lambda g: F.length(g) >= LEAST, 2), matches(text, ACCESS, "access"), matches(text, HEX, "hex"))
    weak = F.concat(matches(text, SECRET, "secret", lambda g: F.length(g) == SECRET_LENGTH), matches(text, ENDPOINT, "endpoint"))
    return F.array_sort(base), F.when(text.rlike(ACCESS), weak).otherwise(F.array().cast(SPAN))


def can_link() -> Column:
    return F.exists("base", lambda s: s["kind"] == KINDS.index("access")) & (F.size("weak") > 0)


def near(parts: DataFrame, wanted: Column, scope: int, name: str) -> DataFrame:
    """parts with two more columns: whether one of the wanted parts is within scope before or after (near_<name>), and whether one overlaps (in_<name>, which a wanted part does itself)."""
    own = ["text_key", "start", "kind", "end"]
    events = parts.select(*parts.columns, wanted.alias("wanted"), F.inline(F.array(*[F.struct(F.col(c).alias("pos"), F.lit(c == "start").alias("opens")) for c in ("start", "end")])))
    order = Window.partitionBy("text_key").orderBy("pos")
    ends, begins = F.count_if(F.col("wanted") & ~F.col("opens")), F.count_if(F.col("wanted") & F.col("opens"))
    events = events.select(
        "*",
        F.when(F.col("opens"), ends.over(order.rangeBetween(-scope, 0))).otherwise(begins.over(order.rangeBetween(0, scope))).alias("close"),
        # opened before a part's end, less closed up to its start
        F.when(F.col("opens"), -ends.over(order.rangeBetween(Window.unboundedPreceding, 0))).otherwise(begins.over(order.rangeBetween(Window.unboundedPreceding, -1))).alias("over"),
    )
    rest = [F.first(c).alias(c) for c in parts.columns if c not in own]
    return events.groupBy(*own).agg(*rest, (F.max("close") > 0).alias(f"near_{name}"), (F.sum("over") > 0).alias(f"in_{name}"))


def linked_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """text_key and its reported weak spans, for texts that have any. found: text_key, base, weak."""
    once = found.where(can_link()).groupBy("text_key").agg(F.first("base").alias("base"), F.first("weak").alias("weak"))  # copies of a text meet before the shuffle
    kind = F.col("kind")
    is_access = kind == KINDS.index("access")
    parts = near(once.select("text_key", F.inline(F.concat("base", "weak"))), is_access, scope, "access")
    is_secret = kind.isin(KINDS.index("assign"), KINDS.index("secret")) & ~F.col("in_access")
    parts = near(parts, is_secret, scope, "secret").where(F.col("near_access") & ~F.col("in_access"))
    reported = parts.where((kind == KINDS.index("secret")) | ((kind == KINDS.index("endpoint")) & F.col("near_secret")))
    return reported.groupBy("text_key").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("linked"))


def text_key(text: Column) -> Column:
    """Equal for equal texts; different ones share it with a chance of about 2 ** -96."""
    return F.struct(F.xxhash64(text).alias("a"), F.crc32(text).alias("b"))


def joined_names(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with base and spans, both lists of (start, kind, end). Rows with an access identifier are joined with their text's links; others pass by."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base, weak = parts_of(text)
    has_access = F.coalesce(F.col("text").rlike(ACCESS), F.lit(False))
    others = docs.where(~has_access).withColumn("base", base).withColumn("spans", F.col("base"))
    found = docs.where(has_access).withColumns({"base": base, "weak": weak})
    # what can't link gets a key of its own that matches nothing, so that a common text is dealt out evenly
    alone = F.struct(F.xxhash64(F.col("doc_id"), text).alias("a"), F.lit(-1).cast("long").alias("b"))
    found = found.withColumn("text_key", F.when(can_link(), text_key(text)).otherwise(alone))
    linked = linked_parts(found.select("text_key", "base", "weak"))
    spans = F.when(F.col("linked").isNotNull(), F.array_sort(F.concat("base", "linked"))).otherwise(F.col("base"))
    found = found.join(linked, "text_key", "left").withColumn("spans", spans).drop("weak", "linked", "text_key")
    return others.unionByName(found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the hash of the base spans, all spans, and the number of linked parts."""
    rows = with_spans(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined_names(F.col("base")), 256).alias("base_sha256"),
        joined_names(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_linked"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs, with each stretch that spans cover replaced by mask in text, and n_chars as it then is; other texts stay as they are."""
    columns = docs.columns
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    rows = with_spans(docs.withColumnsRenamed({c: f"own_{c}" for c in ("base", "spans", "weak", "linked", "text_key") if c in columns}))
    rows = rows.withColumn("clean", F.when(F.size("spans") > 0, done).otherwise(text))
    out = [F.col("clean").alias("text") if c == "text" else F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"own_{c}" if f"own_{c}" in rows.columns and c in ("base", "spans", "weak", "linked", "text_key") else c).alias(c) for c in columns]
    return rows.select(*out)


def op4_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
