"""Mixing sources to target weights by nested hash thresholds; DataFrame functions only.

A document's size is its number of words.  A source's target is its share, by
weight, of all words, and at most ``most`` times its own size; what it can't take
goes to the others by weight.  So a target is ``least(level * weight, most *
size)`` for the one level at which targets add up to all words.  A target of
q whole sizes and a rest r takes every document q times, and once more those whose
hash is under the source's threshold, where the words under the threshold come
nearest to r.  The threshold is found by histograms: words by source and by the
first 12 bits of the hash, then by the next 12 bits in the bucket where r falls
only, and so on through 60 bits.  Nothing is sorted but the buckets' sums.

Defined cases: a null text has size 0; a null source is a source, the last; a null
doc_id hashes as such, and rows of equal id and text share a hash and are taken
together; an empty table gives no rows; a source of size 0 has target 0; other
columns pass through ``mix`` unless their names begin with ``_mix``, and through
``mixed`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WS, documents, written

LEVELS, STEP = 5, 12
MOST = 3
#: Tables of one row for each source are broadcast up to so many rows (under 10 MB); beyond, the join is left to Spark.
BROADCAST_ROWS = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WS}]+")), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of id and text, the same on every engine."""
    key = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """(_mix_source, _mix_total, _mix_target) by source from (_mix_source, _mix_size) rows.

    The windows below run over one row for each source, after the sums.
    """
    by = sizes.groupBy("_mix_source").agg(F.sum("_mix_size").alias("_mix_total"))
    order = Window.orderBy(F.col("_mix_source").asc_nulls_last())
    every = Window.partitionBy()
    at = (F.row_number().over(order) - 1) % len(weights)
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int")).cast("long"))
    by = by.withColumn("cap", F.col("_mix_total") * most)
    # In order of cap / weight, the first k sources are full at a level if the next one isn't.
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("_mix_source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("all", F.sum("_mix_total").over(every)).withColumn("rest", F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    by = by.withColumn("open", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    by = by.withColumn("level", F.col("rest").cast("double") / F.col("open"))
    by = by.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(every)["level"])
    return by.select("_mix_source", "_mix_total", F.least(F.coalesce(F.col("level") * F.col("w"), F.lit(0.0)), F.col("cap").cast("double")).alias("_mix_target"))


def thresholds(rows: DataFrame, goals: DataFrame, small=F.broadcast) -> DataFrame:
    """goals with _mix_rest and _mix_hash: those under the hash are taken once more.

    rows: (_mix_source, _mix_size, _mix_h).  After level i the goal knows the first
    12 * i bits of the boundary, and the words before it.  ``small`` marks tables
    of one row for each source for the joins.
    """
    whole = F.when(F.col("_mix_total") > 0, F.floor(F.col("_mix_target") / F.col("_mix_total"))).otherwise(0).cast("long")
    goals = goals.withColumn("_mix_whole", whole).withColumn("_mix_rest", F.col("_mix_target") - F.col("_mix_whole") * F.col("_mix_total"))
    edge = goals.select(F.col("_mix_source").alias("s"), F.col("_mix_rest").alias("r"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for level in range(1, LEVELS + 1):
        shift = 60 - STEP * level
        own = rows.join(small(edge), F.col("_mix_source").eqNullSafe(F.col("s")) & (F.shiftright("_mix_h", shift + STEP) == F.col("prefix")))
        sums = own.groupBy("s", "r", "before", F.shiftright("_mix_h", shift).alias("b")).agg(F.sum("_mix_size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("s").orderBy("b"))
        sums = sums.withColumn("to", F.col("before") + upto)
        # The boundary bucket: the first whose end reaches r.  There is one, since r is under the source's size.
        edge = sums.where("to >= r").groupBy("s", "r").agg(F.min(F.struct("b", (F.col("to") - F.col("n")).alias("before"), "n")).alias("m"))
        edge = edge.select("s", "r", F.col("m.b").alias("prefix"), F.col("m.before").alias("before"), F.col("m.n").alias("n"))
    take = (F.col("r") - F.col("before")) >= (F.col("before") + F.col("n") - F.col("r"))
    edge = edge.select("s", (F.col("prefix") + F.when(take, 1).otherwise(0)).alias("_mix_hash"))
    return goals.join(small(edge), F.col("_mix_source").eqNullSafe(F.col("s")), "left").drop("s")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """docs with _mix_size, _mix_total, _mix_target and _mix_copies (0 to ``most``: how often the mix takes the document).

    Reads the texts twice; the histograms read a written table of (source, size, hash).
    """
    sized = docs.withColumns({"_mix_source": F.col("source"), "_mix_size": size_of(F.col("text")), "_mix_h": hash_of(F.col("doc_id"), F.col("text"))})
    rows = written(sized.select("_mix_source", "_mix_size", "_mix_h"), "mix-sizes")
    goals = written(targets(rows, weights, most), "mix-targets")
    small = F.broadcast if goals.count() <= BROADCAST_ROWS else lambda df: df
    goals = written(thresholds(rows, goals, small), "mix-goals").withColumnRenamed("_mix_source", "_mix_s")
    out = sized.join(small(goals), F.col("_mix_source").eqNullSafe(F.col("_mix_s")))
    copies = F.col("_mix_whole") + F.when(F.col("_mix_h") < F.coalesce("_mix_hash", F.lit(0)), 1).otherwise(0)
    return out.withColumn("_mix_copies", copies).drop("_mix_s", "_mix_h", "_mix_source", "_mix_whole", "_mix_rest", "_mix_hash")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, with the columns of ``docs``, which go by place, so that no name clashes."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names).select("*", *[F.col(names[docs.columns.index(c)]).alias(c) for c in ("doc_id", "text", "source")])
    out = mix(own, **how).where("_mix_copies > 0")
    return out.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select(*names).toDF(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_total").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"))


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS total, 3 * sum(size)::BIGINT AS cap,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
filled AS (
  SELECT *, sum(total) OVER () - coalesce(sum(cap) OVER f, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS open
  FROM sources WINDOW f AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(rest::DOUBLE / open::DOUBLE, cap::DOUBLE / w) AS level FROM filled WHERE rest::DOUBLE / open::DOUBLE * w <= cap),
goals AS (SELECT source, total, least(level * w, cap::DOUBLE) AS target FROM sources, level),
wholes AS (
  SELECT *, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END AS q,
         target - CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END * total AS r FROM goals),
ties AS (SELECT source, h, sum(size) AS n FROM sized GROUP BY ALL),
runs AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) - n AS before FROM ties),
taken AS (
  SELECT ties.source, ties.h, before, ties.n, r,
         before + ties.n < r OR (before < r AND r - before >= before + ties.n - r) AS one_more
  FROM runs AS ties JOIN wholes ON ties.source IS NOT DISTINCT FROM wholes.source)
SELECT doc_id, size, total AS source_size, target, (size * (q + CASE WHEN one_more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN wholes ON sized.source IS NOT DISTINCT FROM wholes.source
JOIN taken ON sized.source IS NOT DISTINCT FROM taken.source AND sized.h = taken.h
"""
