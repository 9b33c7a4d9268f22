"""Operator 4, mixing sources to target weights along a time-varying curriculum.

Weights go round the sources in code-point order (null last). Targets fill up by weight under a cap of ``cap`` times the
source's size. Each source's documents stand in a hashed order; the mix reads that order again and again until the target is
reached, so a document is taken whole as often as its passes lie before the target and the last one is cut. A source's
weight schedule, integrated over training time and scaled to its target, is its cumulative token demand; inverting that at
the middle of a pass gives the pass its training position, and documents are range-sorted by position.

Running sums are taken within hashed buckets of a source and over the buckets' sums, so a source with a third of all rows
is spread over as many tasks as it has buckets. The hash is one of doc_id and text, so rows without an id spread as well. Targets
are worked out over a row for each source in one task, as their sizes depend on each other. Nothing is collected but the
number of rows; (source, hash, size) of all rows is written once, and read again for the sums.

Defined results: null text has size 0 and is never taken; null is a source of its own, the last; with no words at all every
target is 0; repeated rows are taken each by itself, and equal rows of a bucket stand in any order, as they take the same in
sum; further columns travel untouched; in ``mixed``, one named ``position`` comes back as position_in.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, carrying, checkpointed, documents


@dataclass(frozen=True)
class Mix:
    weights: tuple = (5, 2, 1)
    #: (time, weight) knots, going round like the weights: the first falls over training, the last rises.
    schedules: tuple = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
    cap: int = 3
    seed: str = "mix-1"
    rows_per_bucket: int = 200_000
    least_digits: int = 2


def sizes(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:  # noqa: B008
    """docs with size and ``order_key``, a hash by whose order a source's documents stand."""
    own = F.concat_ws(":", F.lit(mix.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5("text"), F.lit("")))
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn("order_key", F.md5(own))


def targets(by_source: DataFrame, mix: Mix) -> DataFrame:
    """source, source_size -> weight, class and target. A row for each source.

    In the order of cap / weight the capped sources are a prefix; what they leave is shared by weight among the rest."""
    n = len(mix.weights)
    place = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, mix.weights)), (F.col("class") + 1).cast("int")).cast("long")
    rows = by_source.withColumn("class", F.pmod(F.row_number().over(place) - 1, F.lit(n))).withColumn("weight", pick).withColumn("most", F.col("source_size") * mix.cap)
    order = Window.orderBy((F.col("most").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("among", F.sum("weight").over(after))
    rows = rows.withColumn("open", F.col("most") * F.col("among") > F.col("left") * F.col("weight"))
    first = F.min(F.when(F.col("open"), F.struct("at", "left", "among"))).over(whole)
    rows = rows.withColumn("first", first)
    shared = (F.col("first.left") * F.col("weight")).cast("double") / F.col("first.among")
    return rows.select("source", "source_size", "class", F.when(F.col("first").isNull() | (F.col("at") < F.col("first.at")), F.col("most").cast("double")).otherwise(shared).alias("target"))


def invert(knots: tuple, share: Column) -> Column:
    """The time at which the schedule's integral reaches ``share`` of its whole; pieces between knots are linear."""
    pieces, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        pieces.append((area, t0, w0, (w1 - w0) / (t1 - t0)))
        area += (w0 + w1) / 2 * (t1 - t0)
    u, out = share * F.lit(area), None
    for a0, t0, w0, slope in pieces:
        rest = u - F.lit(a0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2.0 * slope) * rest, F.lit(0.0)))
        time = F.lit(t0) + F.when(F.lit(w0) + root == 0, F.lit(0.0)).otherwise(F.lit(2.0) * rest / (F.lit(w0) + root))
        out = time if out is None else F.when(u >= F.lit(a0), time).otherwise(out)
    return out


def placed(rows: DataFrame, mix: Mix, sized: DataFrame | None = None) -> DataFrame:
    """rows (from ``sizes``) with what ``plan`` adds. ``sized``: source, order_key and size of the same rows where they lie
    written already."""
    sized = checkpointed(rows.select("source", "order_key", "size")) if sized is None else sized
    digits = max(mix.least_digits, math.ceil(math.log(max(1, sized.count()) / mix.rows_per_bucket + 1, 16)))
    keyed = lambda df: df.withColumn("bucket", F.substring("order_key", 1, digits)).withColumn("source_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    rows = keyed(rows)
    sums = keyed(sized).groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"), F.min("source").alias("of"))
    by_source = targets(sums.groupBy(F.col("of").alias("source")).agg(F.sum("bucket_size").alias("source_size")), mix)
    by_source = by_source.withColumn("source_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    running = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(running), F.lit(0))).drop("of", "bucket_size")
    offsets = offsets.join(by_source, "source_key")
    within = Window.partitionBy("source_key", "bucket").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(offsets, ["source_key", "bucket"]).withColumn("start", F.col("bucket_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    for p in range(mix.cap):
        out = out.withColumn(f"pass_{p}", F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - F.lit(p) * F.col("source_size") - F.col("start"))))
    return out.withColumn("taken", sum((F.col(f"pass_{p}") for p in range(1, mix.cap)), F.col("pass_0")))


OWN = ("doc_id", "text", "source")


def plan(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:  # noqa: B008
    """docs with size, source_size, target, class, ``start`` (words before it in its source's order), what each pass takes and
    ``taken``, their sum. A further column that is named like one of these comes back as name_in."""
    made = ("size", "source_size", "target", "class", "start", *(f"pass_{p}" for p in range(mix.cap)), "taken")
    return carrying(docs, OWN, made, lambda df: placed(sizes(df, mix), mix))


def position(mix: Mix, p: Column) -> Column:
    """Training position, 0 to 1, of pass p: where the middle of what it takes lies in its source's demand."""
    words = F.element_at(F.array(*[F.col(f"pass_{i}") for i in range(mix.cap)]), (p + 1).cast("int"))
    middle = (p * F.col("source_size") + F.col("start")).cast("double") + words.cast("double") / 2.0
    share = F.least(F.lit(1.0), middle / F.col("target"))
    out = F.lit(None).cast("double")
    for k in range(len(mix.schedules)):
        out = F.when(F.col("class") == k, invert(mix.schedules[k], share)).otherwise(out)
    return F.when(words > 0, out)


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:  # noqa: B008
    """The mix itself: each document once for each pass, in order of training position. A pass that the target cuts is given
    whole if at least half of it lies before the target, else left out. Columns of ``docs``, ``position`` and ``mix_pass``."""

    def passes(df: DataFrame) -> DataFrame:
        rows = placed(sizes(df, mix), mix)
        given = F.filter(F.array(*[F.when((F.col(f"pass_{p}") > 0) & (2 * F.col(f"pass_{p}") >= F.col("size")), F.lit(p)) for p in range(mix.cap)]), lambda x: x.isNotNull())
        return rows.withColumn("mix_pass", F.explode(given)).withColumn("position", position(mix, F.col("mix_pass")))

    return carrying(docs, OWN, ("position", "mix_pass"), passes).orderBy("position", "doc_id", "mix_pass")


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = Mix()
    sized = checkpointed(sizes(documents(spark, sf_dir), mix).select("doc_id", "source", "size", "order_key"))
    rows = placed(sized, mix, sized)
    return rows.withColumn("position", position(mix, F.lit(0))).orderBy("position", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "position")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS order_key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS class FROM s),
m AS (SELECT *, CASE class WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS most FROM w),
o AS (
  SELECT *, row_number() OVER q AS pos,
         CAST((SELECT sum(source_size) FROM s) AS BIGINT)
           - CAST(coalesce(sum(most) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
         CAST(sum(weight) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS among
  FROM m WINDOW q AS (ORDER BY CAST(most AS DOUBLE) / weight ASC, source ASC NULLS LAST)),
f AS (SELECT min(pos) AS pos FROM o WHERE most * among > rest * weight),
g AS (SELECT o.pos, o.rest, o.among FROM o JOIN f ON o.pos = f.pos),
t AS (
  SELECT o.source, o.source_size, o.class,
         CASE WHEN g.pos IS NULL OR o.pos < g.pos THEN CAST(o.most AS DOUBLE)
              ELSE CAST(g.rest * o.weight AS DOUBLE) / CAST(g.among AS DOUBLE) END AS target
  FROM o LEFT JOIN g ON true),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.class, t.target,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.order_key, d.doc_id, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - start)) AS p0,
         greatest(0, least(size, CAST(floor(target) AS BIGINT) - source_size - start)) AS p1,
         greatest(0, least(size, CAST(floor(target) AS BIGINT) - 2 * source_size - start)) AS p2
  FROM p),
u AS (
  SELECT *, least(1e0, (CAST(start AS DOUBLE) + CAST(p0 AS DOUBLE) / 2e0) / target) AS share,
         CASE class WHEN 0 THEN 1.5e0 WHEN 1 THEN 1e0 ELSE 0.5e0 END AS w0,
         CASE class WHEN 0 THEN -1e0 WHEN 1 THEN 0e0 ELSE 1e0 END AS slope
  FROM k)
SELECT doc_id, size, source_size, target, CAST(p0 + p1 + p2 AS BIGINT) AS taken,
       CASE WHEN p0 > 0 THEN 2e0 * share / (w0 + sqrt(greatest(w0 * w0 + 2e0 * slope * share, 0e0))) END AS position
FROM u
"""
