"""Mixing sources to target weights by Pareto order sampling (DataFrame operations only).

Every source gets a target number of words. A document's expected number of
copies is ``target / source size``: its whole part is taken for certain, and the
fractional part is an inclusion probability ``p``. Documents draw a uniform
``u`` from a digest of their id, and are ranked by ``odds(u) / odds(p)``; the
sample is the front of that order whose words come nearest to what is left of
the target. The front is found by counting words in cells of the rank (two
rounds), so no source is ever sorted or gathered in one task. As ``p`` is one number per source, the rank
within a source is the order of the draws; it is between sources that inclusion differs.

Defined results: null or empty texts have size 0 and take nothing; a null source
is a source of its own, ordered last; rows repeated under one id and size share
their draw and are taken together; an empty table gives an empty result; a
source whose size is 0 has target 0. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stash
from .spans import shielded

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
CELLS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, size: Column) -> Column:
    """A number in (0, 1) from 52 bits of a digest of the id and the size."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), size.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def rank_value(u: Column, p: Column) -> Column:
    """The Pareto rank ``odds(u) / odds(p)``, mapped into (0, 1) without changing the order."""
    q = (u / (1 - u)) / (p / (1 - p))
    return F.when((p > 0) & (p < 1), q / (1 + q)).otherwise(F.lit(1.0))


def _positions(sources: DataFrame) -> DataFrame:
    """Adds ``position``, the 0-based place of each source by code point, null last.

    Ranges are sorted in parallel; only their row counts are added up in one task.
    """
    spread = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    spread = stash(spread, "mix-sources")
    counts = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return (
        spread.withColumn("place", F.row_number().over(within) - 1)
        .join(starts, "part")
        .withColumn("position", F.col("start") + F.col("place"))
        .drop("part", "start", "place")
    )


def source_targets(sized: DataFrame, weights=WEIGHTS, total_share=TOTAL_SHARE, most=MOST_COPIES) -> DataFrame:
    """source, source_size, target from a table with ``source`` and ``size``.

    Shares follow the weights; what exceeds ``most`` times a source's size is
    shared again among the others by weight until nothing exceeds.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = _positions(sources).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    )
    sources = stash(sources.withColumn("cap", F.col("source_size").cast("double") * F.lit(float(most))), "mix-weights")
    wanted = (sources.agg(F.sum("source_size")).first()[0] or 0) * total_share
    level = 0.0
    while True:
        above = F.col("cap") < F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("kept"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row["open"]:
            break
        new = (wanted - row["kept"]) / row["open"]
        if new <= level:
            break
        level = new
    return sources.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def _shares(targets: DataFrame) -> DataFrame:
    size = F.col("source_size").cast("double")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / size).otherwise(F.lit(0.0))
    return (
        targets.withColumn("certain", F.floor(ratio).cast("long"))
        .withColumn("p", ratio - F.floor(ratio))
        .withColumn("rest", F.col("target") - F.col("certain") * size)
    )


def _front(keyed: DataFrame, shares: DataFrame) -> DataFrame:
    """source, last_rank, last_id: the last document of each source's sample."""
    source = "source"
    ahead = Window.partitionBy("s_key", "s_null").orderBy("cell")

    def crossing(rows: DataFrame, cell: Column, base: DataFrame) -> DataFrame:
        """The cell in which each source's words pass its remainder, and the words before it."""
        counted = rows.groupBy(source, cell.alias("cell")).agg(F.sum("size").alias("words"))
        joined = counted.join(base.withColumnRenamed(source, "b_source"), F.col(source).eqNullSafe(F.col("b_source"))).drop("b_source")
        joined = joined.withColumn("s_key", F.coalesce(source, F.lit(""))).withColumn("s_null", F.col(source).isNull())
        joined = joined.withColumn("upto", F.col("before") + F.sum("words").over(ahead))
        passed = joined.filter(F.col("upto") > F.col("rest"))
        return passed.groupBy(source).agg(
            F.min_by(F.struct("cell", (F.col("upto") - F.col("words")).alias("before"), "rest"), "cell").alias("x")
        ).select(source, "x.cell", "x.before", "x.rest")

    coarse = F.floor(F.col("rank") * CELLS).cast("long")
    fine = F.floor((F.col("rank") * CELLS - coarse) * CELLS).cast("long")
    base = shares.filter(F.col("p") > 0).select(source, "rest", F.lit(0).cast("long").alias("before"))
    first = crossing(keyed, coarse, base)

    def inside(rows: DataFrame, cells: DataFrame, cell: Column) -> DataFrame:
        c = cells.select(F.col(source).alias("c_source"), F.col("cell").alias("c_cell"))
        return rows.join(c, F.col(source).eqNullSafe(F.col("c_source")) & (cell == F.col("c_cell"))).select(*rows.columns)

    narrow = stash(inside(keyed, first, coarse), "mix-cell")
    second = stash(crossing(narrow, fine, first.select(source, "rest", "before")), "mix-cells")
    last = inside(narrow, second, fine).groupBy(source, "rank", "doc_id").agg(F.sum("size").alias("words"))
    base2 = second.select(F.col(source).alias("b_source"), "before", "rest")
    order = Window.partitionBy("s_key", "s_null").orderBy("rank", F.col("doc_id").asc_nulls_last())
    walked = (
        last.join(base2, F.col(source).eqNullSafe(F.col("b_source")))
        .withColumn("s_key", F.coalesce(source, F.lit("")))
        .withColumn("s_null", F.col(source).isNull())
        .withColumn("upto", F.col("before") + F.sum("words").over(order))
        .withColumn("nth", F.row_number().over(order))
    )
    near = walked.filter(2 * F.col("upto") - F.col("words") <= 2 * F.col("rest"))
    picked = near.groupBy(source).agg(F.max_by(F.struct("rank", "doc_id"), "nth").alias("x")).select(
        source, F.col("x.rank").alias("last_rank"), F.col("x.doc_id").alias("last_id")
    )
    # Of a source whose crossing cell gives no document, all cells before it are taken.
    bound = second.join(
        first.select(F.col(source).alias("f_source"), F.col("cell").alias("coarse")), F.col(source).eqNullSafe(F.col("f_source"))
    ).select(F.col(source).alias("e_source"), ((F.col("coarse") + F.col("cell") / F.lit(float(CELLS))) / F.lit(float(CELLS))).alias("edge"))
    return bound.join(picked, F.col("e_source").eqNullSafe(F.col(source)), "left").select(
        F.col("e_source").alias(source), "edge", "last_rank", "last_id"
    )


def plan_mix(docs: DataFrame, text="text", **rules) -> DataFrame:
    """Per source: what :func:`apply_mix` needs (certain copies, chance, end of the sample)."""
    sized = stash(docs.select("doc_id", "source", word_count(F.col(text)).alias("size")), "mix-sizes")
    shares = stash(_shares(source_targets(sized, **rules)), "mix-shares")
    s = shares.select(F.col("source").alias("t_source"), "p")
    keyed = sized.join(s, F.col("source").eqNullSafe(F.col("t_source"))).filter("p > 0").withColumn(
        "rank", rank_value(uniform(F.col("doc_id"), F.col("size")), F.col("p"))
    ).select("doc_id", "source", "size", "rank")
    front = _front(keyed, shares).withColumnRenamed("source", "f_source")
    return stash(shares.join(front, F.col("source").eqNullSafe(F.col("f_source")), "left").drop("f_source"), "mix-plan")


def apply_mix(docs: DataFrame, plan: DataFrame, text="text") -> DataFrame:
    """``docs`` with vg_size, vg_source_size, vg_target and vg_copies, the copies that the mix takes."""
    p = plan.select(*[F.col(c).alias(f"vgp_{c}") for c in plan.columns])
    size = word_count(F.col(text))
    rank = rank_value(uniform(F.col("doc_id"), F.col("vg_size")), F.col("vgp_p"))
    at = F.col("vg_rank")
    in_front = (
        (at < F.col("vgp_edge"))
        | (at < F.col("vgp_last_rank"))
        | ((at == F.col("vgp_last_rank")) & (F.col("vgp_last_id").isNull() | (F.col("doc_id") <= F.col("vgp_last_id"))))
    )
    sampled = F.when(F.col("vgp_p") <= 0, 0).when(F.col("vgp_edge").isNull(), 1).when(F.coalesce(in_front, F.lit(False)), 1).otherwise(0)
    return (
        docs.withColumn("vg_size", size)
        .join(p, F.col("source").eqNullSafe(F.col("vgp_source")))
        .withColumn("vg_rank", rank)
        .withColumn("vg_copies", (F.col("vgp_certain") + sampled).cast("long"))
        .withColumn("vg_source_size", F.col("vgp_source_size"))
        .withColumn("vg_target", F.col("vgp_target"))
        .drop("vg_rank", *p.columns)
    )


def mix(docs: DataFrame, **rules) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the columns of ``docs``, whatever their names."""
    plain, named = shielded(docs)
    out = apply_mix(plain, plan_mix(plain, **rules)).filter("vg_copies > 0")
    return named(out.withColumn("vg_i", F.explode(F.sequence(F.lit(1), F.col("vg_copies").cast("int")))))


def op10(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", "source", "text")
    return apply_mix(d, plan_mix(d)).select(
        "doc_id",
        F.col("vg_size").alias("size"),
        F.col("vg_source_size").alias("source_size"),
        F.col("vg_target").alias("target"),
        (F.col("vg_copies") * F.col("vg_size")).alias("taken"),
    )


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS position FROM sized GROUP BY source
), w AS (
  SELECT *, CASE position % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size::DOUBLE * 2.0::DOUBLE AS cap FROM src
), o AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, position) AS k FROM w
), acc AS (
  SELECT *, sum(cap) OVER (ORDER BY k) AS kept, sum(weight) OVER () - sum(weight) OVER (ORDER BY k) AS open,
    lead(cap / weight) OVER (ORDER BY k) AS next_ratio, (SELECT sum(source_size)::DOUBLE * 1.5::DOUBLE FROM src) AS wanted FROM o
), levels AS (
  SELECT (wanted - kept) / open AS level, cap / weight AS ratio, next_ratio FROM acc WHERE open > 0
  UNION ALL SELECT max(wanted) / sum(weight), -1.0::DOUBLE, min(cap / weight) FROM acc
), level AS (
  SELECT level FROM levels WHERE ratio < level AND (next_ratio IS NULL OR next_ratio >= level) ORDER BY level LIMIT 1
), t AS (
  SELECT source, source_size, least(cap, weight * (SELECT level FROM level)) AS target FROM w
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS ratio FROM t
), s AS (
  SELECT *, floor(ratio)::BIGINT AS certain, ratio - floor(ratio) AS p, target - floor(ratio) * source_size::DOUBLE AS rest FROM r
), u AS (
  SELECT d.doc_id, d.source, d.size, s.source_size, s.target, s.certain, s.p, s.rest,
    ((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || ':' || d.size::VARCHAR), 1, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), q AS (
  SELECT *, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM u
), z AS (
  SELECT *, coalesce(odds / (1 + odds), 1.0::DOUBLE) AS rank FROM q
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS LAST) AS upto, sum(size) OVER (PARTITION BY source, rank, doc_id) AS words FROM z
)
SELECT doc_id, size, source_size, target,
  (size * (certain + CASE WHEN p > 0 AND 2 * upto - words <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
