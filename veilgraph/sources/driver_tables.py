"""The roles of principal, space, source and fact, played by the TPC-H-like driver tables.

space = part brand; entity = customer; level-0 fact = a returned line item of a large
quantity, filed under its part's brand; principal = supplier; memberships come from other line items; suppliers report in a 4-ary tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@dataclass
class World:
    """Level-0 facts (fact_id, entity, space, ord), memberships and reporting lines; what a level-0 fact says (fact_id, text)."""

    facts0: DataFrame
    member_of: DataFrame
    manages: DataFrame
    said: DataFrame
    people: DataFrame


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def world(spark: SparkSession, sf_dir: str) -> World:
    line = read(spark, sf_dir, "lineitem")
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("space"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("entity"))
    sources = line.filter("l_returnflag = 'R' and l_quantity >= 45").select(*KEY).dropDuplicates(list(KEY))
    facts0 = (
        sources.join(part, "l_partkey")
        .join(orders, "l_orderkey")
        .select(F.concat_ws("-", *KEY).alias("fact_id"), "entity", "space", F.struct(*KEY).alias("ord"))
    )
    member_of = (
        line.filter("l_returnflag = 'A' and l_quantity >= 49 and l_linenumber = 1")
        .select("l_partkey", F.col("l_suppkey").alias("principal"))
        .join(part, "l_partkey")
        .select("principal", "space")
        .distinct()
    )
    manages = (
        read(spark, sf_dir, "supplier")
        .filter("s_suppkey > 0")
        .select(F.expr("(s_suppkey - 1) div 4").alias("manager"), F.col("s_suppkey").alias("report"))
    )
    # a source says whose order it was, its brand, and the brand that the order opened with
    opened = line.filter("l_linenumber = 1").select("l_orderkey", "l_partkey").join(part, "l_partkey").groupBy("l_orderkey").agg(F.min("space").alias("opening"))
    people = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    named = facts0.select("fact_id", "entity", "space", F.col("ord.l_orderkey").alias("l_orderkey")).join(opened, "l_orderkey", "left").join(people, F.col("entity") == F.col("id"), "left")
    text = F.concat(F.coalesce("name", F.lit("someone")), F.lit(" returned goods of "), F.col("space"), F.coalesce(F.concat(F.lit(" bought with "), F.col("opening")), F.lit("")))
    return World(facts0, member_of, manages, named.select("fact_id", text.alias("text")), people)


#: The same roles for DuckDB, as common table expressions.
PRELUDE = """
facts0 AS (
  SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS fact_id, o_custkey AS entity, p_brand AS space,
    l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 45
), member_of AS (
  SELECT DISTINCT l_suppkey AS principal, p_brand AS space FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE l_returnflag = 'A' AND l_quantity >= 49 AND l_linenumber = 1
), manages AS (
  SELECT (s_suppkey - 1) // 4 AS manager, s_suppkey AS report FROM supplier WHERE s_suppkey > 0
), org_closure AS (
  SELECT manager, report FROM manages UNION SELECT c.manager, m.report FROM org_closure c JOIN manages m ON m.manager = c.report
), permitted AS (
  SELECT principal, space FROM member_of UNION SELECT c.manager, m.space FROM org_closure c JOIN member_of m ON m.principal = c.report
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY k1, k2, k3, k4) AS nth, count(*) OVER (PARTITION BY entity) AS n_spaces FROM (
    SELECT *, row_number() OVER (PARTITION BY entity, space ORDER BY k1, k2, k3, k4) AS rn FROM facts0) WHERE rn = 1
), person_support AS (
  SELECT 'person:' || entity AS fact_id, entity, space, fact_id AS support_id, nth, k1, k2, k3, k4 FROM firsts WHERE n_spaces >= 2 AND nth <= 6
), person_first AS (SELECT * FROM person_support WHERE nth = 1),
pair_span AS (
  SELECT x.space AS a, y.space AS b, x.fact_id AS support_id, f.k1, f.k2, f.k3, f.k4, count(*) OVER (PARTITION BY x.space, y.space) AS n_people
  FROM person_support x JOIN person_support y ON x.entity = y.entity AND x.space < y.space JOIN person_first f ON f.entity = x.entity
), pair_support AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY k1, k2, k3, k4) AS nth FROM pair_span WHERE n_people >= 2) WHERE nth <= 6
), pairs AS (SELECT DISTINCT a, b FROM pair_support),
clusters AS (
  SELECT x.a, x.b, y.b AS c FROM pairs x JOIN pairs y ON x.b = y.a JOIN pairs z ON z.a = x.a AND z.b = y.b
), rests_on AS (
  SELECT fact_id, support_id, 'evidence' AS kind FROM person_support
  UNION ALL SELECT 'pair:' || a || ':' || b, support_id, 'derivation' FROM pair_support
  UNION ALL SELECT 'cluster:' || a || '|' || b || '|' || c, 'pair:' || a || ':' || b, 'derivation' FROM clusters
  UNION ALL SELECT 'cluster:' || a || '|' || b || '|' || c, 'pair:' || a || ':' || c, 'derivation' FROM clusters
  UNION ALL SELECT 'cluster:' || a || '|' || b || '|' || c, 'pair:' || b || ':' || c, 'derivation' FROM clusters
), walk AS (
  SELECT fact_id, support_id FROM rests_on UNION SELECT w.fact_id, r.support_id FROM walk w JOIN rests_on r ON r.fact_id = w.support_id
), required AS (
  SELECT DISTINCT w.fact_id, f.space FROM walk w JOIN facts0 f ON f.fact_id = w.support_id
), derived AS (
  SELECT fact_id, 1 AS level, space, fact_id AS claim FROM person_first
  UNION ALL SELECT 'pair:' || a || ':' || b, 2, a, 'pair|' || a || '|' || b FROM pairs
  UNION ALL SELECT 'cluster:' || a || '|' || b || '|' || c, 3, a, 'cluster|' || a || '|' || b || '|' || c FROM clusters
), req AS (
  SELECT d.fact_id, d.level, d.space, d.claim, list(r.space ORDER BY r.space) AS req FROM derived d JOIN required r USING (fact_id) GROUP BY ALL
), perm AS (SELECT principal, list(space ORDER BY space) AS perm FROM permitted GROUP BY principal),
pairs_fp AS (
  SELECT q.*, p.principal, p.perm, list_has_all(p.perm, q.req) AS ok, list_contains(p.perm, q.space) AS filed_ok, list_has_any(p.perm, q.req) AS any_ok FROM req q CROSS JOIN perm p
)"""
