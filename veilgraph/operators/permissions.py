"""Who may read what: memberships, inheritance along the reporting lines, and the gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import counting
from .loops import settle, transitive


def org_closure(manages: DataFrame) -> DataFrame:
    """manager, report: everyone below a manager, at any depth; cycles end."""
    return transitive(manages.select("manager", "report"))[0]


def permitted(member_of: DataFrame, manages: DataFrame | None) -> DataFrame:
    """principal, space: own memberships and those of everyone below; without ``manages``, own alone."""
    own = member_of.select("principal", "space")
    if manages is None:
        return own.distinct()
    below = org_closure(manages).join(own.withColumnRenamed("principal", "report"), "report")
    return own.union(below.select(F.col("manager").alias("principal"), "space")).distinct()


def as_arrays(permitted_rows: DataFrame) -> DataFrame:
    """principal, perm: the sorted spaces of each principal."""
    return permitted_rows.groupBy("principal").agg(F.array_sort(F.collect_set("space")).alias("perm"))


def admissible(perm: Column, req: Column) -> Column:
    """Whether every required space is permitted; an unknown principal (null ``perm``) is refused even where nothing is required."""
    return F.coalesce(perm.isNotNull() & F.forall(req, lambda s: F.array_contains(perm, s)), F.lit(False))


def missing(perm: Column, req: Column) -> Column:
    return F.array_except(req, F.coalesce(perm, F.array().cast("array<string>")))


def decision(perm: Column, req: Column) -> Column:
    """Fail closed: an empty or unknown requirement is refused."""
    return F.coalesce((F.size(req) > 0) & admissible(perm, req), F.lit(False))


def gates(perm: Column, req: Column, space: Column) -> dict[str, Column]:
    """What each gate discloses."""
    return {
        "ungated": F.lit(True),
        "document-acl": F.coalesce(F.array_contains(perm, space), F.lit(False)),
        "any-source": F.coalesce(F.arrays_overlap(perm, req), F.lit(False)),
        "derivation-aware": admissible(perm, req),
    }


def audiences(facts: DataFrame, perms: DataFrame, *group: str, also: str | None = None) -> DataFrame:
    """Distinct (group, space, req) with n_facts, and how many principals there are, and each gate lets through: everyone, ok, filed, some, ok_filed, ok_some.

    ok: those who may read all of req; filed: the filed-under space; some: any of req. ``also``: a further array; ok_also are those who may read
    all of req and of it. Distinct sets are counted by bitmaps (:mod:`counting`), and no pair of them becomes a row.
    """
    f = settle(facts.groupBy(*group, "space", "req").agg(F.count(F.lit(1)).alias("n_facts")))
    sets = counting.counted_sets(perms)
    own, home = counting.wanted(F.col("req")), F.array("space")
    asks = {"w_req": own, "w_home": home, "w_both": counting.wanted(own, home)}
    if also:
        asks["w_also"] = counting.wanted(own, F.col(also))
    f = f.withColumns(asks)
    told = counting.holders(f.select(F.explode(F.array(*asks)).alias("want")), sets)

    def with_(df: DataFrame, ask: str, **names: str) -> DataFrame:
        return df.join(told.select(F.col("want").alias(ask), *[F.col(k).alias(v) for k, v in names.items()]), ask, "left").drop(ask)

    f = with_(with_(with_(f, "w_req", n_all="ok", n_any="some"), "w_home", n_all="filed"), "w_both", n_all="ok_filed")
    f = with_(f, "w_also", n_all="ok_also") if also else f
    # all of something is some of it
    f = f.withColumn("ok_some", F.when(F.size("req") > 0, F.col("ok")))
    f = f.crossJoin(sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("everyone"))).filter("everyone > 0")
    return f.fillna(0, ["ok", "some", "filed", "ok_filed", "ok_some", *(["ok_also"] if also else [])])


def let_through() -> Column:
    """For every row of :func:`audiences`: gate, open, leaked and false_denials of each gate, in principals."""
    ok, shut = F.col("ok"), F.lit(0).cast("long")
    rows = (("ungated", F.col("everyone"), ok), ("document-acl", F.col("filed"), F.col("ok_filed")), ("any-source", F.col("some"), F.col("ok_some")), ("derivation-aware", ok, ok))
    return F.array(*[F.struct(F.lit(k).alias("gate"), n.alias("open"), (n - both + shut).alias("leaked"), (ok - both + shut).alias("false_denials")) for k, n, both in rows])
