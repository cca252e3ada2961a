"""Queries over the derivation world: permissions, facts, gates, adversary, policy, attack, channels."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import adversary as A
from ..operators import attack, channels, claims, derivation, graph, policy, provenance, sampling
from ..operators import permissions as P
from ..operators.loops import settle
from ..sources.driver_tables import PRELUDE, World, world

csv = lambda c: F.array_join(c, ",")


def counted(sql: str) -> str:
    """``count_if(x)`` as a filtered count, which is a 64-bit integer in DuckDB."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + len('count_if('):end - 1]}){sql[end:]}"
    return sql


@dataclass
class Case:
    """A world and what is derived from it, each built once per query."""

    w: World

    @cached_property
    def permitted(self) -> DataFrame:
        return settle(P.permitted(self.w.member_of, self.w.manages))

    @cached_property
    def perms(self) -> DataFrame:
        return P.as_arrays(self.permitted)

    @cached_property
    def derived(self) -> tuple[DataFrame, DataFrame]:
        facts, edges = derivation.derive(self.w.facts0)
        return settle(facts), settle(edges)

    @cached_property
    def required(self) -> DataFrame:
        return settle(provenance.required_by_levels(*self.derived, self.w.facts0))

    @cached_property
    def facts(self) -> DataFrame:
        return provenance.with_requirement(self.derived[0], self.required)

    @cached_property
    def everything(self) -> DataFrame:
        """Level-0 facts beside the derived ones: fact_id, level, space, req."""
        zero = self.w.facts0.select("fact_id", F.lit(0).alias("level"), "space", F.array("space").alias("req"))
        return zero.unionByName(self.facts.select("fact_id", "level", "space", "req"))

    @cached_property
    def seen(self) -> DataFrame:
        return A.visible(self.w.facts0, self.permitted)

    @cached_property
    def sets(self) -> DataFrame:
        """sig, perm, np: the distinct sets of spaces, and how many principals have each."""
        return settle(self.perms.groupBy("perm").agg(F.count(F.lit(1)).alias("np")).withColumn("sig", F.sha2(csv("perm"), 256)))

    @cached_property
    def seen_by_set(self) -> DataFrame:
        """sig, entity, space, fact_id, ord: what principals with a set of spaces may read; the adversary works once for all of them."""
        return A.visible(self.w.facts0, self.sets.select("sig", F.explode("perm").alias("space")), "sig")

    @cached_property
    def named_sets(self) -> DataFrame:
        """sig, names, n: :attr:`sets` under the names of :mod:`counting`."""
        return self.sets.select("sig", F.col("perm").alias("names"), F.col("np").alias("n"))

    @cached_property
    def spans(self) -> DataFrame:
        """entity, a, b, cost, side."""
        return settle(A.spans_everywhere(self.w.facts0))

    @cached_property
    def rebuilt(self) -> DataFrame:
        """sig, a, b, n_people."""
        return settle(A.rebuilt_pairs(self.w.facts0, self.named_sets))

    def by_principal(self, rows: DataFrame) -> DataFrame:
        """Rows by ``sig`` for every principal with that set."""
        return rows.join(self.perms.select("principal", F.sha2(csv("perm"), 256).alias("sig")), "sig").drop("sig")

    def refusals(self, facts: DataFrame) -> DataFrame:
        """level, req, n: how often facts with a requirement are refused."""
        s = P.audiences(facts, self.perms, "level").withColumn("refused", F.col("everyone") - F.col("ok")).filter("refused > 0")
        return s.groupBy("level", "req").agg(F.sum(F.col("n_facts") * F.col("refused")).alias("n"))

    @cached_property
    def claims(self) -> DataFrame:
        """fact_id, entity, space: what level-0 and person facts assert."""
        zero = self.w.facts0.select("fact_id", "entity", "space")
        return zero.unionByName(derivation.person_support(self.w.facts0).select("fact_id", "entity", "space"))

    @cached_property
    def texts(self) -> DataFrame:
        """fact_id, level, space, text of every fact that says something: sources, and people across spaces."""
        person = derivation.person_support(self.w.facts0).groupBy("fact_id", "entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "space"))), lambda x: x["space"]), ", ").alias("where"))
        person = person.join(self.w.people, F.col("entity") == F.col("id")).select("fact_id", F.concat("name", F.lit(" spans "), "where").alias("text"))
        zero = self.w.facts0.select("fact_id", F.lit(0).alias("level"), "space").join(self.w.said, "fact_id")
        return zero.unionByName(self.derived[0].filter("level = 1").select("fact_id", "level", "space").join(person, "fact_id"))

    @cached_property
    def about(self) -> DataFrame:
        """fact_id, entity."""
        return self.w.facts0.select("fact_id", "entity").union(derivation.person_support(self.w.facts0).filter("nth = 1").select("fact_id", "entity"))

    @cached_property
    def named(self) -> DataFrame:
        """fact_id, named."""
        return settle(claims.spaces_named(self.texts, claims.space_names(self.w.facts0.select("space", F.lit(None).cast("string").alias("label")).distinct())))

    @cached_property
    def said(self) -> DataFrame:
        """fact_id, entity, space: the claims read from texts."""
        return settle(claims.claims_of(self.texts, self.about, self.named, claims.entity_names(self.w.people)))

    @cached_property
    def widened(self) -> DataFrame:
        """:attr:`everything` with named and widened."""
        rows = self.everything.join(self.named, "fact_id", "left")
        return rows.withColumn("widened", claims.widened(F.col("req"), F.col("named")))

    def pairs(self, facts: DataFrame | None = None) -> DataFrame:
        return (self.facts if facts is None else facts).crossJoin(self.perms)


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        def run(spark, sf_dir):
            return fn(Case(world(spark, sf_dir)))

        run.__doc__, run.__name__ = fn.__doc__, fn.__name__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE_SQL[fn.__name__] = counted(f"WITH RECURSIVE {PRELUDE.strip()}\n{sql.strip()}")
        return fn

    return add


@query("SELECT manager, report FROM org_closure")
def org_closure(c: Case):
    """Everyone below each manager."""
    return P.org_closure(c.w.manages)


@query("SELECT principal, space FROM permitted")
def permitted_spaces(c: Case):
    """What each principal may read, inheritance included."""
    return c.permitted


@query("""SELECT (SELECT count(*) FROM perm) AS n_principals, (SELECT round(avg(len(perm)), 6) FROM perm) AS mean_spaces, (SELECT max(len(perm)) FROM perm) AS max_spaces,
  (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT principal FROM permitted)) AS n_without,
  (SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM permitted GROUP BY space)) AS mean_audience""")
def permission_stats(c: Case):
    """Breadth of access and of audiences."""
    people = c.w.manages.select(F.col("report").alias("principal")).union(c.w.manages.select("manager")).distinct()
    audience = c.permitted.groupBy("space").count().agg(F.round(F.avg("count"), 6).alias("mean_audience"))
    none = people.join(c.permitted, "principal", "left_anti").agg(F.count(F.lit(1)).alias("n_without"))
    size = F.size("perm")
    return c.perms.agg(F.count(F.lit(1)).alias("n_principals"), F.round(F.avg(size), 6).alias("mean_spaces"), F.max(size).cast("long").alias("max_spaces")).crossJoin(none).crossJoin(audience)


@query("SELECT x.space AS a, y.space AS b, count(*) AS n_shared FROM permitted x JOIN permitted y ON x.principal = y.principal AND x.space < y.space GROUP BY ALL")
def space_overlap(c: Case):
    """Pairs of spaces with readers in common."""
    x, y = c.permitted.toDF("principal", "a"), c.permitted.toDF("principal", "b")
    return x.join(y, "principal").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared"))


@query("SELECT space, count(*) AS n_readers FROM permitted GROUP BY space")
def audience_by_space(c: Case):
    """Readers of each space."""
    return c.permitted.groupBy("space").agg(F.count(F.lit(1)).alias("n_readers"))


@query("SELECT fact_id, entity, space FROM facts0")
def facts_l0(c: Case):
    """Observed facts."""
    return c.w.facts0.select("fact_id", "entity", "space")


@query("SELECT fact_id, level, space, array_to_string(req, ',') AS req FROM req WHERE level = 1")
def facts_l1(c: Case):
    """People across spaces."""
    return c.facts.filter("level = 1").select("fact_id", "level", "space", csv("req").alias("req"))


@query("SELECT fact_id, level, space, array_to_string(req, ',') AS req FROM req WHERE level = 2")
def facts_l2(c: Case):
    """Spaces that share people."""
    return c.facts.filter("level = 2").select("fact_id", "level", "space", csv("req").alias("req"))


@query("SELECT fact_id, level, space, array_to_string(req, ',') AS req FROM req WHERE level = 3")
def facts_l3(c: Case):
    """Clusters of spaces."""
    return c.facts.filter("level = 3").select("fact_id", "level", "space", csv("req").alias("req"))


@query("SELECT fact_id, support_id, kind FROM rests_on")
def rests_on_edges(c: Case):
    """What each derived fact rests on."""
    return c.derived[1]


@query("SELECT fact_id, space FROM required")
def required_by_walk(c: Case):
    """Required spaces by a fixpoint over the supports."""
    return provenance.required_by_walk(c.derived[1], c.w.facts0)


@query("SELECT fact_id, space FROM required")
def required_by_levels(c: Case):
    """Required spaces level by level."""
    return c.required


#: The requirement level by level, a second formulation beside the walk of the prelude.
LEVELS = """, lv1 AS (SELECT DISTINCT p.fact_id, f.space FROM person_support p JOIN facts0 f ON f.fact_id = p.support_id), lv2 AS (SELECT DISTINCT r.fact_id, l.space FROM rests_on r JOIN lv1 l ON l.fact_id = r.support_id),
lv3 AS (SELECT DISTINCT r.fact_id, l.space FROM rests_on r JOIN lv2 l ON l.fact_id = r.support_id), bylev AS (SELECT * FROM lv1 UNION ALL SELECT * FROM lv2 UNION ALL SELECT * FROM lv3),
two AS (SELECT fact_id, list(space ORDER BY space) AS req2 FROM bylev GROUP BY fact_id)
"""


@query("SELECT fact_id, space FROM required")
def required_by_stack(c: Case):
    """Required spaces handed up along the supports, a third formulation."""
    return provenance.required_by_stack(c.derived[1], c.w.facts0, c.derived[0])


@query(LEVELS + "SELECT coalesce(a.req = b.req2, false) AS same, count(*) AS n FROM (SELECT fact_id, list(space ORDER BY space) AS req FROM required GROUP BY fact_id) a FULL JOIN two b USING (fact_id) GROUP BY same")
def requirement_agreement(c: Case):
    """Facts on which the two formulations agree."""
    return provenance.agreement(provenance.required_by_walk(c.derived[1], c.w.facts0), c.required)


@query("SELECT level, count_if(ok) AS n_admissible, count_if(NOT ok) AS n_denied FROM pairs_fp GROUP BY level")
def admissible_counts(c: Case):
    """Admissible and denied (fact, principal) pairs by level, over distinct sets."""
    s, n = P.audiences(c.facts, c.perms, "level"), F.col("n_facts")
    return s.groupBy("level").agg(F.sum(n * F.col("ok")).alias("n_admissible"), F.sum(n * (F.col("everyone") - F.col("ok"))).alias("n_denied"))


@query("""SELECT fact_id, principal, array_to_string(list_sort(list_filter(req, lambda x: NOT list_contains(perm, x))), ',') AS missing
  FROM pairs_fp WHERE NOT ok""")
def missing_spaces(c: Case):
    """For refused pairings, the spaces that a principal lacks."""
    rows = c.pairs(c.facts).withColumn("gap", P.missing(F.col("perm"), F.col("req")))
    return rows.filter(F.size("gap") > 0).select("fact_id", "principal", csv(F.array_sort("gap")).alias("missing"))


@query("SELECT level, count_if(filed_ok) AS n_disclosed, count_if(filed_ok AND NOT ok) AS n_leaked FROM pairs_fp GROUP BY level")
def gate_document_acl(c: Case):
    """What a gate on the filed-under space discloses and leaks."""
    return _gate(c, "document-acl")


@query("SELECT level, count_if(any_ok) AS n_disclosed, count_if(any_ok AND NOT ok) AS n_leaked FROM pairs_fp GROUP BY level")
def gate_any_source(c: Case):
    """What a gate on any source discloses and leaks."""
    return _gate(c, "any-source")


def _gate(c: Case, name: str) -> DataFrame:
    s, n = P.audiences(c.facts, c.perms, "level").withColumn("x", F.explode(P.let_through())).filter(F.col("x.gate") == name), F.col("n_facts")
    return s.groupBy("level").agg(F.sum(n * F.col("x.open")).alias("n_disclosed"), F.sum(n * F.col("x.leaked")).alias("n_leaked"))


@query("""SELECT gate, level, count(*) AS n_pairs, count_if(open) AS n_disclosed, count_if(open AND NOT ok) AS n_leaked FROM (
  SELECT level, ok, unnest(['ungated', 'document-acl', 'any-source', 'derivation-aware']) AS gate, unnest([true, filed_ok, any_ok, ok]) AS open FROM pairs_fp) GROUP BY gate, level""")
def gate_leaks_by_level(c: Case):
    """Leaks of every gate by level."""
    s, n = P.audiences(c.facts, c.perms, "level").select("level", "n_facts", "everyone", F.explode(P.let_through()).alias("x")), F.col("n_facts")
    return s.groupBy("x.gate", "level").agg(F.sum(n * F.col("everyone")).alias("n_pairs"), F.sum(n * F.col("x.open")).alias("n_disclosed"), F.sum(n * F.col("x.leaked")).alias("n_leaked"))


@query("SELECT level, count_if(ok AND NOT filed_ok) AS n_filed, count_if(ok AND NOT any_ok) AS n_any FROM pairs_fp GROUP BY level")
def false_denials(c: Case):
    """What the other gates refuse although it is permitted."""
    s, n = P.audiences(c.facts, c.perms, "level"), F.col("n_facts")
    return s.groupBy("level").agg(F.sum(n * (F.col("ok") - F.col("ok_filed"))).alias("n_filed"), F.sum(n * (F.col("ok") - F.col("ok_some"))).alias("n_any"))


@query("""SELECT level, count_if(NOT ok AND len(req) >= 2) AS n_considered, count_if(NOT ok AND len(req) >= 2 AND any_ok) AS n_flips FROM pairs_fp GROUP BY level""")
def attribution_flips(c: Case):
    """Refusals that turn on which source is cited."""
    s, n = P.audiences(c.facts.withColumn("several", F.coalesce(F.size("req") >= 2, F.lit(False))), c.perms, "level", "several"), F.col("n_facts")
    several = lambda x, name: F.sum(F.when(F.col("several"), n * x).otherwise(0)).alias(name)
    return s.groupBy("level").agg(several(F.col("everyone") - F.col("ok"), "n_considered"), several(F.col("some") - F.col("ok_some"), "n_flips"))


@query("""SELECT level, count(*) AS n_facts, round(avg(len(req)), 6) AS mean_spaces, round(avg(n_aud), 6) AS mean_audience, count_if(n_aud = 0) AS n_invisible FROM (
  SELECT fact_id, level, any_value(req) AS req, count_if(ok) AS n_aud FROM pairs_fp GROUP BY fact_id, level) GROUP BY level""")
def audience_collapse(c: Case):
    """How audiences shrink with the level."""
    s = P.audiences(c.facts, c.perms, "level")
    w = lambda x: F.round(F.sum(x * F.col("n_facts")) / F.sum("n_facts"), 6)
    return s.groupBy("level").agg(
        F.sum("n_facts").alias("n_facts"), w(F.size("req")).alias("mean_spaces"), w(F.col("ok")).alias("mean_audience"), F.sum(F.when(F.col("ok") == 0, F.col("n_facts")).otherwise(0)).alias("n_invisible")
    )


@query(LEVELS + "SELECT count(*) AS n_pairs, count_if(list_has_all(perm, req2) AND NOT ok) AS n_violations FROM pairs_fp JOIN two USING (fact_id)")
def invariant_violations(c: Case):
    """Pairs disclosed under one formulation of the requirement and not under the other."""
    walk = provenance.required_by_walk(c.derived[1], c.w.facts0).groupBy("fact_id").agg(F.array_sort(F.collect_set("space")).alias("truth"))
    sets, n = P.audiences(c.facts.join(walk, "fact_id"), c.perms, "truth", also="truth"), F.col("n_facts")
    return sets.agg(F.sum(n * F.col("everyone")).alias("n_pairs"), F.sum(n * (F.col("ok") - F.col("ok_also"))).alias("n_violations"))


@query("""SELECT gate, count(*) AS pairs, count_if(open AND NOT ok) AS leaked, round(count_if(open AND NOT ok) / count(*), 6) AS leak_rate, count_if(ok AND NOT open) AS false_denials FROM (
  SELECT ok, unnest(['ungated', 'document-acl', 'any-source', 'derivation-aware']) AS gate, unnest([true, filed_ok, any_ok, ok]) AS open FROM pairs_fp) GROUP BY gate""")
def dkl_score(c: Case):
    """One score per gate."""
    s, n = P.audiences(c.facts, c.perms), F.col("n_facts")
    s = s.select("n_facts", "everyone", F.explode(P.let_through()).alias("x"))
    leaked = F.sum(n * F.col("x.leaked"))
    return s.groupBy("x.gate").agg(F.sum(n * F.col("everyone")).alias("pairs"), leaked.alias("leaked"), F.round(leaked / F.sum(n * F.col("everyone")), 6).alias("leak_rate"), F.sum(n * F.col("x.false_denials")).alias("false_denials"))


@query("""SELECT fact_id, level, n_audience, n_spaces FROM (SELECT fact_id, level, count_if(ok) AS n_audience, any_value(len(req)) AS n_spaces FROM pairs_fp GROUP BY fact_id, level)
  ORDER BY n_audience, n_spaces DESC, fact_id LIMIT 40""")
def risk_surface(c: Case):
    """The 40 derived facts with the smallest audience."""
    aud = P.audiences(c.facts.withColumn("space", F.get("req", F.lit(0))), c.perms).groupBy("req").agg(F.sum("ok").alias("n_audience"))
    rows = c.facts.join(aud, "req").select("fact_id", "level", "n_audience", F.size("req").cast("long").alias("n_spaces"))
    return rows.orderBy("n_audience", F.desc("n_spaces"), "fact_id").limit(40)


SEEN = """, seen AS (SELECT p.principal, f.* FROM facts0 f JOIN permitted p USING (space)),
v_first AS (SELECT *, row_number() OVER (PARTITION BY principal, entity ORDER BY k1, k2, k3, k4) AS nth, count(*) OVER (PARTITION BY principal, entity) AS n_spaces FROM (
  SELECT *, row_number() OVER (PARTITION BY principal, entity, space ORDER BY k1, k2, k3, k4) AS rn FROM seen) WHERE rn = 1),
v_person AS (SELECT * FROM v_first WHERE n_spaces >= 2 AND nth <= 6),
v_pair AS (SELECT x.principal, x.space AS a, y.space AS b, count(*) AS n_people FROM v_person x JOIN v_person y ON x.principal = y.principal AND x.entity = y.entity AND x.space < y.space
  GROUP BY ALL HAVING count(*) >= 2),
v_cluster AS (SELECT x.principal, x.a, x.b, y.b AS c FROM v_pair x JOIN v_pair y ON x.principal = y.principal AND x.b = y.a JOIN v_pair z ON z.principal = x.principal AND z.a = x.a AND z.b = y.b),
rebuilt AS (SELECT DISTINCT principal, 'person:' || entity AS claim FROM v_person UNION ALL SELECT principal, 'pair|' || a || '|' || b FROM v_pair UNION ALL SELECT principal, 'cluster|' || a || '|' || b || '|' || c FROM v_cluster),
cost AS (SELECT x.principal, x.entity, x.space AS a, y.space AS b, least(x.n, y.n) AS cost FROM (SELECT principal, entity, space, count(*) AS n FROM seen GROUP BY ALL) x
  JOIN (SELECT principal, entity, space, count(*) AS n FROM seen GROUP BY ALL) y ON x.principal = y.principal AND x.entity = y.entity AND x.space < y.space),
pair_cost AS (SELECT principal, a, b, count(*) AS n_spans, CASE WHEN count(*) >= 2 THEN sum(cost)::BIGINT - max(cost) ELSE 0 END AS cost FROM cost GROUP BY ALL)
"""


@query(SEEN + "SELECT principal, a, b, n_people FROM v_pair")
def reconstruct_pairs(c: Case):
    """Pairings each principal can rebuild."""
    return c.by_principal(c.rebuilt).select("principal", "a", "b", "n_people")


@query(SEEN + "SELECT principal, a, b, c FROM v_cluster")
def reconstruct_clusters(c: Case):
    """Clusters each principal can rebuild."""
    return c.by_principal(derivation.clusters(c.rebuilt, ("sig",))).select("principal", "a", "b", "c")


@query("SELECT level, count(DISTINCT claim) AS n_claims, count(*) AS n_refusals FROM pairs_fp WHERE NOT ok GROUP BY level")
def protected_claims(c: Case):
    """Refused derived claims."""
    told = c.refusals(c.facts).filter("level > 0")
    claims_ = c.facts.join(told.select("level", "req"), ["level", "req"], "left_semi").groupBy("level").agg(F.count_distinct("claim").alias("n_claims"))
    return claims_.join(told.groupBy("level").agg(F.sum("n").alias("n_refusals")), "level")


@query(SEEN + """SELECT level, count(*) AS n_denied, count_if(r.claim IS NOT NULL) AS n_phantom FROM pairs_fp d LEFT JOIN rebuilt r ON r.principal = d.principal AND r.claim = d.claim
  WHERE NOT ok GROUP BY level""")
def phantom_by_depth(c: Case):
    """Refusals that protect nothing, by level."""
    # what is rebuilt meets the facts by its claim; only the refused ones count
    hit = A.rebuilt_claims(c.seen_by_set, "sig").distinct().join(c.facts.select("level", "claim", "req"), "claim").join(c.sets, "sig")
    hit = hit.filter(~P.admissible(F.col("perm"), F.col("req"))).groupBy("level").agg(F.sum("np").alias("n_phantom"))
    denied = c.refusals(c.facts).groupBy("level").agg(F.sum("n").alias("n_denied"))
    return denied.join(hit, "level", "left").select("level", "n_denied", F.coalesce("n_phantom", F.lit(0)).alias("n_phantom"))


@query(SEEN + "SELECT principal, a, b, count(*) AS n_spans, sum(cost)::BIGINT AS total, max(cost) AS dearest FROM cost GROUP BY ALL")
def span_cost(c: Case):
    """What ending the spans of each pair costs."""
    return c.by_principal(A.within(c.named_sets, A.cheapest(c.spans))).select("principal", "a", "b", "n_spans", "total", "dearest")


@query(SEEN + "SELECT principal, a, b, n_spans, cost FROM pair_cost")
def pair_cut(c: Case):
    """The cut of each pair."""
    return c.by_principal(A.within(c.named_sets, A.cheapest(c.spans))).select("principal", "a", "b", "n_spans", "cost")


@query(SEEN + """SELECT v.principal, v.a, v.b, v.c, least(coalesce(x.cost, 0), coalesce(y.cost, 0), coalesce(z.cost, 0)) AS cost FROM v_cluster v
  LEFT JOIN pair_cost x ON x.principal = v.principal AND x.a = v.a AND x.b = v.b LEFT JOIN pair_cost y ON y.principal = v.principal AND y.a = v.a AND y.b = v.c
  LEFT JOIN pair_cost z ON z.principal = v.principal AND z.a = v.b AND z.b = v.c""")
def cluster_cut(c: Case):
    """The cut of each cluster."""
    cuts = A.cheapest(c.spans).select(F.lit(0).alias("all"), "a", "b", "cost")
    # a set with three spaces pays for their pairs what all sets do
    found = settle(derivation.clusters(c.rebuilt, ("sig",)))
    priced = A.cluster_cuts(cuts, found.select(F.lit(0).alias("all"), "a", "b", "c").distinct(), "all").drop("all")
    return c.by_principal(found.join(priced, ["a", "b", "c"])).select("principal", "a", "b", "c", "cost")


@query(SEEN + """, ranked AS (SELECT c.*, row_number() OVER (PARTITION BY c.principal, c.a, c.b ORDER BY c.cost DESC, c.entity) AS rk FROM cost c JOIN v_pair USING (principal, a, b)),
n AS (SELECT principal, entity, space, count(*) AS n FROM seen GROUP BY ALL),
side AS (SELECT r.principal, r.a, r.b, r.entity, CASE WHEN x.n <= y.n THEN r.a ELSE r.b END AS space FROM ranked r JOIN n x ON x.principal = r.principal AND x.entity = r.entity AND x.space = r.a
  JOIN n y ON y.principal = r.principal AND y.entity = r.entity AND y.space = r.b WHERE rk > 1),
kept AS (SELECT c.principal, c.a, c.b, s.entity, s.space, s.fact_id, s.k1, s.k2, s.k3, s.k4 FROM ranked c JOIN seen s ON s.principal = c.principal AND s.entity = c.entity
  WHERE NOT EXISTS (SELECT 1 FROM side d WHERE d.principal = c.principal AND d.a = c.a AND d.b = c.b AND d.entity = s.entity AND d.space = s.space)),
kf AS (SELECT *, row_number() OVER (PARTITION BY principal, a, b, entity ORDER BY k1, k2, k3, k4) AS nth, count(*) OVER (PARTITION BY principal, a, b, entity) AS ns FROM (
  SELECT *, row_number() OVER (PARTITION BY principal, a, b, entity, space ORDER BY k1, k2, k3, k4) AS rn FROM kept) WHERE rn = 1),
again AS (SELECT principal, a, b, count(*) AS n FROM (SELECT principal, a, b, entity FROM kf WHERE ns >= 2 AND nth <= 6 AND space IN (a, b) GROUP BY ALL HAVING count(*) = 2) GROUP BY ALL),
gone AS (SELECT d.principal, d.a, d.b, count(*) AS n FROM side d JOIN seen s ON s.principal = d.principal AND s.entity = d.entity AND s.space = d.space GROUP BY ALL)
SELECT v.principal, v.a, v.b, coalesce(again.n, 0) < 2 AS holds, coalesce(gone.n, 0) AS n_withheld FROM v_pair v LEFT JOIN again USING (principal, a, b) LEFT JOIN gone USING (principal, a, b)""")
def cut_holds(c: Case):
    """Pairs that the cut truly ends, by deriving again without the withheld facts."""
    held = A.cuts_hold_everywhere(c.w.facts0, c.spans)
    return c.by_principal(c.rebuilt.join(held, ["a", "b"])).select("principal", "a", "b", "holds", "n_withheld")


@query(SEEN + """, ranked AS (SELECT c.*, row_number() OVER (PARTITION BY c.principal, c.a, c.b ORDER BY c.cost DESC, c.entity) AS rk FROM cost c JOIN v_pair USING (principal, a, b)),
n AS (SELECT principal, entity, space, count(*) AS n FROM seen GROUP BY ALL),
side AS (SELECT r.principal, r.entity, CASE WHEN x.n <= y.n THEN r.a ELSE r.b END AS space FROM ranked r JOIN n x ON x.principal = r.principal AND x.entity = r.entity AND x.space = r.a
  JOIN n y ON y.principal = r.principal AND y.entity = r.entity AND y.space = r.b WHERE rk > 1)
SELECT (SELECT count(*) FROM seen) AS n_held, (SELECT count(*) FROM (SELECT DISTINCT s.principal, s.fact_id FROM seen s JOIN side USING (principal, entity, space))) AS n_withheld""")
def evidence_loss(c: Case):
    """How much readable evidence all cuts together withhold."""
    return A.evidence_lost(c.w.facts0, c.named_sets, c.spans, c.rebuilt)


@query(""", again AS (SELECT principal, space FROM permitted UNION SELECT c.manager, p.space FROM org_closure c JOIN permitted p ON p.principal = c.report)
SELECT (SELECT count(*) FROM permitted) AS n_grants, (SELECT count(*) FROM (SELECT * FROM again EXCEPT SELECT * FROM permitted)) + (SELECT count(*) FROM (SELECT * FROM permitted EXCEPT SELECT * FROM again)) AS drift""")
def policy_roundtrip(c: Case):
    """A policy taken from the model and compiled again does not drift."""
    again = policy.compile_policy(c.permitted.toDF("subject", "space"), c.w.manages)
    drift = again.exceptAll(c.permitted).union(c.permitted.exceptAll(again)).agg(F.count(F.lit(1)).alias("drift"))
    return c.permitted.agg(F.count(F.lit(1)).alias("n_grants")).crossJoin(drift)


CHANGE = """, target AS (SELECT min(space) AS space FROM facts0), subject AS (SELECT min(principal) AS principal FROM member_of WHERE principal NOT IN (SELECT principal FROM permitted WHERE space = (SELECT space FROM target))),
own2 AS (SELECT principal, space FROM member_of UNION SELECT s.principal, t.space FROM subject s, target t WHERE s.principal IS NOT NULL),
after AS (SELECT principal, space FROM own2 UNION SELECT c.manager, m.space FROM org_closure c JOIN own2 m ON m.principal = c.report),
aperm AS (SELECT principal, list(space ORDER BY space) AS perm FROM after GROUP BY principal),
changed AS (SELECT coalesce(a.principal, b.principal) AS principal, coalesce(b.perm, []) AS old, coalesce(a.perm, []) AS new FROM aperm a FULL JOIN perm b ON a.principal = b.principal
  WHERE a.perm IS DISTINCT FROM b.perm)
"""


def _change(c: Case):
    """One grant: the first space, to the first member who may not read it."""
    space = c.w.facts0.agg(F.min("space").alias("space"))
    holders = c.permitted.join(space, "space", "left_semi").select("principal")
    subject = c.w.member_of.join(holders, "principal", "left_anti").agg(F.min("principal").alias("subject")).filter("subject is not null")
    own = c.w.member_of.withColumnRenamed("principal", "subject")
    return policy.compile_policy(policy.grant(own, subject.crossJoin(space)), c.w.manages)


@query(CHANGE + """, docs AS (SELECT space, count(*) AS n FROM facts0 GROUP BY space)
SELECT principal, len(list_filter(new, lambda x: NOT list_contains(old, x))) AS spaces_gained, len(list_filter(old, lambda x: NOT list_contains(new, x))) AS spaces_lost,
  (SELECT coalesce(sum(n), 0)::BIGINT FROM docs WHERE list_contains(new, space) AND NOT list_contains(old, space)) AS documents_gained,
  (SELECT coalesce(sum(n), 0)::BIGINT FROM docs WHERE list_contains(old, space) AND NOT list_contains(new, space)) AS documents_lost,
  (SELECT count(*) FROM req WHERE list_has_all(new, req) AND NOT list_has_all(old, req)) AS derived_gained,
  (SELECT count(*) FROM req WHERE list_has_all(old, req) AND NOT list_has_all(new, req)) AS derived_lost,
  (SELECT count(*) FROM req WHERE list_has_all(new, req) AND NOT list_has_all(old, req) AND list_has_any(req, old)) AS by_combination FROM changed""")
def policy_preview(c: Case):
    """The effect of one grant on everyone it reaches."""
    return policy.preview(c.permitted, _change(c), c.w.facts0, c.facts)


@query(CHANGE + """SELECT level, count(*) AS n_unlocked, count_if(list_has_any(req, old)) AS n_by_combination FROM changed JOIN req ON list_has_all(new, req) AND NOT list_has_all(old, req) GROUP BY level""")
def combination_unlocks(c: Case):
    """Derived facts a grant unlocks, and those only together with what is held."""
    ch = policy.changes(c.permitted, _change(c))
    rows = ch.crossJoin(c.facts.select("level", "req"))
    hit = rows.filter(~P.admissible(F.col("old"), F.col("req")) & P.admissible(F.col("new"), F.col("req")))
    return hit.groupBy("level").agg(F.count(F.lit(1)).alias("n_unlocked"), F.count_if(F.arrays_overlap("req", "old")).alias("n_by_combination"))


@query(CHANGE + """, both_seen AS (SELECT p.side, p.principal, f.* FROM facts0 f JOIN (SELECT 'a' AS side, principal, unnest(new) AS space FROM changed UNION ALL SELECT 'b', principal, unnest(old) FROM changed) p USING (space)),
bf AS (SELECT *, row_number() OVER (PARTITION BY side, principal, entity ORDER BY k1, k2, k3, k4) AS nth, count(*) OVER (PARTITION BY side, principal, entity) AS ns FROM (
  SELECT *, row_number() OVER (PARTITION BY side, principal, entity, space ORDER BY k1, k2, k3, k4) AS rn FROM both_seen) WHERE rn = 1),
bp AS (SELECT * FROM bf WHERE ns >= 2 AND nth <= 6),
pr AS (SELECT x.side, x.principal, x.space AS a, y.space AS b FROM bp x JOIN bp y ON x.side = y.side AND x.principal = y.principal AND x.entity = y.entity AND x.space < y.space GROUP BY ALL HAVING count(*) >= 2),
fresh AS (SELECT principal, a, b FROM pr WHERE side = 'a' EXCEPT SELECT principal, a, b FROM pr WHERE side = 'b')
SELECT f.principal, f.a, f.b FROM fresh f JOIN req q ON q.claim = 'pair|' || f.a || '|' || f.b JOIN changed c ON c.principal = f.principal WHERE NOT list_has_all(c.new, q.req)""")
def newly_inferable(c: Case):
    """Pairings that a grant makes rebuildable while they stay refused."""
    after = _change(c)
    ch = policy.changes(c.permitted, after).select("principal")
    pair = lambda perm: A.rebuilt_pairs(c.w.facts0, settle(P.as_arrays(perm.join(ch, "principal", "left_semi")).withColumnRenamed("perm", "names")), "principal").select("principal", "a", "b")
    fresh = pair(after).join(pair(c.permitted), ["principal", "a", "b"], "left_anti")
    req = c.facts.filter("level = 2").select(F.split("claim", r"\|").alias("k"), "req").select(F.col("k")[1].alias("a"), F.col("k")[2].alias("b"), "req")
    rows = fresh.join(req, ["a", "b"]).join(P.as_arrays(after), "principal")
    return rows.filter(~P.admissible(F.col("perm"), F.col("req"))).select("principal", "a", "b")


@query("""SELECT count_if(held) AS n_held, count_if(held AND NOT list_has_all(perm, req)) AS n_violations FROM (SELECT DISTINCT s_req, req, perm, list_has_all(perm, s_req) AS held FROM (
  SELECT e.fact_id, list_sort(list_distinct(flatten(list(coalesce(q.req, [f.space]))))) AS s_req FROM rests_on e LEFT JOIN req q ON q.fact_id = e.support_id LEFT JOIN facts0 f ON f.fact_id = e.support_id GROUP BY e.fact_id)
  JOIN req USING (fact_id) CROSS JOIN (SELECT DISTINCT perm FROM perm))""")
def theorem1_check(c: Case):
    """Whoever may read all supports may read the fact."""
    return attack.theorem1(c.derived[1], c.facts, c.everything.select("fact_id", "req"), c.perms)


CLAIMS = """, claims AS (SELECT fact_id, entity, space FROM facts0 UNION ALL SELECT fact_id, entity, space FROM person_support),
every AS (SELECT fact_id, 0 AS level, space, [space] AS req FROM facts0 UNION ALL SELECT fact_id, level, space, req FROM req)
"""


@query(CLAIMS + "SELECT level, count(*) AS n_claims, count_if(list_contains(e.req, c.space)) AS n_local FROM every e JOIN claims c USING (fact_id) GROUP BY level")
def claim_locality(c: Case):
    """Claims asserted by facts that require their space."""
    return attack.claim_locality(c.claims, c.everything)


TEXTS = CLAIMS + """, opened AS (SELECT l_orderkey, min(p_brand) AS opening FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1 GROUP BY l_orderkey),
texts AS (SELECT f.fact_id, 0 AS level, f.space, coalesce(c_name, 'someone') || ' returned goods of ' || f.space || coalesce(' bought with ' || opening, '') AS text
    FROM facts0 f LEFT JOIN opened ON l_orderkey = k1 LEFT JOIN customer ON c_custkey = entity
  UNION ALL SELECT p.fact_id, 1, any_value(d.space), any_value(c_name) || ' spans ' || string_agg(p.space, ', ' ORDER BY nth) FROM person_support p JOIN derived d USING (fact_id) JOIN customer ON c_custkey = entity GROUP BY p.fact_id),
about AS (SELECT fact_id, entity FROM facts0 UNION ALL SELECT fact_id, entity FROM person_first),
named AS (SELECT fact_id, list(s.space ORDER BY s.space) AS named FROM texts t JOIN (SELECT DISTINCT space FROM facts0) s ON contains(lower(t.text), lower(s.space)) GROUP BY fact_id),
said AS (SELECT fact_id, entity, space FROM facts0 UNION SELECT t.fact_id, a.entity, unnest(n.named) FROM texts t JOIN named n USING (fact_id) JOIN about a USING (fact_id)
  LEFT JOIN customer ON c_custkey = a.entity WHERE c_custkey IS NULL OR contains(lower(t.text), lower(c_name)) OR contains(lower(t.text), c_custkey::VARCHAR)),
wide AS (SELECT e.*, coalesce(named, []) AS named, list_sort(list_distinct(list_concat(e.req, coalesce(named, [])))) AS widened FROM every e LEFT JOIN named USING (fact_id))
"""


@query(TEXTS + "SELECT fact_id, array_to_string(named, ',') AS named FROM named")
def spaces_named_in_texts(c: Case):
    """The spaces that each fact's text names."""
    return c.named.select("fact_id", csv("named").alias("named"))


@query(TEXTS + "SELECT fact_id, entity, space FROM said")
def claims_from_texts(c: Case):
    """The atomic claims read from texts."""
    return c.said


@query(TEXTS + """SELECT level, count(*) AS n_facts, count_if(len(list_filter(named, lambda x: NOT list_contains(req, x))) > 0) AS n_named_beyond FROM wide GROUP BY level""")
def named_beyond_evidence(c: Case):
    """Facts that name a space they do not rest on."""
    gap = claims.names_but_does_not_rest_on(F.col("req"), F.col("named"))
    return c.widened.groupBy("level").agg(F.count(F.lit(1)).alias("n_facts"), F.count_if(F.size(gap) > 0).alias("n_named_beyond"))


@query(TEXTS + """SELECT level, count(*) AS n_facts, count_if(list_contains(named, space)) AS n_own, count_if(len(list_filter(named, lambda x: x != space)) > 0) AS n_foreign FROM wide GROUP BY level""")
def prose_channel(c: Case):
    """Facts whose text names their own space, and others."""
    return claims.prose_channel(c.widened)


@query(TEXTS + """SELECT level, count_if(list_has_all(perm, req)) AS n_allowed, count_if(list_has_all(perm, req) AND NOT list_has_all(perm, widened)) AS n_over FROM wide CROSS JOIN perm
  GROUP BY level HAVING n_allowed > 0""")
def over_restriction(c: Case):
    """What the claim-aware gate withholds beyond need."""
    return claims.over_restricted(c.widened, c.perms)


@query(TEXTS + """SELECT level, count(*) AS n_claims, count_if(list_contains(e.req, c.space)) AS n_local FROM every e JOIN said c USING (fact_id) GROUP BY level""")
def claim_locality_of_texts(c: Case):
    """Claims read from texts that the asserting fact's requirement covers."""
    return attack.claim_locality(c.said, c.everything)


@query(TEXTS + """, sig AS (SELECT perm, count(*) AS n FROM perm GROUP BY perm),
disclosed AS (SELECT perm, fact_id, unnest(['ungated', 'document-acl', 'derivation-aware', 'claim-aware']) AS gate, unnest([true, list_contains(perm, e.space), list_has_all(perm, e.req), list_has_all(perm, e.widened)]) AS open FROM wide e CROSS JOIN sig),
carried AS (SELECT perm, gate, entity, c.space, min(fact_id) AS one, max(fact_id) AS two FROM disclosed JOIN said c USING (fact_id) WHERE open GROUP BY ALL),
wanted AS (SELECT s.perm, s.n, e.fact_id AS target, e.level, c.entity, c.space FROM every e CROSS JOIN sig s JOIN said c USING (fact_id) WHERE e.level > 0 AND NOT list_has_all(s.perm, e.req)),
g AS (SELECT unnest(['ungated', 'document-acl', 'derivation-aware', 'claim-aware']) AS gate),
cov AS (SELECT g.gate, w.perm, w.n, w.target, w.level, count(*) AS n_claims, count_if(k.one IS NOT NULL AND (k.one != w.target OR k.two != w.target)) AS n_hit FROM wanted w CROSS JOIN g
  LEFT JOIN carried k ON k.perm = w.perm AND k.gate = g.gate AND k.entity = w.entity AND k.space = w.space GROUP BY ALL)
SELECT gate, level, sum(n)::BIGINT AS denied, sum(CASE WHEN n_hit = n_claims THEN n ELSE 0 END)::BIGINT AS leaks, round(sum(n_hit / n_claims * n), 6) AS coverage_sum FROM cov GROUP BY gate, level""")
def aggregation_census(c: Case):
    """Refused facts whose claims disclosed facts carry, by gate; claims are read from texts."""
    return attack.census(c.said, c.widened, c.perms)


@query("""SELECT "case", count(*) AS size, string_agg(w, ',' ORDER BY w) AS witnesses FROM (SELECT p.fact_id AS "case", p.space, min(f.fact_id) AS w FROM person_support p JOIN facts0 f ON f.entity = p.entity AND f.space = p.space
  GROUP BY ALL) GROUP BY "case\"""")
def witness_cover(c: Case):
    """A smallest-first set of level-0 facts that together say what each person fact says."""
    want = derivation.person_support(c.w.facts0).select(F.col("fact_id").alias("case"), "entity", F.col("space").alias("claim"))
    return attack.witness_cover(want.join(c.w.facts0.select("entity", F.col("space").alias("claim"), "fact_id"), ["entity", "claim"]).select("case", "claim", "fact_id"))


@query(SEEN + """, d AS (SELECT principal, fact_id, level FROM pairs_fp WHERE NOT ok AND level = 1),
s AS (SELECT d.principal, d.fact_id, d.level, avg(CASE WHEN k.space IS NULL THEN 0 ELSE 1 END) AS share FROM d JOIN person_support c USING (fact_id)
  LEFT JOIN (SELECT DISTINCT principal, entity, space FROM seen) k ON k.principal = d.principal AND k.entity = c.entity AND k.space = c.space GROUP BY ALL)
SELECT level, count(*) AS n, round(avg(share), 6) AS mean_share, count_if(share = 1) AS n_exact, count_if(share = 0) AS n_zero FROM s GROUP BY level""")
def recovery_by_depth(c: Case):
    """How much of a refused person fact its asker already knows."""
    people = c.facts.filter("level = 1")
    refused = c.refusals(people).groupBy("level").agg(F.sum("n").alias("n"))
    return channels.recovery(refused, people.select("fact_id", "level", "req"), derivation.person_support(c.w.facts0).select("fact_id", "entity", "space"), c.seen_by_set, c.sets)


@query("""SELECT round(sum(j.n / t.t * log2(j.n * t.t / (x.n * y.n))), 6) AS mi_bits, round((SELECT sum(-n / t * log2(n / t)) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM pairs_fp GROUP BY ok)), 6) AS entropy_x_bits
  FROM (SELECT ok, filed_ok, count(*)::DOUBLE AS n FROM pairs_fp GROUP BY ALL) j JOIN (SELECT ok, count(*)::DOUBLE AS n FROM pairs_fp GROUP BY ALL) x ON x.ok = j.ok
  JOIN (SELECT filed_ok, count(*)::DOUBLE AS n FROM pairs_fp GROUP BY ALL) y ON y.filed_ok = j.filed_ok, (SELECT count(*)::DOUBLE AS t FROM pairs_fp) t""")
def refusal_mutual_information(c: Case):
    """Bits that the filed-under verdict gives away about the true one."""
    s, yes, no = P.audiences(c.facts, c.perms), F.lit(True), F.lit(False)
    kind = lambda ok, filed, n: F.struct(ok.alias("ok"), filed.alias("filed"), (n * F.col("n_facts")).alias("n"))
    both, ok, filed = F.col("ok_filed"), F.col("ok"), F.col("filed")
    each = F.array(kind(yes, yes, both), kind(yes, no, ok - both), kind(no, yes, filed - both), kind(no, no, F.col("everyone") - ok - filed + both))
    return channels.mutual_information(s.select(F.explode(each).alias("x")).select("x.*").filter("n > 0"), "ok", "filed", "n")


@query("""SELECT principal, space, documents, count(*) FILTER (WHERE hit) AS derived, count(*) FILTER (WHERE hit AND list_has_any(req, old)) AS by_combination FROM (
  SELECT p.principal, d.space, p.perm AS old, q.req, CASE WHEN list_contains(p.perm, d.space) THEN 0 ELSE d.n END AS documents, NOT list_has_all(p.perm, q.req) AND list_has_all(list_append(p.perm, d.space), q.req) AS hit
  FROM perm p CROSS JOIN (SELECT space, count(*) AS n FROM facts0 GROUP BY space) d CROSS JOIN req q) GROUP BY principal, space, documents""")
def grant_simulation(c: Case):
    """What every single grant to every principal would unlock."""
    return policy.simulate_grants(c.perms, c.perms.select("principal").crossJoin(c.w.facts0.select("space").distinct()), c.w.facts0, c.facts)


@query("SELECT level, count(*) AS n_facts, round(avg(len(req)), 6) AS mean_required, max(len(req)) AS max_required FROM req GROUP BY level")
def fact_stats(c: Case):
    """Facts by level and what they require."""
    return c.facts.groupBy("level").agg(F.count(F.lit(1)).alias("n_facts"), F.round(F.avg(F.size("req")), 6).alias("mean_required"), F.max(F.size("req")).cast("long").alias("max_required"))


@query("""SELECT (SELECT count(*) FROM (SELECT DISTINCT perm FROM perm)) AS n_sets, (SELECT count(DISTINCT space) FROM permitted) AS n_spaces""")
def permission_sets(c: Case):
    """Distinct permission sets."""
    n = c.permitted.agg(F.count_distinct("space").alias("n_spaces"))
    return c.perms.select("perm").distinct().agg(F.count(F.lit(1)).alias("n_sets")).crossJoin(n)


@query("""SELECT edge, count(*) AS n FROM (SELECT 'MEMBER_OF' AS edge FROM member_of UNION ALL SELECT 'MANAGES' FROM manages UNION ALL SELECT 'OBSERVES' FROM facts0 UNION ALL SELECT 'IN_SPACE' FROM facts0 UNION ALL
  SELECT 'RESTS_ON' FROM rests_on UNION ALL SELECT 'ABOUT' FROM facts0 UNION ALL SELECT 'ABOUT' FROM person_first) GROUP BY edge""")
def graph_edges(c: Case):
    """The edges a graph sink would write, by kind."""
    kind = lambda df, k: df.select(F.lit(k).alias("edge"))
    person = c.derived[0].filter("level = 1")
    out = kind(c.w.member_of, "MEMBER_OF").union(kind(c.w.manages, "MANAGES")).union(kind(c.w.facts0, "OBSERVES")).union(kind(c.w.facts0, "IN_SPACE"))
    return out.union(kind(c.derived[1], "RESTS_ON")).union(kind(c.w.facts0, "ABOUT")).union(kind(person, "ABOUT")).groupBy("edge").agg(F.count(F.lit(1)).alias("n"))


NODE = """SELECT f.fact_id AS id, '{{"id":"' || f.fact_id || '","supports":[' || string_agg(j, ',' ORDER BY support_id) || ']}}' AS j FROM few f JOIN {} ON id = support_id GROUP BY f.fact_id"""


@query(f""", few AS (SELECT fact_id, support_id FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY support_id) AS rn FROM (SELECT DISTINCT fact_id, support_id FROM rests_on)) WHERE rn <= 6),
n0 AS (SELECT fact_id AS id, '{{"id":"' || fact_id || '"}}' AS j FROM facts0), n1 AS ({NODE.format('n0')}), n2 AS ({NODE.format('n1')})
SELECT fact_id, string_agg(j, ' ' ORDER BY support_id) AS chain FROM few JOIN (SELECT * FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2) ON id = support_id GROUP BY fact_id""")
def derivation_chains(c: Case):
    """The supports of every derived fact, nested."""
    return provenance.chains(c.derived[1]).select("fact_id", F.array_join("chain", " ").alias("chain"))


@query("""SELECT w.fact_id, count(DISTINCT f.k1) AS n_citations, min(f.k1) AS first FROM walk w JOIN facts0 f ON f.fact_id = w.support_id GROUP BY w.fact_id""")
def citations_under(c: Case):
    """The orders that lie under each derived fact."""
    cited = provenance.citations_under(c.derived[1], c.w.facts0.select(F.col("fact_id").alias("source_id"), F.col("ord.l_orderkey").alias("citation")))
    return cited.groupBy("fact_id").agg(F.count(F.lit(1)).alias("n_citations"), F.min("citation").alias("first"))
