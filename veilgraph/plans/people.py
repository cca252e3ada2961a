"""Queries over what texts say of people: extraction, resolution, contests, evaluation, paths, policy reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adversary, contest, evaluation, graph, mentions, policy, sampling
from ..operators import permissions as P
from ..operators.loops import settle
from ..sources.driver_tables import PRELUDE, read, world
from .disclosure import CHANGE, TEXTS, Case, _change, counted

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Statuses in place of the driver's order states.
STATES = {"F": "shipped", "O": "delayed", "P": "on track"}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = counted(f"WITH RECURSIVE {PRELUDE.strip()}\n{sql.strip()}")
        return fn

    return add


def _status_texts(spark, d):
    """source_id, space, text: each level-0 fact says how its customer's launch stands."""
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    state = F.coalesce(*[F.when(F.col("o_orderstatus") == k, F.lit(v)) for k, v in STATES.items()], F.lit("paused"))
    f = world(spark, d).facts0.join(orders, F.col("ord.l_orderkey") == F.col("key"))
    text = F.concat(F.lit("It was noted that C"), F.col("entity").cast("string"), F.lit("Launch is "), state, F.lit(". Nothing else was said."))
    return f.select(F.col("fact_id").alias("source_id"), "space", text.alias("text"), "ord")


CASES = "CASE o_orderstatus " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items()) + " ELSE 'paused' END"
STATUS = f", status AS (SELECT f.fact_id AS source_id, f.space, 'c' || f.entity || 'launch' AS subject, 'status' AS predicate, {CASES} AS value FROM facts0 f JOIN orders ON o_orderkey = f.k1)"


@query(STATUS + " SELECT source_id, space, subject, predicate, value FROM status")
def claims_extracted(spark, d):
    """Status claims read from sentences."""
    return contest.extract_claims(_status_texts(spark, d).drop("ord")).drop("ord").select("source_id", "space", "subject", "predicate", "value")


def _role_texts(spark, d):
    c = read(spark, d, "customer")
    text = F.concat(F.lit("We met. "), "c_name", F.lit(" is the "), F.lower("c_mktsegment"), F.lit(" manager of it."))
    people = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    sources = c.select(F.col("c_custkey").cast("string").alias("source_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("space"), text.alias("text"))
    return sources, people


@query(" SELECT c_custkey::VARCHAR AS subject, 'role' AS predicate, lower(c_mktsegment) || ' manager' AS value, 'n' || c_nationkey AS space FROM customer")
def roles_extracted(spark, d):
    """Roles that texts give to people resolved in them."""
    sources, people = _role_texts(spark, d)
    return contest.extract_roles(sources, sources.select("source_id", F.col("source_id").alias("employee_id")), people).select("subject", "predicate", "value", "space")


@query(STATUS + """ SELECT predicate, count(*) AS n, count(DISTINCT subject) AS n_subjects FROM (SELECT predicate, subject FROM status UNION ALL SELECT 'role', c_custkey::VARCHAR FROM customer) GROUP BY predicate""")
def claims_by_predicate(spark, d):
    """Claims whose values can oppose each other, by predicate."""
    sources, people = _role_texts(spark, d)
    roles = contest.extract_roles(sources, sources.select("source_id", F.col("source_id").alias("employee_id")), people)
    return contest.claims_by_predicate(contest.opposing(contest.extract_claims(_status_texts(spark, d)).unionByName(roles)))


@query(STATUS + """, v AS (SELECT predicate, subject, value, list_distinct(list(space)) AS spaces FROM status GROUP BY ALL), s AS (SELECT * FROM v QUALIFY count(*) OVER (PARTITION BY predicate, subject) >= 2),
t AS (SELECT predicate, subject, count(*) AS n FROM s GROUP BY ALL), seen AS (SELECT predicate, subject, principal, count(DISTINCT value) AS k FROM (SELECT predicate, subject, value, unnest(spaces) AS space FROM s) JOIN permitted USING (space) GROUP BY ALL)
SELECT predicate, subject, principal, (n - k) || CASE WHEN n - k = 1 THEN ' source you do not have access to disagrees with this.' ELSE ' sources you do not have access to disagree with this.' END AS notice
FROM seen JOIN t USING (predicate, subject) WHERE n > k""")
def contest_notices(spark, d):
    """What readers are told who see one side of a contest."""
    texts = _status_texts(spark, d)
    claims = contest.extract_claims(texts.drop("ord")).drop("ord").join(texts.select("source_id", "ord"), "source_id")
    return contest.notice(claims, Case(world(spark, d)).permitted)


LETTERS = "abcdefghij"


def _name(key):
    """'F..' by the last two digits (shared by namesakes), 'L..' by the whole number (one person's)."""
    word = lambda c: F.translate(c.cast("string"), "0123456789", LETTERS)
    return F.concat(F.lit("F"), word(key % 100)), F.concat(F.lit("L"), word(key))


def _eid(key):
    return F.concat(F.lit("eid_"), F.lower(F.lpad(F.hex(key), 8, "0")))


def _people(spark, d):
    """employees, sources: a document per level-0 fact, filed by a person, that names its customer in full and the author by first name."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    first, last = _name(F.col("k"))
    staff = c.select(_eid(F.col("k")).alias("id"), F.concat(first, F.lit(" "), last).alias("name"))
    f = world(spark, d).facts0.select("fact_id", "space", F.col("entity").cast("long").alias("e"), F.col("ord.l_suppkey").cast("long").alias("a"))
    (f1, l1), (f2, _) = _name(F.col("e")), _name(F.col("a"))
    text = F.concat(F.lit("then "), f1, F.lit(" "), l1, F.lit(" wrote, and "), f2, F.lit(" filed it"))
    author = _eid(F.col("a"))
    return staff, f.select(
        F.col("fact_id").alias("source_id"), "space", F.lit("document").alias("kind"), author.alias("author"), F.array(author).alias("participants"), text.alias("text"), "e", "a"
    )


def _resolved(spark, d):
    staff, sources = _people(spark, d)
    found = settle(mentions.extract(sources, staff))
    roster = sources.limit(0).select("space", F.col("author").alias("employee_id"))
    return staff, sources, found, mentions.resolve(found, sources, staff, roster)


WORD = "translate({}::VARCHAR, '0123456789', 'abcdefghij')"
NAMES = f"""SELECT c_custkey AS k, 'F' || {WORD.format('(c_custkey % 100)')} AS f, 'L' || {WORD.format('c_custkey')} AS l, 'eid_' || lower(printf('%08x', c_custkey)) AS id FROM customer"""
PEOPLE = f""", staff AS ({NAMES}), pool AS (SELECT f, count(*) AS n FROM staff GROUP BY f),
src AS (SELECT fact_id AS source_id, entity AS e, k4 AS a FROM facts0),
said AS (SELECT source_id, 'identifier' AS register, a AS who, 'identifier' AS method, 1 AS before_, 1 AS after_ FROM src
  UNION ALL SELECT source_id, 'full-name', e, 'unique-name', 1, 1 FROM src
  UNION ALL SELECT source_id, 'first-name', a, CASE WHEN n = 1 THEN 'unique-name' ELSE 'co-presence' END, n, 1 FROM src JOIN staff ON k = a JOIN pool USING (f))
"""


@query(PEOPLE + "SELECT register, count(*) AS n, count(DISTINCT source_id) AS n_sources FROM said GROUP BY register")
def mention_registers(spark, d):
    """Mentions by register."""
    staff, sources = _people(spark, d)
    return mentions.mention_stats(mentions.extract(sources, staff))


@query(PEOPLE + "SELECT method, count(*) AS n, count(*) AS n_resolved, round(avg(before_), 2) AS mean_before, round(avg(after_), 2) AS mean_after FROM said GROUP BY method")
def resolution_methods(spark, d):
    """How mentions are resolved, and how far their pools narrow."""
    staff, _, found, resolved = _resolved(spark, d)
    return mentions.resolution_stats(resolved, mentions.pool_sizes(found, staff))


@query(PEOPLE + """SELECT s.source_id, m.register, t.id AS resolved FROM src s JOIN said m USING (source_id) JOIN staff t ON t.k = m.who""")
def resolution_cascade(spark, d):
    """Who every mention means."""
    _, _, found, resolved = _resolved(spark, d)
    return found.select("source_id", "nth", "register").join(resolved, ["source_id", "nth"]).select("source_id", "register", "resolved")


@query(PEOPLE + """, n AS (SELECT count(*) AS evaluated, count(*) FILTER (WHERE who = a) AS correct FROM said JOIN src USING (source_id) WHERE register != 'identifier')
SELECT evaluated, correct, evaluated - correct AS wrong, 0::BIGINT AS abstained, round(correct / evaluated, 4) AS "precision", round(correct / evaluated, 4) AS recall FROM n""")
def resolution_accuracy(spark, d):
    """Resolutions against the people that transcripts say were there."""
    _, sources, found, resolved = _resolved(spark, d)
    return mentions.accuracy_summary(mentions.resolution_accuracy(found, resolved, sources.withColumn("kind", F.lit("meeting_transcript"))))


@query(CHANGE + """SELECT count(*) AS principals, coalesce(sum((SELECT sum(n) FROM docs WHERE list_contains(new, space) AND NOT list_contains(old, space))), 0)::BIGINT AS documents_gained, 0::BIGINT AS documents_lost,
  coalesce(sum(dg), 0)::BIGINT AS derived_gained, 0::BIGINT AS derived_lost, coalesce(sum(bc), 0)::BIGINT AS by_combination,
  round(coalesce(sum(dg) / nullif(sum((SELECT sum(n) FROM docs WHERE list_contains(new, space) AND NOT list_contains(old, space))), 0), 0), 6) AS hidden_ratio
FROM (SELECT *, (SELECT count(*) FROM req WHERE list_has_all(new, req) AND NOT list_has_all(old, req)) AS dg, (SELECT count(*) FROM req WHERE list_has_all(new, req) AND NOT list_has_all(old, req) AND list_has_any(req, old)) AS bc FROM changed)""".replace("SELECT count(*) AS principals", ", docs AS (SELECT space, count(*) AS n FROM facts0 GROUP BY space) SELECT count(*) AS principals", 1))
def impact_totals(spark, d):
    """What one grant does in all."""
    c = Case(world(spark, d))
    return policy.impact_totals(policy.preview(c.permitted, _change(c), c.w.facts0, c.facts))


REVOKE = """, gone AS (SELECT min(space) AS space FROM member_of), own3 AS (SELECT principal, space FROM member_of WHERE space != (SELECT space FROM gone)),
after3 AS (SELECT principal, space FROM own3 UNION SELECT c.manager, m.space FROM org_closure c JOIN own3 m ON m.principal = c.report), a3 AS (SELECT principal, list(space ORDER BY space) AS perm FROM after3 GROUP BY principal)
"""


@query(REVOKE + """SELECT p.principal, len(list_filter(p.perm, lambda x: NOT list_contains(coalesce(a.perm, []), x))) AS spaces_lost, (SELECT count(*) FROM req WHERE list_has_all(p.perm, req) AND NOT list_has_all(coalesce(a.perm, []), req)) AS derived_lost
FROM perm p LEFT JOIN a3 a USING (principal) WHERE coalesce(a.perm, []) != p.perm""")
def policy_revoke(spark, d):
    """The effect of revoking a space from everyone."""
    c = Case(world(spark, d))
    own = policy.from_model(c.w.member_of)
    gone = own.join(own.agg(F.min("space").alias("space")), "space", "left_semi")
    return policy.preview(c.permitted, policy.compile_policy(policy.revoke(own, gone), c.w.manages), c.w.facts0, c.facts).select("principal", "spaces_lost", "derived_lost")


SIMULATED = """, sim AS (SELECT principal, space, documents, count(*) FILTER (WHERE hit) AS derived, count(*) FILTER (WHERE hit AND list_has_any(req, old)) AS by_combination FROM (
  SELECT p.principal, d.space, p.perm AS old, q.req, CASE WHEN list_contains(p.perm, d.space) THEN 0 ELSE d.n END AS documents, NOT list_has_all(p.perm, q.req) AND list_has_all(list_append(p.perm, d.space), q.req) AS hit
  FROM perm p CROSS JOIN (SELECT space, count(*) AS n FROM facts0 GROUP BY space) d CROSS JOIN req q) GROUP BY principal, space, documents)
"""


def _simulated(c: Case):
    return policy.simulate_grants(c.perms, c.perms.select("principal").crossJoin(c.w.facts0.select("space").distinct()), c.w.facts0, c.facts)


@query(SIMULATED + """SELECT count(*) AS simulated, sum(documents)::BIGINT AS documents, sum(derived)::BIGINT AS derived, sum(by_combination)::BIGINT AS by_combination, count_if(derived > 0) AS with_derived, count_if(by_combination > 0) AS with_combination,
  round(median(CASE WHEN documents > 0 THEN derived / documents END), 4) AS median_per_document, round(sum(derived) / greatest(count_if(derived > 0), 1), 2) AS mean_per_unlocking FROM sim""")
def grant_summary(spark, d):
    """Every single grant in a row: totals, and the yield of those that unlock anything."""
    return policy.grant_summary(_simulated(Case(world(spark, d))))


@query(SIMULATED + """SELECT space, principal, documents, derived, by_combination FROM sim QUALIFY row_number() OVER (PARTITION BY space ORDER BY derived DESC, principal) = 1 ORDER BY derived DESC, space LIMIT 5""")
def widest_grants(spark, d):
    """The five spaces whose grant unlocks most."""
    return policy.widest(_simulated(Case(world(spark, d))))


@query("SELECT manager AS source, report AS target, true AS reached FROM org_closure UNION ALL SELECT report, manager, false FROM org_closure")
def org_reachability(spark, d):
    """Whether a manager reaches a report along the reporting lines, and not back."""
    w = world(spark, d)
    below = P.org_closure(w.manages)
    pairs = below.toDF("source", "target").unionByName(below.select(F.col("report").alias("source"), F.col("manager").alias("target")))
    return graph.reachable(w.manages.toDF("a", "b"), pairs)


@query(""", up AS (SELECT report AS source, report AS node, 0 AS depth FROM manages UNION ALL SELECT source, manager, depth + 1 FROM up JOIN manages ON report = node WHERE depth < 12)
SELECT source, node, depth FROM up""")
def org_paths(spark, d):
    """Everyone above each person, with the number of steps."""
    m = world(spark, d).manages
    return graph.paths_from(m.select(F.col("report").alias("a"), F.col("manager").alias("b")), m.select(F.col("report").alias("source"))).select("source", "node", "depth")


@query(""", hop AS (SELECT fact_id, support_id AS node, 1 AS depth FROM rests_on UNION ALL SELECT h.fact_id, r.support_id, depth + 1 FROM hop h JOIN rests_on r ON r.fact_id = h.node),
near AS (SELECT h.fact_id, f.space, min(depth) AS depth FROM hop h JOIN facts0 f ON f.fact_id = h.node GROUP BY ALL)
SELECT r.fact_id, r.space, n.depth::INTEGER AS depth FROM required r JOIN near n USING (fact_id, space)""")
def nearest_sources(spark, d):
    """How far below a fact the nearest source of each required space lies."""
    c = Case(world(spark, d))
    edges, home = c.derived[1], c.w.facts0.select("fact_id", "space", F.col("fact_id").alias("locator"))
    found = graph.source_of(edges.select("fact_id", "support_id"), home, c.required)
    below = graph.paths_from(edges.select(F.col("fact_id").alias("a"), F.col("support_id").alias("b")), c.required.select(F.col("fact_id").alias("source")).distinct())
    return found.join(below.select(F.col("source").alias("fact_id"), F.col("node").alias("locator"), "depth"), ["fact_id", "locator"]).select("fact_id", "space", "depth")


@query("SELECT principal FROM perm ORDER BY md5('7:' || principal), principal LIMIT 20")
def seeded_sample(spark, d):
    """Twenty principals in the order of a seeded digest."""
    return sampling.seeded(Case(world(spark, d)).perms, "principal", 20, 7).select("principal")


@query(""", r AS (SELECT principal, row_number() OVER (ORDER BY len(perm) DESC, principal) - 1 AS place, count(*) OVER () AS total FROM perm)
SELECT principal FROM r WHERE total <= 9 OR place IN (SELECT i * (total - 1) // 8 FROM range(9) t(i))""")
def spread_sample(spark, d):
    """Nine principals spread over the ranking by breadth."""
    return sampling.spread(Case(world(spark, d)).perms, [F.desc(F.size("perm")), "principal"], 9).select("principal")


@query()
def red_team(spark, d):
    """Two hundred sequences of questions about refused facts."""
    c = Case(world(spark, d))
    return evaluation.red_team(c.said, c.everything, c.sets.select("sig", "perm"))


@query(TEXTS + """, ans AS (SELECT principal, e.entity, list_distinct(list(e.space)) AS answer FROM facts0 e JOIN permitted p USING (space) GROUP BY ALL), gold AS (SELECT entity, list_distinct(list(space)) AS gold FROM facts0 GROUP BY entity),
s AS (SELECT p.principal, len(gold) AS ng, coalesce(len(answer), 0) AS na, coalesce(len(list_intersect(gold, answer)), 0)::DOUBLE AS hit FROM gold g CROSS JOIN (SELECT DISTINCT principal FROM ans) p LEFT JOIN ans a ON a.entity = g.entity AND a.principal = p.principal)
SELECT principal, count(*) AS n, round(avg(CASE WHEN na = 0 THEN 0 ELSE hit / na END), 4) AS "precision", round(avg(hit / ng), 4) AS recall, round(avg(CASE WHEN hit = 0 THEN 0 ELSE 2 * hit / (ng + na) END), 4) AS f1 FROM s GROUP BY principal""")
def utility_by_principal(spark, d):
    """Macro precision, recall and F1 of what each principal can answer about where people are."""
    c = Case(world(spark, d))
    gold = c.w.facts0.groupBy(F.col("entity").alias("query_id")).agg(F.collect_set("space").alias("gold"))
    answered = adversary.visible(c.w.facts0, c.permitted).groupBy("principal", F.col("entity").alias("query_id")).agg(F.collect_set("space").alias("answer"))
    return evaluation.utility(gold, answered, "principal")
