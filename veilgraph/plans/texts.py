"""Queries over texts and logs: sentences, retrieval, contested claims, planning, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit, contest, planner, provenance, retrieval
from ..operators import permissions as P
from ..sources.driver_tables import PRELUDE, read, world
from .disclosure import Case, counted

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = counted(sql.strip())
        return fn

    return add


SENT = r"""sents AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(10), 'g'), '\n+', chr(10), 'g'), chr(10)), lambda s: trim(s)),
  lambda s: length(s) BETWEEN 40 AND 400) AS s FROM documents)"""
TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_ \\t\\n\\r\\f-]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains([{}], w))".format(
    ", ".join(f"'{w}'" for w in X.STOP)
)


@query(f"WITH {SENT} SELECT doc_id, len(s) AS n_sentences, list_sum(list_transform(s, lambda x: length(x)))::BIGINT AS n_chars FROM sents WHERE len(s) > 0")
def sentence_split(spark, d):
    """Sentences of 40 to 400 characters."""
    docs = read(spark, d, "documents").select("doc_id", X.sentences(F.col("text")).alias("s"))
    n = F.aggregate("s", F.lit(0).cast("long"), lambda t, x: t + F.length(x))
    return docs.filter(F.size("s") > 0).select("doc_id", F.size("s").cast("long").alias("n_sentences"), n.alias("n_chars"))


@query(rf"""WITH {SENT}, e AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS idx FROM sents),
sc AS (SELECT *, CASE WHEN regexp_matches(lower(sentence), '{X.DECISION}') THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN regexp_matches(sentence, '[0-9]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  + least(length(sentence) / 120.0::DOUBLE, 2.0::DOUBLE) AS score FROM e)
SELECT doc_id, rank, md5(sentence) AS digest, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS rank FROM sc) WHERE rank <= 2""")
def informativeness_topk(spark, d):
    """The two most informative sentences of every document."""
    docs = read(spark, d, "documents").select("doc_id", F.posexplode(X.best_sentences(F.col("text"), F.lit(0.0))).alias("i", "b"))
    return docs.select("doc_id", (F.col("i") + 1).cast("long").alias("rank"), F.md5("b.sentence").alias("digest"), F.round(-F.col("b.minus"), 6).alias("score"))


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY term HAVING count(*) >= 2")
def tokenise_df(spark, d):
    """Document frequencies of tokens."""
    docs = read(spark, d, "documents").select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    return docs.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter("df >= 2")


BM25 = f"""d AS (SELECT doc_id, source, {TOKENS} AS t FROM documents), st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS ml FROM d),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT tf.doc_id, term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.4::DOUBLE) / (tf + 1.4::DOUBLE * (0.28::DOUBLE + 0.72::DOUBLE * length / ml)) AS w FROM tf JOIN df USING (term), st),
s AS (SELECT query_id, doc_id, round(sum(w * times), 6) AS score FROM q JOIN w USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


def _bm25(spark, d, k):
    docs = read(spark, d, "documents")
    queries = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return docs, retrieval.bm25_best(docs, queries, k)


@query(f"WITH {BM25} SELECT query_id, doc_id, rank, round(score, 3) AS score FROM r WHERE rank <= 10")
def bm25_topk(spark, d):
    """The ten best documents of every query."""
    return _bm25(spark, d, 10)[1].select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 3).alias("score"))


@query(f"""WITH {BM25}, c AS (SELECT r.*, source IN ('src0', 'src3', 'src5', 'src7', 'src11', 'src13') AS admitted FROM r JOIN d USING (doc_id) WHERE rank <= 24),
b AS (SELECT *, coalesce(sum(admitted::INT) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT query_id, doc_id, rank, admitted FROM b WHERE before < 8""")
def bm25_gated_topk(spark, d):
    """Up to eight admitted of 24 candidates per query."""
    docs, top = _bm25(spark, d, 24)
    rows = top.join(docs.select("doc_id", "source"), "doc_id")
    allowed = F.col("source").isin("src0", "src3", "src5", "src7", "src11", "src13")
    return retrieval.gated(rows, allowed, 8).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), "admitted")


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 50 = 0 AND q.vec_id != v.vec_id)
SELECT query_id, doc_id, rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""")
def dense_topk(spark, d):
    """The ten nearest vectors of every fiftieth vector."""
    v = read(spark, d, "embeddings")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    scores = retrieval.dense(v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), q).filter("query_id != doc_id")
    return retrieval.ranked(scores, 10).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@query(f"""WITH RECURSIVE {PRELUDE.strip()}, g AS (SELECT entity, list_distinct(list(space)) AS gold FROM facts0 GROUP BY entity), p AS (SELECT entity, list_distinct(list(space)) AS found FROM facts0 WHERE k2 <= 3 GROUP BY entity),
s AS (SELECT g.entity, len(gold) AS ng, coalesce(len(found), 0) AS nf, coalesce(len(list_intersect(gold, found)), 0)::DOUBLE AS hit FROM g LEFT JOIN p USING (entity))
SELECT count(*) AS n, round(avg(CASE WHEN nf = 0 THEN 0 ELSE hit / nf END), 6) AS "precision", round(avg(hit / ng), 6) AS recall, round(avg(CASE WHEN hit = 0 THEN 0 ELSE 2 * hit / (ng + nf) END), 6) AS f1 FROM s""")
def set_f1(spark, d):
    """Set precision, recall and F1 of the spaces seen in first lines against all."""
    f = world(spark, d).facts0
    gold = f.groupBy("entity").agg(F.collect_set("space").alias("gold"))
    found = f.filter("ord.l_linenumber <= 3").groupBy("entity").agg(F.collect_set("space").alias("found"))
    rows = gold.join(found, "entity", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    s = X.set_scores(F.col("gold"), F.col("found"))
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(k) for k, c in s.items()])


CLAIMS = f"""WITH RECURSIVE {PRELUDE.strip()}, claims AS (SELECT 'status' AS predicate, f.entity AS subject, lower(o_orderstatus) AS value, f.space, k1, k2, k3, k4 FROM facts0 f JOIN orders ON o_orderkey = f.k1),
v AS (SELECT predicate, subject, value, list_sort(list_distinct(list(space))) AS spaces, min((k1, k2, k3, k4)) AS first FROM claims GROUP BY ALL),
s AS (SELECT * FROM v QUALIFY count(*) OVER (PARTITION BY predicate, subject) >= 2)"""


def _claims(spark, d):
    status = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.lower("o_orderstatus").alias("value"))
    f = world(spark, d).facts0
    return f.join(status, F.col("ord.l_orderkey") == F.col("key")).select(F.lit("status").alias("predicate"), F.col("entity").alias("subject"), "value", "space", "ord")


@query(CLAIMS + """, h AS (SELECT *, first_value(spaces) OVER (PARTITION BY predicate, subject ORDER BY first) AS head FROM s)
SELECT predicate, subject, count(*) AS n_sides, bool_or(len(list_filter(spaces, lambda x: NOT list_contains(head, x))) > 0) AS cross_space FROM h GROUP BY ALL""")
def contradictions(spark, d):
    """Subjects of which sources say different things."""
    return contest.contradictions(_claims(spark, d))


@query(CLAIMS + """, seen AS (SELECT DISTINCT s.predicate, s.subject, p.principal, s.value FROM (SELECT predicate, subject, value, unnest(spaces) AS space FROM s) s JOIN permitted p USING (space)),
per AS (SELECT predicate, subject, principal, count(*) AS n, min(value) AS value FROM seen GROUP BY ALL), single AS (SELECT predicate, subject, value, count(*) AS nv FROM per WHERE n = 1 GROUP BY ALL),
a AS (SELECT predicate, subject, sum(nv)::BIGINT AS settled, sum(nv * nv)::BIGINT AS squares FROM single GROUP BY ALL), b AS (SELECT predicate, subject, count(*) AS n_seers FROM per GROUP BY ALL)
SELECT x.predicate, x.subject, coalesce(settled, 0) AS settled_for, (SELECT count(DISTINCT principal) FROM permitted) - coalesce(n_seers, 0) AS sees_nothing, (coalesce(settled, 0) * coalesce(settled, 0) - coalesce(squares, 0)) // 2 AS opposed
FROM (SELECT DISTINCT predicate, subject FROM s) x LEFT JOIN a USING (predicate, subject) LEFT JOIN b USING (predicate, subject)""")
def disclosure_dependent_truth(spark, d):
    """What readers of contested subjects hold for settled."""
    return contest.disclosure_dependent(_claims(spark, d), Case(world(spark, d)).permitted)


@query("""SELECT citation, count(DISTINCT md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')))) AS n_texts FROM (SELECT substr(text, 1, 40) AS citation, text FROM documents) GROUP BY citation HAVING n_texts > 1""")
def description_divergence(spark, d):
    """Beginnings under which different texts stand."""
    return contest.divergence(read(spark, d, "documents").select(F.substring("text", 1, 40).alias("citation"), "text"))


@query("SELECT lang, source, count(*) AS n, count(text) AS n_text, max(length(text)) AS longest FROM documents GROUP BY ALL")
def corpus_stats(spark, d):
    """Artifacts by kind and space."""
    return read(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("n_text"), F.max(F.length("text")).cast("long").alias("longest"))


@query("SELECT item_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END AS clipped FROM benchmark")
def clip_text(spark, d):
    """Texts clipped with an ellipsis."""
    return read(spark, d, "benchmark").select("item_id", X.clip(F.col("text"), 60).alias("clipped"))


def _entries(spark, d):
    e = read(spark, d, "events")
    user = F.col("user_id").cast("string")
    space = F.concat(F.lit("s:"), F.col("event_type"))
    return e.select(
        user.alias("chain"), F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.col("event_type").alias("decision"),
        F.concat(F.lit("p:"), user).alias("principal"), F.array(F.concat(F.lit("f:"), F.col("event_id").cast("string"))).alias("facts"),
        F.array(F.lit("s:home"), space).alias("required"), F.when(F.col("event_id") % 3 == 0, F.array(space)).alias("missing"), F.lit(None).cast("array<string>").alias("would_complete"),
        F.create_map(F.lit("ms"), F.col("event_id").cast("string"), F.lit("endpoint"), F.lit('"ask"')).alias("detail"),
    )


def _log(spark, d):
    return audit.record(_entries(spark, d))


@query("SELECT user_id::VARCHAR AS chain, count(*) AS entries, NULL::INTEGER AS broken_at, NULL::VARCHAR AS reason FROM events GROUP BY user_id")
def audit_chain_verify(spark, d):
    """Chains of events, hashed and verified."""
    return audit.verify(_log(spark, d))


@query("""SELECT user_id::VARCHAR AS chain, count(*) AS entries, coalesce(max(event_id) FILTER (WHERE event_id % 2 = 0), -1) AS last_of_first,
  CASE WHEN count(*) FILTER (WHERE event_id % 2 = 0) > 0 THEN max(event_id) FILTER (WHERE event_id % 2 = 0) + count(*) FILTER (WHERE event_id % 2 = 1) ELSE max(event_id) END AS last_seq, true AS sound
FROM events GROUP BY user_id""")
def audit_resume(spark, d):
    """A log of even events, gone on with by odd ones, still one sound chain."""
    from ..operators.loops import settle

    e = _entries(spark, d)
    first = settle(audit.record(e.filter("seq % 2 = 0")))
    whole = settle(first.unionByName(audit.record(e.filter("seq % 2 = 1"), first)))
    told = audit.verify(whole).join(audit.heads(first).select("chain", F.col("seq").alias("last_of_first")), "chain", "left")
    return told.join(audit.heads(whole).select("chain", F.col("seq").alias("last_seq")), "chain").select("chain", "entries", F.coalesce("last_of_first", F.lit(-1)).alias("last_of_first"), "last_seq", F.col("broken_at").isNull().alias("sound"))


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events), gone AS (SELECT * FROM e WHERE event_id % 89 = 0),
left_ AS (SELECT e.*, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS now, place - coalesce(lag(place) OVER (PARTITION BY user_id ORDER BY event_id), -1) > 1 AS gap FROM e WHERE event_id % 89 != 0),
bad AS (SELECT user_id, now, CASE WHEN gap THEN 'does not follow' WHEN event_id % 97 = 0 THEN 'modified' END AS reason FROM left_ WHERE gap OR event_id % 97 = 0)
SELECT l.user_id::VARCHAR AS chain, count(*) AS entries, coalesce((SELECT min(now)::INTEGER FROM bad b WHERE b.user_id = l.user_id), -1) AS broken_at, coalesce((SELECT arg_min(reason, now) FROM bad b WHERE b.user_id = l.user_id), '') AS reason
FROM left_ l GROUP BY l.user_id""")
def audit_tampering(spark, d):
    """Where a log with entries changed and removed first breaks; -1 for chains that stay sound."""
    log = _log(spark, d).filter("seq % 89 != 0")
    told = audit.verify(log.withColumn("principal", F.when(F.col("seq") % 97 == 0, F.lit("p:other")).otherwise(F.col("principal"))))
    return told.select("chain", "entries", F.coalesce("broken_at", F.lit(-1)).alias("broken_at"), F.coalesce("reason", F.lit("")).alias("reason"))


@query("SELECT event_type AS decision, count(*) AS n FROM events GROUP BY event_type")
def audit_summary(spark, d):
    """Entries by decision."""
    return audit.summarise(_log(spark, d))


@query("SELECT 'p:' || user_id AS principal, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, principal LIMIT 10")
def audit_busiest(spark, d):
    """The principals with the most entries."""
    return audit.busiest(_log(spark, d))


@query("""SELECT user_id, count(*) AS n, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99, round(max(value), 6) AS worst FROM events GROUP BY user_id""")
def latency_stats(spark, d):
    """Nearest-rank percentiles per user."""
    q = lambda p: F.round(F.expr(f"percentile_disc({p}) within group (order by value)"), 6)
    return read(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.round(F.max("value"), 6).alias("worst"))


def _planning(spark, d, turns=30, size=12):
    """What every principal may read, as answers of up to ``size`` ranked facts dealt over ``turns``, and what is kept from them."""
    c = Case(world(spark, d))
    seen = c.w.facts0.join(c.permitted, "space")
    from pyspark.sql import Window

    rows = seen.withColumn("turn", F.pmod(F.xxhash64("principal", "entity"), F.lit(turns)))
    w = Window.partitionBy("principal", "turn").orderBy("entity", "ord")
    # a turn with more than an answer holds goes on in answers after all first ones
    rows = rows.withColumn("at", F.row_number().over(w) - 1).withColumn("query", F.col("turn") + turns * F.floor(F.col("at") / size)).withColumn("rank", F.col("at") % size + 1)
    rows = rows.select("principal", "query", "rank", "fact_id", F.lit(0).alias("level"), "entity", "space", F.lit("").alias("claim"))
    refused = c.perms.select("perm").distinct().crossJoin(c.facts.select("req").distinct()).filter(~P.admissible(F.col("perm"), F.col("req")))
    denied = refused.join(c.perms, "perm").join(c.facts.select("claim", "req"), "req")
    return rows, denied.select("principal", "claim")


@query()
def plan_per_query(spark, d):
    """Every answer planned alone."""
    return planner.plan_sessions(*_planning(spark, d), session=False)


@query()
def session_ledger(spark, d):
    """Answers planned in sessions, with what was disclosed before."""
    return planner.plan_sessions(*_planning(spark, d), session=True)


@query()
def retention_curve(spark, d):
    """Retention over a session's queries."""
    return planner.retention_curve(planner.plan_sessions(*_planning(spark, d)))


TREE = "SELECT {level} AS level, node // 256 AS node, sha256(string_agg(digest, ',' ORDER BY node, digest)) AS digest FROM {below} GROUP BY node // 256"


@query()
def planner_sweep(spark, d):
    """How deep answers go before the plan has to hold something back."""
    return planner.sweep(*_planning(spark, d, turns=4, size=1 << 30))


@query(f"""WITH l0 AS (SELECT coalesce(doc_id, -1) AS node, sha256(coalesce(text, '')) AS digest FROM documents), l1 AS ({TREE.format(level=1, below='l0')}), l2 AS ({TREE.format(level=2, below='l1')}),
l3 AS ({TREE.format(level=3, below='l2')}), l4 AS ({TREE.format(level=4, below='l3')}) SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4""")
def corpus_digest(spark, d):
    """A tree of digests over all documents: each node digests those of up to 256 below it."""
    return provenance.digest_tree(read(spark, d, "documents").select(F.coalesce("doc_id", F.lit(-1)).alias("node"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")), 4)
