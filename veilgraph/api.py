"""The service surface as functions of DataFrames: ask, check, plan, preview, risk, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import audit, permissions, planner, policy, provenance, retrieval


class Service:
    """Facts (fact_id, level, space, text, req), permissions and reporting lines, and what can be asked of them."""

    def __init__(self, facts: DataFrame, permitted: DataFrame, edges: DataFrame | None = None, asked: DataFrame | None = None):
        self.facts, self.permitted, self.edges, self.asked = facts, permitted, edges, asked
        self.perms = permissions.as_arrays(permitted)

    def overview(self) -> DataFrame:
        return self.facts.groupBy("level").agg(F.count(F.lit(1)).alias("n"))

    def principals(self) -> DataFrame:
        return self.perms.select("principal", F.size("perm").alias("n_spaces")).orderBy(F.desc("n_spaces"), "principal")

    def questions(self, most: int = 50) -> DataFrame:
        """The first questions of the corpus that have an answer."""
        return self.asked.filter("answerable").orderBy("space", "question").limit(most)

    def answer_as(self, principal, question: str, top: int = 8) -> DataFrame:
        """said, doc_id, text: what a principal is told. Nothing found and nothing admitted are said alike, so that a refusal tells nothing."""
        rows = self.ask_as(principal, question, top).filter("admitted").join(self.facts.select(F.col("fact_id").alias("doc_id"), "text"), "doc_id")
        told = rows.select(F.lit("found").alias("said"), "doc_id", "text")
        blank = self.facts.sparkSession.createDataFrame([("nothing available to you answers this",)], "said string")
        nothing = blank.join(told.limit(1).select(F.lit(1).alias("some")), F.lit(True), "left").filter("some is null").select("said", F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("string").alias("text"))
        return told.unionByName(nothing)

    def _perm(self, principal):
        return self.perms.filter(F.col("principal") == principal).select("perm")

    def ask_as(self, principal, question: str, top: int = 8, candidates: int = 24) -> DataFrame:
        """rank, doc_id, score, admitted, missing of the facts for a question; an unknown principal is admitted to none."""
        spark = self.facts.sparkSession
        q = spark.createDataFrame([(0, question)], "query_id long, text string")
        hits = retrieval.ranked(retrieval.bm25(self.facts.select(F.col("fact_id").alias("doc_id"), "text"), q), candidates)
        rows = hits.join(self.facts.select(F.col("fact_id").alias("doc_id"), "req"), "doc_id").join(self._perm(principal), F.lit(True), "left")
        out = retrieval.gated(rows, permissions.decision(F.col("perm"), F.col("req")), top)
        return out.select("rank", "doc_id", "score", "admitted", F.when(~F.col("admitted"), permissions.missing(F.col("perm"), F.col("req"))).alias("missing"))

    def check_admissible(self, asked: DataFrame) -> DataFrame:
        """principal, fact_id, admitted, missing for (principal, fact_id, requires, rests_on).

        A known fact counts by what it requires; else by what the caller says; else by its supports, and if any of those is unknown, or nothing is required, it is refused.
        """
        known = self.facts.select(F.col("fact_id").alias("k_id"), F.col("req").alias("k_req"))
        rows = asked.join(known, F.col("fact_id") == F.col("k_id"), "left")
        below = asked.select("principal", "fact_id", F.explode("rests_on").alias("s")).join(known, F.col("s") == F.col("k_id"), "left")
        union = below.groupBy("principal", "fact_id").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("k_req", F.array(F.lit(provenance.UNRESOLVABLE))))))).alias("s_req")
        )
        rows = rows.join(union, ["principal", "fact_id"], "left").join(self.perms, "principal", "left")
        said = F.when(F.size("requires") > 0, F.col("requires"))
        req = F.coalesce("k_req", said, "s_req", F.array().cast("array<string>"))
        return rows.select("principal", "fact_id", permissions.decision(F.col("perm"), req).alias("admitted"), permissions.missing(F.col("perm"), req).alias("missing"))

    def derivation(self, fact_id: str) -> DataFrame:
        return provenance.chains(self.edges).filter(F.col("fact_id") == fact_id)

    def risk_surface(self, most: int = 40) -> DataFrame:
        sets = self.facts.filter("level > 0").select("req").distinct().crossJoin(self.perms.groupBy("perm").agg(F.count(F.lit(1)).alias("np")))
        aud = sets.groupBy("req").agg(F.sum(F.when(permissions.admissible(F.col("perm"), F.col("req")), F.col("np")).otherwise(0)).alias("audience"))
        return self.facts.filter("level > 0").join(aud, "req").orderBy("audience", F.desc(F.size("req")), "fact_id").limit(most).select("fact_id", "level", "audience")

    def policy_preview(self, after: DataFrame) -> DataFrame:
        return policy.preview(self.permitted, after, self.facts.filter("level = 0"), self.facts.filter("level > 0"))

    plan_disclosure = staticmethod(planner.plan_sessions)
    audit_verify = staticmethod(audit.verify)
    audit_summary = staticmethod(audit.summarise)


def audit_tail(log: DataFrame, n: int = 20) -> DataFrame:
    return log.orderBy(F.desc("seq")).limit(n)


def session_state(disclosed: DataFrame) -> DataFrame:
    """principal, size, queries, determines of what was disclosed in sessions (principal, query, fact_id, level, entity, space, claim)."""

    def count(pdf):
        import pandas as pd

        facts = list(pdf.sort_values("fact_id")[["fact_id", "level", "entity", "space", "claim"]].itertuples(index=False, name=None))
        return pd.DataFrame([(pdf["principal"].iloc[0], pdf["fact_id"].nunique(), pdf["query"].nunique(), len(planner.closure(facts)))], columns=["principal", "size", "queries", "determines"])

    kind = disclosed.schema["principal"].dataType.simpleString()
    return disclosed.groupBy("principal").applyInPandas(count, f"principal {kind}, size long, queries long, determines long")


def session_reset(disclosed: DataFrame, principals: DataFrame) -> DataFrame:
    """What stays disclosed once the sessions of ``principals`` (principal) are reset."""
    return disclosed.join(principals.select("principal"), "principal", "left_anti")


def verdict_matrix(facts: DataFrame, perms: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """fact_id, principal, verdicts, and with ``edges`` the fact's chain: what each gate says of each derived fact."""
    g = permissions.gates(F.col("perm"), F.col("req"), F.col("space"))
    parts = [x for k, v in g.items() for x in (F.lit(k), v)]
    out = facts.filter("level > 0").crossJoin(perms).select("fact_id", "principal", F.create_map(*parts).alias("verdicts"))
    return out if edges is None else out.join(provenance.chains(edges), "fact_id", "left")


#: What a report card asks of a run: area and claim of each check, by the summary that it reads and the rule it must meet.
CHECKS = (
    ("inference", "no refusal of level 1 is phantom", lambda s: s["phantom"]["1"] == 0),
    ("inference", "every cut holds", lambda s: s["cuts_held"] == s["cuts"]),
    ("inference", "phantom refusals have not grown", lambda s: s["phantom_total"] <= s["phantom_before"]),
    ("planner", "no plan was returned unsafe", lambda s: s["unsafe"] == 0),
    ("planner", "safety costs nothing at the usual depth", lambda s: s["constrained"] == 0),
    ("planner", "the constraint binds somewhere", lambda s: any(s["sweep"])),
    ("policy", "a policy compiled again does not drift", lambda s: s["drift"] == 0),
    ("attack", "no leak under the claim-aware gate", lambda s: s["leaks"]["claim-aware"] == 0),
    ("model", "no probe is told true by a model", lambda s: s["tp"] == 0),
)


def report_card(summaries: dict[str, dict], commit: str | None = None) -> list[tuple[str, str, str]]:
    """(area, claim, status) of every check: 'missing' without a summary of its area, 'fail' where its rule is broken or cannot be read, 'stale'
    where the summary was made at another commit, else 'pass'."""
    out = []
    for area, claim, rule in CHECKS:
        s = summaries.get(area)
        if s is None:
            out.append((area, claim, "missing"))
            continue
        try:
            good = bool(rule(s))
        except (KeyError, TypeError):
            good = False
        old = commit is not None and s.get("commit") not in (None, "unknown", commit)
        out.append((area, claim, "fail" if not good else "stale" if old else "pass"))
    return out
