"""Set-level disclosure planning, per answer and per session."""

from __future__ import annotations

from collections import Counter
from itertools import combinations, groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_SPACES = 6


def closure(facts: list[tuple]) -> set[str]:
    """The claims that (fact_id, level, entity, space, claim) tuples assert or let one derive, in their order."""
    claims = {f[4] for f in facts if f[1] > 0}
    spaces: dict = {}
    for _, level, entity, space, _ in facts:
        if level == 0:
            spaces.setdefault(entity, {}).setdefault(space)
    spanned: Counter = Counter()
    for entity, seen in spaces.items():
        if len(seen) >= 2:
            first = list(seen)[:MOST_SPACES]
            claims.add(f"person:{entity}")
            spanned.update(combinations(sorted(first), 2))
    pairs = {p for p, n in spanned.items() if n >= 2}
    claims |= {f"pair|{a}|{b}" for a, b in pairs}
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    claims |= {f"cluster|{a}|{b}|{c}" for a, b in pairs for c in near.get(b, ()) if (a, c) in pairs}
    return claims


class Ledger:
    """Facts disclosed in their order, and which of ``protected`` their :func:`closure` holds with some more facts.

    Only the entities of those facts are looked at again, so that long ledgers cost no more than short ones.
    """

    def __init__(self, protected: set[str], facts: list[tuple] = ()):
        self.protected, self.held = protected, set()
        self.spaces: dict = {}
        self.spanned: Counter = Counter()
        self.near: dict = {}
        self.add(facts)

    def _with(self, facts: list[tuple]):
        """(violations, spaces of the entities, newly spanned pairs and their counts) once ``facts`` are disclosed too."""
        claims = {f[4] for f in facts if f[1] > 0}
        seen: dict = {}
        for _, level, entity, space, _ in facts:
            if level == 0:
                seen.setdefault(entity, dict(self.spaces.get(entity, ()))).setdefault(space)
        more: Counter = Counter()
        for entity, now in seen.items():
            if len(now) >= 2:
                claims.add(f"person:{entity}")
                old = list(self.spaces.get(entity, ()))[:MOST_SPACES]
                if len(old) < min(len(now), MOST_SPACES):
                    known = set(combinations(sorted(old), 2))
                    more.update(p for p in combinations(sorted(list(now)[:MOST_SPACES]), 2) if p not in known)
        near: dict = {}
        for (a, b), n in more.items():
            if self.spanned[a, b] < 2 <= self.spanned[a, b] + n:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        around = lambda x: self.near.get(x, set()) | near.get(x, set())
        for a, ends in near.items():
            for b in ends:
                if a < b:
                    claims.add(f"pair|{a}|{b}")
                    claims |= {"cluster|" + "|".join(sorted((a, b, c))) for c in around(a) & around(b)}
        return self.held | (claims & self.protected), seen, more, near

    def violations(self, facts: list[tuple]) -> set[str]:
        return self._with(facts)[0] if self.protected else set()

    def add(self, facts: list[tuple]) -> None:
        if self.protected:
            self.held, seen, more, near = self._with(facts)
            self.spaces.update(seen)
            self.spanned.update(more)
            for a, ends in near.items():
                self.near.setdefault(a, set()).update(ends)


def plan(candidates: list[tuple], prior: list[tuple] | Ledger, protected: set[str]):
    """(kept, dropped, safe): the candidates to disclose, best first, so that nothing protected can be rebuilt.

    While something can, the lowest-ranked fact whose removal lessens the violations goes, or else the last.
    ``prior`` is what was disclosed before, as facts or as the ledger of ``protected``.
    """
    before = prior if isinstance(prior, Ledger) else Ledger(protected, prior)
    kept, dropped = list(candidates), []
    bad = before.violations(kept)
    while bad and kept:
        for i in range(len(kept) - 1, -1, -1):
            left = before.violations(kept[:i] + kept[i + 1 :])
            if len(left) < len(bad):
                break
        else:
            i = len(kept) - 1
            left = before.violations(kept[:i])
        dropped.append(kept.pop(i))
        bad = left
    return kept, dropped, not bad


def plan_sessions(candidates: DataFrame, protected: DataFrame, session: bool = True) -> DataFrame:
    """principal, query, n_admissible, n_disclosed, n_suppressed, safe, retention.

    ``candidates``: principal, query, rank, fact_id, level, entity, space, claim, all admissible; ``protected``:
    principal, claim. With ``session`` what was disclosed before counts, query by query: a principal's ledger.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        secret, rows = set(right["claim"]), []
        ledger = Ledger(secret)
        ranked = left.sort_values(["query", "rank"])[["principal", "query", "fact_id", "level", "entity", "space", "claim"]]
        for (principal, query), g in groupby(ranked.itertuples(index=False, name=None), key=lambda r: r[:2]):
            facts = [r[2:] for r in g]
            kept, dropped, safe = plan(facts, ledger if session else Ledger(secret), secret)
            rows.append((principal, query, len(facts), len(kept), len(dropped), safe, len(kept) / len(facts)))
            if session:
                ledger.add(kept)
        return pd.DataFrame(rows, columns=["principal", "query", "n_admissible", "n_disclosed", "n_suppressed", "safe", "retention"])

    return candidates.groupBy("principal").cogroup(protected.groupBy("principal")).applyInPandas(
        run, "principal long, query long, n_admissible long, n_disclosed long, n_suppressed long, safe boolean, retention double"
    )


def retention_curve(plans: DataFrame) -> DataFrame:
    """query, retention: disclosed over admissible up to each query, over all principals."""
    from pyspark.sql import Window

    per = plans.groupBy("query").agg(F.sum("n_disclosed").alias("d"), F.sum("n_admissible").alias("a"))
    w = Window.orderBy("query").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("query", F.round(F.sum("d").over(w) / F.sum("a").over(w), 6).alias("retention"))


def sweep(candidates: DataFrame, protected: DataFrame, depths: tuple[int, ...] = (10, 20, 50, 100, 200)) -> DataFrame:
    """k, queries, bound, suppressed, retention: answers planned alone from the first ``k`` candidates of each, for every depth.

    ``bound``: answers from which something had to go. If no depth binds, the guarantee is free and also untested.
    """
    each = candidates.withColumn("k", F.explode(F.array(*[F.lit(d) for d in depths]))).filter(F.col("rank") <= F.col("k"))
    # every depth of an answer is a query of its own, so that one pass over the principals plans them all
    key = F.col("query") * len(depths) + F.array_position(F.array(*[F.lit(d) for d in depths]), F.col("k")) - 1
    plans = plan_sessions(each.withColumn("query", key.cast("long")).drop("k"), protected, session=False)
    depth = F.element_at(F.array(*[F.lit(d) for d in depths]), (F.col("query") % len(depths) + 1).cast("int"))
    return plans.groupBy(depth.alias("k")).agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("n_suppressed") > 0).alias("bound"), F.sum("n_suppressed").alias("suppressed"),
        F.round(F.sum("n_disclosed") / F.sum("n_admissible"), 6).alias("retention"),
    )
