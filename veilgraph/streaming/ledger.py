"""Session ledgers over streams: what each principal has been shown, kept for good."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.planner import Ledger, plan

STATE = "facts array<struct<fact_id:string,level:int,entity:string,space:string,claim:string>>, queries int"
OUT = "principal string, query int, fact_id string, disclosed boolean"


def plan_stream(candidates: DataFrame, protected_of) -> DataFrame:
    """Plan answers as they come: (principal, rank, fact_id, level, entity, space, claim) per micro-batch.

    The facts a principal was shown are keyed state without a time-out: a disclosure cannot be forgotten.
    A row with fact_id null resets the session at its rank: what comes before it in the batch is planned in the old one.
    ``protected_of(principal)`` gives the claims to protect. What a new answer could complete is looked for among the
    entities of that answer alone, but a principal's state is read and written whole in every batch that concerns them.
    """

    def step(key, batches, state):
        known, asked = state.get if state.exists else ([], 0)
        protected = protected_of(key[0])
        ledger, known = Ledger(protected, [tuple(f) for f in known]), [tuple(f) for f in known]
        rows = pd.concat(list(batches)).sort_values("rank", kind="stable").reset_index(drop=True)
        resets = rows["fact_id"].isna()
        for part, answer in rows.groupby(resets.cumsum(), sort=True):
            if resets.loc[answer.index].any():
                ledger, known, asked = Ledger(protected), [], 0
                answer = answer[answer["fact_id"].notna()]
            facts = list(answer[["fact_id", "level", "entity", "space", "claim"]].itertuples(index=False, name=None))
            if not facts:
                continue
            kept, _, _ = plan(facts, ledger, protected)
            shown, old = {f[0] for f in kept}, {f[0] for f in known}
            ledger.add(kept)
            known, asked = [*known, *[f for f in kept if f[0] not in old]], asked + 1
            yield pd.DataFrame({"principal": key[0], "query": asked, "fact_id": [f[0] for f in facts], "disclosed": [f[0] in shown for f in facts]})
        state.update((known, asked))

    return candidates.groupBy("principal").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")
