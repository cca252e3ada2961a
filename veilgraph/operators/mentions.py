"""Who is mentioned: extraction with offsets, then a cascade of resolutions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EID = re.compile(r"\beid_[0-9a-f]{6,}\b", re.ASCII)
SPEAKER = re.compile(r"^\s*([A-Z][a-z]+(?: [A-Z][a-z]+)*)\s*:", re.M)
WORD = re.compile(r"\b[A-Z][a-z]+\b", re.ASCII)
SCHEMA = "source_id string, space string, surface string, register string, employee_id string, offset int, nth int"


def name_index(employees: DataFrame) -> DataFrame:
    """key, kind ('full' or 'first'), employee_id from (id, name)."""
    full = employees.select(F.lower("name").alias("key"), F.lit("full").alias("kind"), F.col("id").alias("employee_id"))
    first = employees.select(F.lower(F.split("name", " ")[0]).alias("key"), F.lit("first").alias("kind"), F.col("id").alias("employee_id"))
    return full.unionByName(first)


def candidates_in(text: str, kind: str | None, author: str | None, people, widest: int):
    """Every phrase that could be a name, longest first within a run, with its register and offset."""
    found = [(m[0], "identifier", m[0], m.start()) for m in EID.finditer(text)]
    found += [(p, "identifier", p, -1) for p in [author, *(people if people is not None else [])] if p and p.startswith("eid_")]
    if kind == "meeting_transcript":
        found += [(m[1], "speaker", None, m.start()) for m in SPEAKER.finditer(text)]
    words = [(m[0], m.start()) for m in WORD.finditer(text)]
    for width in range(widest, 0, -1):
        for i in range(len(words) - width + 1):
            run = words[i : i + width]
            length = run[-1][1] + len(run[-1][0]) - run[0][1]
            if length <= sum(len(w) for w, _ in run) + 2 * width:
                found.append((" ".join(w for w, _ in run), "full-name" if width > 1 else "first-name", str(i), run[0][1]))
    return found


def extract(sources: DataFrame, employees: DataFrame, widest: int = 3) -> DataFrame:
    """One row per mention of (source_id, space, kind, author, participants, text); ``nth`` is its place by offset.

    Phrases are looked up by a join with the name index, so the organisation may be of any size; what
    an accepted longer name consumes is then left out per source.
    """

    def phrases(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                for n, (surface, register, extra, offset) in enumerate(candidates_in(r.text or "", r.kind, r.author, r.participants, widest)):
                    rows.append((r.source_id, r.space, surface, register, extra, offset, n))
            yield pd.DataFrame(rows, columns=["source_id", "space", "surface", "register", "employee_id", "offset", "nth"])

    raw = sources.select("source_id", "space", "kind", "author", "participants", "text").mapInPandas(phrases, SCHEMA)
    index = name_index(employees)
    full = index.filter("kind = 'full'").select("key").distinct().withColumn("is_full", F.lit(True))
    first = index.filter("kind = 'first'").select(F.col("key").alias("f_key")).distinct().withColumn("is_first", F.lit(True))
    known = raw.withColumn("key", F.lower("surface")).join(full, "key", "left").withColumn("f_key", F.split("key", " ")[0]).join(first, "f_key", "left")
    keep = (
        F.when(F.col("register") == "identifier", True)
        .when(F.col("register") == "speaker", F.col("is_full").isNotNull() | F.col("is_first").isNotNull())
        .when(F.col("register") == "full-name", F.col("is_full").isNotNull())
        .otherwise(F.col("is_first").isNotNull())
    )
    kept = known.filter(keep).select("source_id", "space", "surface", "register", "employee_id", "offset", "nth")

    def consume(batches):
        for pdf in batches:
            rows = []
            for source_id, found in zip(pdf["source_id"], pdf["found"]):
                taken: set[int] = set()
                mine = []
                for m in found:
                    surface, register, extra, offset = m["surface"], m["register"], m["employee_id"], m["offset"]
                    if register in ("full-name", "first-name"):
                        i, width = int(extra), len(surface.split(" "))
                        # the first word decides, as a name starts at a word that no other name has taken
                        if i in taken:
                            continue
                        taken.update(range(i, i + width))
                        extra = None
                    mine.append((source_id, m["space"], surface, register, extra, offset))
                mine.sort(key=lambda r: r[5])
                seen: set = set()
                # the first of each (register, surface in any case) stays, with its place in the whole list
                for nth, r in enumerate(mine):
                    if (r[3], r[2].lower()) not in seen:
                        seen.add((r[3], r[2].lower()))
                        rows.append((*r, nth))
            yield pd.DataFrame(rows, columns=["source_id", "space", "surface", "register", "employee_id", "offset", "nth"])

    # the mentions of one source, in the order in which they were tried
    each = kept.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("nth", "space", "surface", "register", "employee_id", "offset"))).alias("found"))
    return each.mapInPandas(consume, SCHEMA)


def resolve(mentions: DataFrame, sources: DataFrame, employees: DataFrame, roster: DataFrame) -> DataFrame:
    """source_id, nth, resolved, method, candidates, confidence by a cascade that rather abstains than guesses.

    An identifier; a name one person has; the one namesake declared or identified in the source; none of them where a roll call
    exists: abstain; the one on the space's roster; the nearest identified namesake; else abstain.
    """
    index = name_index(employees)
    key = F.lower("surface")
    named = mentions.filter("register != 'identifier'")
    # how many a name could mean, and which if it is one; the people themselves only where a source or a roster has them
    names = index.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.min("employee_id").alias("any"))
    full = names.filter("kind = 'full'").select(F.col("key").alias("k"), F.col("n").alias("n_full"), F.col("any").alias("any_full"))
    first = names.filter("kind = 'first'").select(F.col("key").alias("f"), F.col("n").alias("n_first"), F.col("any").alias("any_first"))
    asked = named.select("source_id", "nth", "space", "offset", key.alias("key")).join(full, F.col("key") == F.col("k"), "left").withColumn("f_key", F.split("key", " ")[0]).join(first, F.col("f_key") == F.col("f"), "left")
    by_full = F.col("n_full").isNotNull()
    asked = asked.filter(by_full | F.col("n_first").isNotNull()).select(
        "source_id", "nth", "space", "offset", F.when(by_full, "full").otherwise("first").alias("kind"), F.when(by_full, F.col("k")).otherwise(F.col("f")).alias("name"),
        F.coalesce("n_full", "n_first").alias("n"), F.when(by_full, F.col("any_full")).otherwise(F.col("any_first")).alias("any"),
    )
    declared = sources.select("source_id", F.explode(F.filter(F.concat(F.array("author"), F.coalesce("participants", F.array().cast("array<string>"))), lambda p: p.startswith("eid_"))).alias("cand"))
    roll = declared.select("source_id").distinct().withColumn("roll", F.lit(True))
    anchors = mentions.filter("register = 'identifier'").select("source_id", F.col("employee_id").alias("cand"), F.col("offset").alias("at"))
    present = declared.unionByName(anchors.select("source_id", "cand")).distinct().withColumn("here", F.lit(True))
    near = anchors.groupBy("source_id", "cand").agg(F.collect_set("at").alias("ats"))
    team = roster.select("space", F.col("employee_id").alias("cand")).distinct().withColumn("on_team", F.lit(True))
    people = index.select("kind", F.col("key").alias("name"), F.col("employee_id").alias("cand"))
    here = asked.join(present, "source_id").join(people, ["kind", "name", "cand"])
    here = here.join(team, ["space", "cand"], "left").join(near, ["source_id", "cand"], "left").withColumn("distance", F.array_min(F.transform("ats", lambda a: F.abs(a - F.col("offset")))))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    pick = lambda c: F.min(F.when(c, F.col("cand")))
    at = F.min(F.when(F.col("distance").isNotNull(), F.struct("distance", "cand")))
    n_in = lambda c: F.sum(c.cast("int"))
    here = here.groupBy("source_id", "nth").agg(
        F.count(F.lit(1)).alias("n_here"), pick(F.lit(True)).alias("here"), n_in(yes("on_team")).alias("n_here_team"), pick(yes("on_team")).alias("here_team"),
        F.min(F.when(yes("on_team") & F.col("distance").isNotNull(), F.struct("distance", "cand"))).alias("near_team"), at.alias("near_here"),
    )
    rostered = team.join(people, "cand").groupBy("space", "kind", "name").agg(F.count(F.lit(1)).alias("n_roster"), F.min("cand").alias("roster"))
    rows = asked.join(here, ["source_id", "nth"], "left").join(rostered, ["space", "kind", "name"], "left").join(roll, "source_id", "left")
    rows = rows.withColumn("n_here", F.coalesce("n_here", F.lit(0)))
    # two namesakes here or more: the pool is they; else it is everyone of that name
    few, none = F.col("n_here") >= 2, F.lit(0)
    rows = rows.withColumn("n_team", F.when(few, F.coalesce("n_here_team", none)).otherwise(F.coalesce("n_roster", none))).withColumn("team", F.when(few, F.col("here_team")).otherwise(F.col("roster")))
    rows = rows.withColumn("n_pool", F.when(few, F.col("n_here")).otherwise(F.col("n"))).withColumn("n_narrow", F.when(F.col("n_team") > 0, F.col("n_team")).otherwise(F.col("n_pool")))
    rows = rows.withColumn("nearest", F.when(F.col("n_team") > 0, F.col("near_team")).otherwise(F.col("near_here"))).withColumn("left", F.when(F.col("n_team") > 0, F.col("team")).otherwise(F.col("any")))
    g = rows.withColumn("roll", yes("roll"))

    def choice(who, method: str, pool, confidence: float):
        return F.struct(who.cast("string").alias("resolved"), F.lit(method).alias("method"), pool.cast("long").alias("candidates"), F.lit(confidence).alias("confidence"))

    nobody, one = F.lit(None), F.lit(1)
    step = (
        F.when(F.col("n") == 1, choice(F.col("any"), "unique-name", one, 0.95))
        .when(F.col("n_here") == 1, choice(F.col("here"), "co-presence", one, 0.92))
        .when(F.col("roll") & (F.col("n_here") == 0), choice(nobody, "abstained", F.col("n_pool"), 0.0))
        .when(F.col("n_team") == 1, choice(F.col("team"), "space-roster", one, 0.85))
        .when((F.col("n_narrow") > 1) & F.col("nearest").isNotNull(), choice(F.col("nearest.cand"), "proximity", F.col("n_narrow"), 0.7))
        .when(F.col("n_narrow") == 1, choice(F.col("left"), "space-roster", one, 0.85))
        .otherwise(choice(nobody, "abstained", F.col("n_narrow"), 0.0))
    )
    decided = g.select("source_id", "nth", step.alias("s")).select("source_id", "nth", "s.*")
    sure = mentions.filter("register = 'identifier'").selectExpr("source_id", "nth", "employee_id as resolved", "'identifier' as method", "1L as candidates", "1D as confidence")
    none = named.join(decided, ["source_id", "nth"], "left_anti").selectExpr("source_id", "nth", "cast(null as string) as resolved", "'abstained' as method", "0L as candidates", "0D as confidence")
    return sure.unionByName(decided).unionByName(none)


def mention_stats(mentions: DataFrame) -> DataFrame:
    """register, n, n_sources: mentions by register, and the sources that have any."""
    return mentions.groupBy("register").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("n_sources"))


def pool_sizes(mentions: DataFrame, employees: DataFrame) -> DataFrame:
    """source_id, nth, before: how many people a mention's name could mean, before anything is resolved."""
    index = name_index(employees).groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"))
    full = index.filter("kind = 'full'").select(F.col("key").alias("k"), F.col("n").alias("n_full"))
    first = index.filter("kind = 'first'").select(F.col("key").alias("f"), F.col("n").alias("n_first"))
    key = F.lower("surface")
    rows = mentions.join(full, key == F.col("k"), "left").join(first, F.split(key, " ")[0] == F.col("f"), "left")
    before = F.when(F.col("register") == "identifier", 1).otherwise(F.coalesce("n_full", "n_first", F.lit(0)))
    return rows.select("source_id", "nth", before.cast("long").alias("before"))


def resolution_stats(resolved: DataFrame, pools: DataFrame) -> DataFrame:
    """method, n, n_resolved, mean_before, mean_after: how far the cascade narrows the people a name could mean."""
    rows = resolved.join(pools, ["source_id", "nth"])
    mean = lambda c: F.round(F.avg(c), 2)
    return rows.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count("resolved").alias("n_resolved"), mean("before").alias("mean_before"), mean("candidates").alias("mean_after"))


def resolution_accuracy(mentions: DataFrame, resolved: DataFrame, sources: DataFrame) -> DataFrame:
    """method, evaluated, correct, wrong, abstained over names in transcripts that list their participants; a resolution is right if it is one of them."""
    room = sources.filter("kind = 'meeting_transcript'").select("source_id", F.filter("participants", lambda p: p.startswith("eid_")).alias("room")).filter("size(room) > 0")
    names = mentions.filter("register != 'identifier' and employee_id is null").select("source_id", "nth")
    rows = names.join(room, "source_id").join(resolved, ["source_id", "nth"])
    right = F.array_contains("room", F.col("resolved"))
    return rows.groupBy("method").agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if(F.coalesce(right, F.lit(False))).alias("correct"), F.count_if(F.col("resolved").isNotNull() & ~right).alias("wrong"),
        F.count_if(F.col("resolved").isNull()).alias("abstained"),
    )


def accuracy_summary(by_method: DataFrame) -> DataFrame:
    """evaluated, correct, wrong, abstained, precision, recall; precision is of those resolved, recall of all."""
    total = by_method.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("evaluated", "correct", "wrong", "abstained")])
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return total.select("*", rate(F.col("correct"), F.col("correct") + F.col("wrong")).alias("precision"), rate(F.col("correct"), F.col("evaluated")).alias("recall"))
