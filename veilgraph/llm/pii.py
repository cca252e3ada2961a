"""Personal data: base patterns, then information-theoretic sanitisation (DataFrame operations only).

Every e-mail address, IP address, payment card and phone number found is a
protected entity. The words of the documents that hold it are candidate terms. From
counts over all documents, ``PMI(e; t) = log p(e, t) / (p(e) p(t))`` and
``IC(e) = -log p(e)`` say which part of the entity's information a term gives
away. A term whose share ``PMI / IC`` reaches ``GENERALISE`` is generalised wherever it stands in a document that
holds the entity: to the longest of its beginnings (``CLASSES`` letters) that, as the class of all words that begin so, gives away less than
``GENERALISE`` of each of the document's entities it told about. Where no class does, and from ``REMOVE`` on, it is removed.
Only terms seen with the entity in ``SUPPORT`` different whole texts count, so
that copies of one text are no evidence, while one passage in different texts is.

Defined results: null text is empty; an entity that stands in all documents has
no information to lose; texts without an entity never change; rows repeated
under one id are each done alike; an empty table gives an empty result; extra
columns pass through :func:`sanitise` whatever their names (:func:`detect` adds columns that start with ``vg_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .scratch import stash

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
GENERALISE, REMOVE, SUPPORT = 0.75, 0.95, 2
CLASSES = (3, 1)
WORD = r"\p{L}[\p{L}\p{N}_-]{2,}+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


LUHN = """exists(array(regexp_replace(v, '[^0-9]', '')), d -> aggregate(sequence(1, length(d)), 0, (t, i) -> t + (
    case when i % 2 = 1 then cast(substring(d, length(d) - i + 1, 1) as int)
    else cast(substring('0246813579', cast(substring(d, length(d) - i + 1, 1) as int) + 1, 1) as int) end)) % 10 = 0)"""
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"

RULES = (
    (
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: F.contains(t, F.lit("@")),
        None,
    ),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", None, rf"v rlike r'^{PART}(?:\.{PART}){{3}}$'"),
    ("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){12,18}+(?![ -]?[0-9])", None, LUHN),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), "length(regexp_replace(v, '[^0-9]', '')) between 9 and 15"),
)


def entity_key(kind: Column, value: Column) -> Column:
    """One key for the ways in which an entity is written."""
    plain = F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.lower(value))
    return F.xxhash64(kind, plain)


def base_spans(docs: DataFrame, text="text") -> DataFrame:
    """``docs`` with vg_email, vg_ip, vg_card and vg_phone, vg_hash of the text, vg_entities, and vg_words of texts that hold an entity."""
    found = S.with_spans(docs, F.col(text), RULES).drop(*[f"vg_{part}_{k}" for part in ("cut", "at") for k in KINDS])
    of = lambda kind: F.transform(f"vg_{kind}", lambda s: entity_key(F.lit(kind), s["value"]))
    found = found.withColumn("vg_hash", F.xxhash64(text)).withColumn("vg_entities", F.array_distinct(F.concat(*[of(k) for k in KINDS])))
    held = F.when(F.size("vg_entities") > 0, F.col(text))
    words = F.transform("vg_word", lambda s: F.struct(F.lower(s["value"]).alias("term"), s["start"].alias("start"), s["end"].alias("end")))
    found = S.with_spans(found, held, [("word", WORD, None, None)])
    return found.withColumn("vg_words", words).drop("vg_word", "vg_cut_word", "vg_at_word")


def _beginnings(words: Column) -> Column:
    """The distinct classes that words fall into."""
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(*[F.substring(w, 1, k) for k in CLASSES]))))


def _held(found: DataFrame) -> DataFrame:
    """doc_id, vg_hash, entities, words (array<struct<term, start, end>>), copies for each text that holds an entity; equal rows are one."""
    m = found.filter("size(vg_entities) > 0").select("doc_id", "vg_hash", F.col("vg_entities").alias("entities"), F.col("vg_words").alias("words"))
    return m.groupBy("doc_id", "vg_hash").agg(F.first("entities").alias("entities"), F.first("words").alias("words"), F.count(F.lit(1)).alias("copies"))


def disclosing_terms(held: DataFrame, docs: DataFrame, text="text", generalise=GENERALISE, support=SUPPORT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The terms that give away at least ``generalise`` of an entity's information: (entity, term, share, n_entity);
    (doc_id, vg_hash, entity, term) for the documents that hold both; and (class, n_class), how many documents have a word of each class.

    No term that can reach ``generalise`` is passed over: as a pair stands in at most ``n_entity`` documents, its share is at most
    ``log(n_docs / n_term) / log(n_docs / n_entity)``, so terms with more than ``n_docs^(1-g) n_entity^g`` documents are left out of pairs.
    """
    n_docs = docs.count()
    n = float(max(n_docs, 1))
    keys = ["doc_id", "vg_hash"]
    mine = held.select(*keys, "copies", F.explode("entities").alias("entity"))
    # Counts by text first, here and below: a key with many rows is summed before it is dealt out.
    entity = mine.groupBy("entity", "vg_hash").agg(F.sum("copies").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("texts"))
    entity = stash(entity.filter((F.col("texts") >= support) & (F.col("n_entity") < n_docs)).drop("texts"), "pii-entities")
    bound = lambda n_entity: F.pow(F.lit(n), F.lit(1 - generalise)) * F.pow(n_entity.cast("double"), F.lit(generalise)) * (1 + 1e-9)
    most = entity.agg(F.max("n_entity")).first()[0] or 0
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))
    # words and their classes (behind a mark that begins no word) are counted in one pass over the texts
    kinds = docs.select(words.alias("w")).select(F.explode(F.concat("w", F.transform(_beginnings(F.col("w")), lambda c: F.concat(F.lit("*"), c)))).alias("term"))
    counts = stash(kinds.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).filter(F.col("n_term") >= support), "pii-counts")
    term = counts.filter(~F.col("term").startswith("*") & (F.col("n_term") <= bound(F.lit(most))))
    n_class = counts.filter(F.col("term").startswith("*")).select(F.expr("substring(term, 2)").alias("class"), F.col("n_term").alias("n_class"))
    theirs = held.select(*keys, F.explode(F.array_distinct(F.transform("words", lambda w: w["term"]))).alias("term")).join(term, "term")
    mine = mine.join(entity, "entity").withColumnsRenamed({"doc_id": "e_id", "vg_hash": "e_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("e_id")) & (F.col("vg_hash") == F.col("e_hash"))
    both = theirs.join(mine, same & (F.col("n_term") <= bound(F.col("n_entity"))))
    both = stash(both.select(*keys, "copies", "entity", "term", "n_entity", "n_term"), "pii-pairs")
    pair = both.groupBy("entity", "term", "vg_hash").agg(F.sum("copies").alias("n"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    pair = pair.groupBy("entity", "term").agg(
        F.sum("n").alias("n_pair"), F.count(F.lit(1)).alias("support"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term")
    )
    p_e, p_t = F.col("n_entity") / F.lit(n), F.col("n_term") / F.lit(n)
    share = F.log(F.col("n_pair") / F.lit(n) / (p_e * p_t)) / -F.log(p_e)
    told = pair.filter(F.col("support") >= support).select("entity", "term", share.alias("share"), "n_entity").filter(F.col("share") >= generalise)
    return told, both.select(*keys, "entity", "term"), n_class


def harmless_classes(telling: DataFrame, held: DataFrame, n_class: DataFrame, n_docs: int, generalise=GENERALISE, remove=REMOVE) -> DataFrame:
    """entity, term, fits: of each telling term that need not be removed, the lengths of the beginnings whose class gives away less than ``generalise``."""
    n = float(max(n_docs, 1))
    cut = telling.filter(F.col("share") < remove).withColumn("k", F.explode(F.array(*map(F.lit, CLASSES)))).filter(F.length("term") > F.col("k"))
    cut = stash(cut.select("entity", "term", "n_entity", "k", F.expr("substring(term, 1, k)").alias("class")), "pii-classes")
    asked = cut.select("class").distinct()
    theirs = held.select("copies", "entities", F.explode(_beginnings(F.transform("words", lambda w: w["term"]))).alias("class")).join(asked, "class", "left_semi")
    n_pair = theirs.select("copies", "class", F.explode("entities").alias("entity")).join(cut.select("entity", "class").distinct(), ["entity", "class"], "left_semi")
    n_pair = n_pair.groupBy("entity", "class").agg(F.sum("copies").alias("n_pair"))
    share = F.log(F.col("n_pair") * F.lit(n) / (F.col("n_entity") * F.col("n_class"))) / F.log(F.lit(n) / F.col("n_entity"))
    fit = cut.join(n_class, "class").join(n_pair, ["entity", "class"]).filter(share < generalise)
    return fit.groupBy("entity", "term").agg(F.collect_set("k").alias("fits"))


def _places(held: DataFrame, docs: DataFrame, text: str, generalise: float, support: int) -> DataFrame:
    """vg_t_id, vg_t_hash, vg_terms: array<struct<start, end, share, kept>> of the disclosing terms of each text; ``kept`` is the class that a term becomes, null to remove it."""
    telling, both, n_class = disclosing_terms(held, docs, text, generalise, support)
    telling = stash(telling, "pii-terms")
    fits = harmless_classes(telling, held, n_class, docs.count(), generalise)
    told = both.join(telling.join(fits, ["entity", "term"], "left").select("entity", "term", "share", "fits"), ["entity", "term"])
    every = [F.bool_and(F.coalesce(F.array_contains("fits", F.lit(k)), F.lit(False))) for k in CLASSES]
    longest = F.coalesce(*[F.when(fit, F.lit(k)) for k, fit in zip(CLASSES, every)])
    told = told.groupBy("doc_id", "vg_hash", "term").agg(F.max("share").alias("share"), longest.alias("k"))
    told = told.withColumnsRenamed({"doc_id": "vg_t_id", "vg_hash": "vg_t_hash", "term": "vg_t_term"})
    words = held.select("doc_id", "vg_hash", F.explode("words").alias("w")).select("doc_id", "vg_hash", "w.*")
    same = F.col("doc_id").eqNullSafe(F.col("vg_t_id")) & (F.col("vg_hash") == F.col("vg_t_hash"))
    kept = F.expr("substring(vg_t_term, 1, k)")
    return (
        words.join(told, same & (F.col("term") == F.col("vg_t_term")))
        .groupBy("vg_t_id", "vg_t_hash", "start", "end").agg(F.max(F.struct("share", kept.alias("kept"))).alias("x"))
        .groupBy("vg_t_id", "vg_t_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", "x.share", "x.kept"))).alias("vg_terms"))
    )


def _with_terms(found: DataFrame, places: DataFrame) -> DataFrame:
    same = F.col("doc_id").eqNullSafe(F.col("vg_t_id")) & (F.col("vg_hash") == F.col("vg_t_hash"))
    base = f"concat({', '.join(f'vg_{k}' for k in KINDS)})"
    terms = "coalesce(vg_terms, cast(array() as array<struct<start:int,end:int,share:double,kept:string>>))"
    out = found.join(places, same, "left").withColumn("vg_terms", F.expr(S.apart(terms, base)))
    return out.drop("vg_t_id", "vg_t_hash", "vg_hash", "vg_entities", "vg_words")


def detect(docs: DataFrame, text="text", generalise=GENERALISE, support=SUPPORT) -> DataFrame:
    """``docs`` with the base spans and vg_terms, array<struct<start, end, share, kept>> of disclosing terms."""
    found = base_spans(docs, text)
    # of all rows: a filter here would have the optimizer repeat the whole span search in it
    spans = stash(found.select("doc_id", "vg_hash", "vg_entities", "vg_words"), "pii-found")
    places = _places(stash(_held(spans), "pii-held"), docs, text, generalise, support)
    return _with_terms(found, places)


def spans_alone(docs: DataFrame, text="text", generalise=GENERALISE, support=SUPPORT) -> DataFrame:
    """doc_id and what :func:`detect` adds; texts are searched once and never dealt out."""
    found = stash(base_spans(docs.select("doc_id", F.col(text).alias("text"))).drop("text"), "pii-found")
    return _with_terms(found, _places(stash(_held(found), "pii-held"), docs, text, generalise, support))


ALL = f"""array_sort(concat({', '.join(f"transform(vg_{k}, s -> struct(s.start as start, {i} as ord, s.end as end, '{k}' as kind, cast(null as string) as kept))" for i, k in enumerate(KINDS))},
    transform(vg_terms, s -> struct(s.start as start, {len(KINDS)} as ord, s.end as end, '{TERM}' as kind, s.kept as kept))))"""


def sanitise(docs: DataFrame, text="text", **limits) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind, telling terms by their class, and what has none removed."""
    plain, named = S.shielded(docs)
    found = detect(plain, text, **limits).withColumn("vg_all", F.expr(ALL))
    tag = f"case when s.kind != '{TERM}' then concat('[', upper(s.kind), ']') when s.kept is null then '' else concat(s.kept, '*') end"
    return named(S.replaced(found, text, "vg_all", tag))


def op2(docs: DataFrame) -> DataFrame:
    base = S.written(f"concat({', '.join(S.tagged(k, f'vg_{k}', 0) for k in KINDS)})")
    terms = S.written(f"transform(vg_terms, s -> struct(s.start as start, s.end as end, '{TERM}' as kind))")
    found = spans_alone(docs).withColumn("vg_base", F.expr(base))
    return found.select(
        "doc_id",
        *[F.size(f"vg_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2("vg_base", 256).alias("base_sha256"),
        F.expr(f"concat_ws(',', nullif(vg_base, ''), nullif({terms}, ''))").alias("spans"),
        F.size("vg_terms").cast("long").alias("n_term"),
    )
