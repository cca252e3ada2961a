"""Hashed random projections of token weights, and answers put together from retrieved sources."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .retrieval import bm25

DIMS = 256
MASK = 0xFFFFFFFF


def signs(term: str, dims: int = DIMS) -> np.ndarray:
    """+-1 per dimension from a 32-bit FNV-1a hash of the term, drawn on by xorshift."""
    h = 0x811C9DC5
    for b in term.encode("utf-16-le")[::2]:
        h = ((h ^ b) * 0x01000193) & MASK
    out = np.empty(dims)
    for i in range(dims):
        h ^= (h << 13) & MASK
        h ^= h >> 17
        h ^= (h << 5) & MASK
        out[i] = 1.0 if h & 1 else -1.0
    return out


def project(docs: DataFrame, text="text") -> DataFrame:
    """doc_id, v: unit vectors of (1 + ln tf) ln(1 + n / df) weights under :func:`signs`; zero without tokens."""
    d = docs.select("doc_id", F.explode_outer(tokens(F.col(text))).alias("term"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    tf = d.filter("term is not null").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = (1 + F.log("tf")) * F.log(1 + F.col("n") / F.col("df"))
    rows = tf.join(df, "term").crossJoin(n).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term", weight.alias("w")))).alias("terms"))

    def run(batches):
        known: dict[str, np.ndarray] = {}
        for pdf in batches:
            out = []
            for terms in pdf["terms"]:
                v = np.zeros(DIMS)
                for t in terms:
                    if t["term"] not in known:
                        if len(known) > 20_000:
                            known.clear()
                        known[t["term"]] = signs(t["term"])
                    v += t["w"] * known[t["term"]]
                norm = math.sqrt(float(v @ v))
                out.append(v / norm if norm else v)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "v": out})

    vectors = rows.mapInPandas(run, _schema(docs))
    blank = F.array_repeat(F.lit(0.0), DIMS)
    return docs.select("doc_id").join(vectors, "doc_id", "left").select("doc_id", F.coalesce("v", blank).alias("v"))


def _schema(docs: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([*docs.select("doc_id").schema.fields, T.StructField("v", T.ArrayType(T.DoubleType()))])


def by_citation(questions: DataFrame, support: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score: the facts under a question's citations, in their order, scored 1, 1/2, 1/3, ...

    ``questions``: query_id, citations, text; ``support``: citation, fact_id, also of derived facts. Questions without
    citations fall back to lexical retrieval over ``docs`` (doc_id, text), where given.
    """
    cited = questions.select("query_id", F.posexplode("citations").alias("place", "citation"))
    hit = cited.join(support.select("citation", F.col("fact_id").alias("doc_id")), "citation").groupBy("query_id", "doc_id").agg(F.min("place").alias("place"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "doc_id"))
    out = hit.select("query_id", "doc_id", (1.0 / nth).alias("score"))
    if docs is None:
        return out
    plain = questions.filter(F.coalesce(F.size("citations"), F.lit(0)) <= 0).select("query_id", "text")
    return out.unionByName(bm25(docs, plain).select("query_id", "doc_id", "score"))


def answer_people(hits: DataFrame, about: DataFrame, share: float = 0.45, most: int = 12) -> DataFrame:
    """query_id, answer: the people the retrieved facts are about, by summed score, 4 more per derived fact, cut relative to the best."""
    w = hits.join(about.select(F.col("fact_id").alias("doc_id"), "entity", "level"), "doc_id")
    w = w.groupBy("query_id", "entity").agg(F.sum(F.col("score") + F.when(F.col("level") > 0, 4.0).otherwise(0.0)).alias("weight"))
    q = Window.partitionBy("query_id")
    w = w.withColumn("best", F.max("weight").over(q)).withColumn("rank", F.row_number().over(q.orderBy(F.desc("weight"), "entity")))
    return w.filter((F.col("weight") >= share * F.col("best")) & (F.col("rank") <= most)).groupBy("query_id").agg(F.array_sort(F.collect_list("entity")).alias("answer"))


def links_in(text):
    """The addresses in a text, without closing punctuation."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"https?://[^\s]+"), F.lit(0)), lambda u: F.regexp_replace(u, r"""[).,>"']+$""", "")))
