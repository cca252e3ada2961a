"""A tamper-evident audit log: written per chain, resumed where it ended, verified in parallel."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
# Names of fields that would carry content.
CONTENT = "(?i)^(text|content|body|snippet|excerpt|answer|value|summary)$"
LISTS = ("required", "missing", "would_complete")
COLUMNS = ("chain", "seq", "at", "decision", "principal", "facts", *LISTS, "detail")
SCHEMA = (
    "chain string, seq long, at string, decision string, principal string, facts array<string>, required array<string>, missing array<string>, "
    "would_complete array<string>, detail map<string,string>, prev string, hash string"
)


def refuse_content(entries: DataFrame, detail: str = "detail_map") -> DataFrame:
    """Fails on rows whose detail names a content field: the log holds identifiers alone."""
    bad = F.coalesce(F.exists(F.map_keys(detail), lambda k: k.rlike(CONTENT)), F.lit(False))
    return entries.withColumn(detail, F.when(bad, F.raise_error(F.lit("audit: content field"))).otherwise(F.col(detail)))


def _entries(entries: DataFrame) -> DataFrame:
    """The entries with every column; what is not given is null, and a detail in JSON becomes a map."""
    if dict(entries.dtypes).get("detail") == "string":
        entries = entries.withColumn("detail", F.expr("transform_values(cast(parse_json(detail) as map<string, variant>), (k, v) -> to_json(v))"))
    kinds = {x.split()[0]: x.split()[1] for x in SCHEMA.replace("map<string,string>", "map").split(", ")} | {"detail": "map<string,string>"}
    return entries.select(*[(F.col(c) if c in entries.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS])


def heads(log: DataFrame) -> DataFrame:
    """chain, seq, hash of the last entry of each chain."""
    return log.groupBy("chain").agg(F.max(F.struct("seq", "hash")).alias("x")).select("chain", "x.*")


def record(entries: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """The entries (chain, seq, at, decision, principal, facts, and if given required, missing, would_complete, detail) with prev and hash.

    ``seq`` orders the new entries of a chain. They go on where the chain ends in ``log``: their seq counts on from its last, or
    stays as it is for a new chain. ``detail`` maps names to JSON scalars (texts in quotes), or is a JSON object; names of content fields fail.
    Writing is sequential by nature, so a log is split into chains (a principal, a day), each hashed in order within one task.
    """
    rows = refuse_content(_entries(entries), "detail")
    if log is None:
        rows = rows.withColumn("h_seq", F.lit(None).cast("long")).withColumn("h_hash", F.lit(None).cast("string"))
    else:
        rows = rows.join(heads(log).toDF("h_chain", "h_seq", "h_hash"), F.col("chain") == F.col("h_chain"), "left").drop("h_chain")

    def plain(x):
        return None if x is None else sorted(x)

    def run(batches):
        # the entries of a task's chains, one chain after the other, each in order; what a chain has come to goes on from batch to batch
        chain = at = prev = None
        begun = False
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in b.schema.names}
            seqs, prevs, hashes = [], [], []
            for i, name in enumerate(cols["chain"]):
                if not begun or name != chain:
                    begun, chain, at = True, name, cols["h_seq"][i]
                    prev = GENESIS if at is None else cols["h_hash"][i]
                seq = cols["seq"][i] if at is None else at + 1
                at = None if at is None else seq
                detail = None if cols["detail"][i] is None else [[k, json.loads(v)] for k, v in sorted(dict(cols["detail"][i]).items())]
                body = [seq, cols["at"][i], cols["decision"][i], cols["principal"][i], sorted(cols["facts"][i] or []), *[plain(cols[c][i]) for c in LISTS], detail, prev]
                seqs.append(seq)
                prevs.append(prev)
                prev = hashlib.sha256(json.dumps(body, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
                hashes.append(prev)
            new = {"seq": pa.array(seqs, pa.int64()), "prev": pa.array(prevs, pa.string()), "hash": pa.array(hashes, pa.string())}
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(c) if c in b.schema.names else None) for c in (*COLUMNS, "prev", "hash")], names=[*COLUMNS, "prev", "hash"])

    return rows.repartition("chain").sortWithinPartitions("chain", "seq").mapInArrow(run, SCHEMA)


def append(entries: DataFrame, path: str) -> None:
    """Adds entries to the log at ``path`` (JSON lines), or begins it."""
    spark = entries.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    record(entries, read(spark, path) if there else None).write.mode("append").json(path, ignoreNullFields=True)


def read(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def _canonical():
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}), r'^\{"x":|\}$', "")
    ordered = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(quoted(F.array_sort(c)))
    facts = quoted(F.array_sort(F.coalesce("facts", F.array().cast("array<string>"))))
    pairs = F.transform(F.array_sort(F.map_entries("detail")), lambda e: F.concat(F.lit("["), F.regexp_replace(F.to_json(F.array(e["key"])), r"^\[|\]$", ""), F.lit(","), e["value"], F.lit("]")))
    detail = F.when(F.col("detail").isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]")))
    parts = [F.col("seq").cast("string"), *[quoted(F.col(c)) for c in ("at", "decision", "principal")], facts, *[ordered(c) for c in LISTS], detail, quoted(F.col("prev"))]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def verify(log: DataFrame) -> DataFrame:
    """chain, entries, broken_at, reason: the first entry of each chain that does not follow, or was changed (null if none)."""
    w = Window.partitionBy("chain").orderBy("seq")
    place = F.row_number().over(w) - 1
    rows = log.withColumn("place", place).withColumn("before", F.coalesce(F.lag("hash").over(w), F.lit(GENESIS)))
    reason = F.when(F.col("prev") != F.col("before"), "does not follow").when(F.sha2(_canonical(), 256) != F.col("hash"), "modified")
    rows = rows.withColumn("reason", reason)
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("place", "reason")))
    return rows.groupBy("chain").agg(F.count(F.lit(1)).alias("entries"), first.alias("f")).select("chain", "entries", F.col("f.place").alias("broken_at"), "f.reason")


def summarise(log: DataFrame) -> DataFrame:
    """decision, n."""
    return log.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def busiest(log: DataFrame, most: int = 10) -> DataFrame:
    """principal, n of the ``most`` principals with the most entries; ties by principal."""
    return log.groupBy("principal").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "principal").limit(most)
