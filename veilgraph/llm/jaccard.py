"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

A document is the set of its word shingles, as 64-bit hashes. Sets that are equal are one vertex, told apart by 128-bit
digests. Two frequency sketches over all sets, of shingles and of words, give one
order of all shingles, the rare ones first: the count of a shingle's bucket and the count of its rarest word both bound its own, and the
lesser counts (where the shingles outgrow the buckets, words still tell what many texts share). Two sets that link share a shingle within the first
``n - ceil(t n) + 1`` of each. Candidates come from a join on those prefix shingles and pass the length
filter, the positional filter, and two suffix filters that bound the symmetric difference by
comparing how many shingles fall into ranges of the hash. What is left is verified on the whole sets, which are fetched
for the vertices of such pairs alone; a pair that was refused is not verified again.

What is asked for are the components of the links, so pairs within a component already found are not
listed: in rounds, each component of a prefix shingle is first compared with one
representative there; then every pair of sets in different components that shares a prefix shingle
is compared, where only the smaller side of a shingle is joined with all of it. No group of near
copies is expanded into all its pairs, and no link between components is lost.

Defined results: sets without shingles (null and empty texts, white space) link with nothing; rows
without an id link with nothing; repeated rows are one vertex and each have a row;
an empty table gives an empty result; extra columns pass through :func:`keep_one`.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import in_slices
from .components import components
from .scratch import drop, stash
from .words import mixed, shingle_sets, word_hashes

SKETCH_BITS, SLICE_BITS = 22, 12
PARTS = 128
#: Of 256 ranges of the hash, whether a set has an odd number of shingles in each: the bits in which two sets differ number
#: at most their symmetric difference, so the suffix filter can stand in a join's condition.
ODD = ("odd1", "odd2", "odd3", "odd4")
SIGNATURE = "parts binary, odd1 long, odd2 long, odd3 long, odd4 long"
STAR_ROUNDS = 2
#: Sets remembered by a task so that copies are sent once; forgetting one costs only rows.
REMEMBERED = 50_000
#: Up to so many ids (16 bytes each) are broadcast to pick their documents; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _names(digests: list[bytes], twins: frozenset) -> np.ndarray:
    """A vertex is named by the first half of its digest, or by the second where the first stands for different sets."""
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    names = both[:, 0].copy()
    if twins:
        other = np.fromiter((x in twins for x in names.tolist()), bool, len(names))
        names[other] = both[other, 1]
    return names


def _bucket(found: np.ndarray) -> np.ndarray:
    return (mixed(found) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _signatures(found: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set the number of shingles in each of ``PARTS`` ranges (to 255), and the parity words."""
    n = len(bounds) - 1
    spread, owner = mixed(found), np.repeat(np.arange(n), np.diff(bounds))
    part = np.bincount(owner * PARTS + (spread >> np.uint64(64 - 7)).astype(np.int64), minlength=n * PARTS).clip(0, 255)
    odd = np.bincount(owner * 256 + (spread >> np.uint64(56)).astype(np.int64), minlength=n * 256) & 1
    return part.astype(np.uint8).reshape(n, PARTS), np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(n, 4)


def described(docs: DataFrame, width: int) -> DataFrame:
    """Two kinds of rows: doc_id, n, the digest's halves and the signature of each document, and (part, counts), a piece of a task's sketch."""
    kinds = "doc_id long, n long, half1 long, half2 long, " + SIGNATURE + ", part int, counts binary"
    names = [f.split()[0] for f in kinds.split(", ")]

    def run(batches):
        counts, seen = np.zeros((2, 1 << SKETCH_BITS), np.uint32), set()
        for b, texts in in_slices(batches, "text"):
            found, bounds = shingle_sets(texts, width)
            digests = [digest(found[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]
            fresh = np.zeros(len(texts), bool)
            for i, d in enumerate(digests):
                if d not in seen:
                    seen.add(d)
                    fresh[i] = True
            if len(seen) > REMEMBERED:
                seen.clear()
            size = np.diff(bounds)
            words, ends = word_hashes(texts)
            np.add.at(counts[0], _bucket(found[np.repeat(fresh, size)]), np.uint32(1))
            np.add.at(counts[1], _bucket(words[np.repeat(fresh, np.diff(ends))]), np.uint32(1))
            part, odd = _signatures(found, bounds)
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            nothing = pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.binary())
            parts = pa.array([x.tobytes() for x in part], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (size.astype(np.int64), *both.T.copy())), parts, *map(pa.array, odd.T.copy()), *nothing], names=names)
        pieces = counts.reshape(-1, 1 << SLICE_BITS)
        used = np.flatnonzero(pieces.any(1))
        packed = [zlib.compress(pieces[i].tobytes(), 1) for i in used]
        none = lambda k, t: [pa.nulls(len(used), t)] * k
        yield pa.RecordBatch.from_arrays(
            [*none(4, pa.int64()), *none(1, pa.binary()), *none(4, pa.int64()), pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=names
        )

    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def twins_of(rows: DataFrame) -> frozenset:
    """First halves that stand for different sets: of n sets about n^2 / 2^65 are expected, so there are few even among 10^12."""
    twins: frozenset = frozenset()
    while True:
        name = F.when(F.col("half1").isin(list(twins)), F.col("half2")).otherwise(F.col("half1")) if twins else F.col("half1")
        pair = F.struct("half1", "half2")
        clash = rows.groupBy(name.alias("name")).agg(F.min(pair).alias("lo"), F.max(pair).alias("hi")).filter("lo < hi")
        new = {r[x]["half1"] for r in clash.select("lo", "hi").collect() for x in ("lo", "hi")}
        if not new:
            return twins
        if new <= twins:
            raise ValueError("two sets share both halves of their digests crosswise")
        twins = twins | new


def rarity(rows: DataFrame) -> np.ndarray:
    """A byte per bucket of the two sketches that grows with the logarithm of its count: 8 MB for any input."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for part, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.uint64)
                held[part] = held[part] + x if part in held else x
        level = [np.round(8 * np.log2(1.0 + x)).clip(0, 255).astype(np.uint8).tobytes() for x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(level, pa.binary())], names=["part", "level"])

    merged = rows.filter("part is not null").select("part", "counts").repartition("part").mapInArrow(add, "part int, level binary")
    out = np.zeros((2 << (SKETCH_BITS - SLICE_BITS), 1 << SLICE_BITS), np.uint8)
    for r in merged.collect():
        out[r["part"]] = np.frombuffer(bytes(r["level"]), np.uint8)
    return out.reshape(2, -1)


def prefixes(docs: DataFrame, levels, twins, width: int, percent: int) -> DataFrame:
    """shingle, key, n, pos: the rare-first prefix of every set, once a task."""

    def run(batches):
        seen = set()
        for _, texts in in_slices(batches, "text"):
            by_shingle, by_word = levels.value
            found, bounds, rarest = shingle_sets(texts, width, lambda words: by_word[_bucket(words)])
            # by level, then by hash: stable, as the hashes of a set are sorted
            rank = np.minimum(by_shingle[_bucket(found)], rarest).astype(np.uint64) << np.uint64(56) | found >> np.uint64(8)
            digests = [digest(found[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]
            cols = [[], [], [], []]
            for i, j, key in zip(bounds[:-1].tolist(), bounds[1:].tolist(), _names(digests, twins).tolist()):
                if i == j or key in seen:
                    continue
                seen.add(key)
                n = j - i
                p = n - -(-percent * n // 100) + 1
                order = np.argsort(rank[i:j], kind="stable")[:p]
                for c, x in zip(cols, (found[i:j][order].view(np.int64), np.full(p, key), np.full(p, n, np.int32), np.arange(p, dtype=np.int32))):
                    c.append(x)
            if len(seen) > REMEMBERED:
                seen.clear()
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["shingle", "key", "n", "pos"])

    return docs.filter("doc_id is not null").select("text").mapInArrow(run, "shingle long, key long, n int, pos int")


def whole_sets(docs: DataFrame, wanted: DataFrame, twins, width: int) -> DataFrame:
    """key, body: the sets of the vertices in ``wanted`` (doc_id, key)."""

    def run(batches):
        for b, texts in in_slices(batches, "text"):
            found, bounds = shingle_sets(texts, width)
            sets = [found[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
            # an id may stand on rows of other texts as well
            names = _names([digest(x) for x in sets], twins).tolist()
            rows = [(k, x.tobytes()) for k, name, x in zip(b.column(0).to_pylist(), names, sets) if k == name]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary()))], names=["key", "body"])

    w = wanted.select(F.col("doc_id").alias("w_id"), "key")
    if wanted.count() <= BROADCAST_IDS:
        w = F.broadcast(w)
    return docs.join(w, F.col("doc_id") == F.col("w_id")).select("key", "text").mapInArrow(run, "key long, body binary").dropDuplicates(["key"])


def _need(percent: int):
    """SQL: the least intersection with which sets of ``n1`` and ``n2`` shingles link."""
    return f"cast(ceil({percent} * (n1 + n2) / {100 + percent}D - 1e-9) as int)"


def _with_both(pairs: DataFrame, sets: DataFrame, *cols) -> DataFrame:
    one = sets.select("key", *cols).toDF("k1", *[f"{c}1" for c in cols])
    two = sets.select("key", *cols).toDF("k2", *[f"{c}2" for c in cols])
    return pairs.join(one, F.col("a") == F.col("k1")).join(two, F.col("b") == F.col("k2"))


def close(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that pass the suffix filter on the signatures."""

    def near(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(n, PARTS).astype(np.int16) for i in (2, 3))
            size = np.asarray(b.column(4), np.int64) + np.asarray(b.column(5), np.int64)
            # a link needs |A ^ B| <= (1 - t) / (1 + t) (|A| + |B|)
            ok = np.abs(x - y).sum(1) * (100 + percent) <= (100 - percent) * size
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], names=["a", "b"])

    return _with_both(pairs, sets, "n", "parts").select("a", "b", "parts1", "parts2", "n1", "n2").mapInArrow(near, "a long, b long")


class Verifier:
    """Verifies pairs of vertices on their whole sets, each pair once."""

    def __init__(self, docs, sets, twins, width, percent):
        self.docs, self.sets, self.twins, self.width, self.percent = docs, sets, twins, width, percent
        self.refused: list[DataFrame] = []

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a < b) that link."""
        percent = self.percent

        def exact(batches):
            for b in batches:
                keep = []
                for x, y in zip(b.column(2), b.column(3)):
                    p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    if len(p) > len(q):
                        p, q = q, p
                    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                    both = int((q[at] == p).sum())
                    keep.append(100 * both >= percent * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keep, pa.bool_())], names=["a", "b", "link"])

        for old in self.refused:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        few = stash(close(pairs, self.sets, percent), "jac-close")
        keys = few.select(F.col("a").alias("key")).union(few.select("b")).distinct()
        wanted = stash(self.sets.select("doc_id", "key").join(keys, "key", "left_semi"), "jac-wanted")
        bodies = stash(whole_sets(self.docs, wanted, self.twins, self.width), "jac-bodies")
        told = stash(_with_both(few, bodies, "body").select("a", "b", "body1", "body2").mapInArrow(exact, "a long, b long, link boolean"), "jac-told")
        for done in (few, wanted, bodies):
            drop(done)
        self.refused.append(told.filter("not link").select("a", "b"))
        return told.filter("link").select("a", "b")


def _open(rows: DataFrame) -> DataFrame:
    """The rows (with ``comp``) of the shingles at which more than one component stands."""
    several = rows.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("shingle")
    return stash(rows.join(several, "shingle", "left_semi"), "jac-open")


def _moved(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """``rows`` with ``comp`` followed along ``moves`` (node, root)."""
    on = moves.toDF("m_node", "m_root")
    return rows.join(on, F.col("comp") == F.col("m_node"), "left").withColumn("comp", F.coalesce("m_root", "comp")).drop("m_node", "m_root")


def _possible(percent: int) -> str:
    """SQL over n1, n2, pos1, pos2: the length filter, and the positional filter for the first shingle in common.

    Of a pair that links, the row of its first common shingle passes; rows of later ones need not.
    """
    return f"""100 * least(n1, n2) >= {percent} * greatest(n1, n2)
        and least(n1 - pos1, n2 - pos2) >= {_need(percent)}"""


def _stars(rows: DataFrame, percent: int) -> DataFrame:
    """a, b, c1, c2: one pair per component, its representative at a shingle and the shingle's hub, the hub met most often.

    Representatives and hubs are the sets with the most prefix shingles in common with others: a set in the middle of
    a group of near copies has few shingles of its own.
    """
    reps = rows.groupBy("shingle", "comp").agg(F.max(F.struct("shared", "key", "n", "pos")).alias("r"))
    hubs = reps.groupBy("shingle").agg(F.max(F.struct("r", "comp")).alias("h"))
    met = reps.join(hubs, "shingle").filter("comp != h.comp").selectExpr(
        "comp as c1", "h.comp as c2", "r.key as a", "h.r.key as b", "r.n as n1", "h.r.n as n2", "r.pos as pos1", "h.r.pos as pos2"
    )
    met = met.filter(_possible(percent)).groupBy("c1", "c2", "a", "b").count()
    return met.groupBy("c1").agg(F.max(F.struct("count", "a", "b", "c2")).alias("m")).select("m.a", "m.b", "c1", "m.c2")


def _crossing(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, c1, c2: every pair of sets of different components at a shingle; only what is outside the largest component is joined with all."""
    sizes = rows.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("c"))
    major = sizes.groupBy("shingle").agg(F.max(F.struct("c", "comp")).alias("m")).select("shingle", F.col("m.comp").alias("major"))
    rows = rows.join(sets.select("key", *ODD), "key")
    minor = rows.join(major, "shingle").filter("comp != major").selectExpr("shingle", "key as a", "n as n1", "pos as pos1", "comp as c1", "major", *[f"{x} as x{x}" for x in ODD])
    every = rows.selectExpr("shingle", "key as b", "n as n2", "pos as pos2", "comp as c2", *[f"{x} as y{x}" for x in ODD])
    apart = " + ".join(f"bit_count(x{x} ^ y{x})" for x in ODD)
    met = minor.join(every, "shingle").filter("c1 != c2 and (c2 = major or a < b)").filter(_possible(percent))
    return met.filter(f"({apart}) * {100 + percent} <= {100 - percent} * (n1 + n2)").select("a", "b", "c1", "c2")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs with a < b, and their components alike."""
    turned = F.col("a") > F.col("b")
    cols = [F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("c1", "c2"), ("c2", "c1"))]
    return pairs.select(*cols).dropDuplicates(["a", "b"])


def jaccard_components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    first = stash(described(docs, width), "jac-docs")
    known = first.filter("half1 is not null")
    twins = twins_of(known.filter("n > 0"))
    name = F.when(F.col("half1").isin(list(twins)), F.col("half2")).otherwise(F.col("half1")) if twins else F.col("half1")
    known = known.withColumn("key", name)
    levels = spark.sparkContext.broadcast(rarity(first))  # 8 MB, whatever the input

    every = stash(prefixes(docs, levels, twins, width, percent), "jac-prefix")
    several = every.groupBy("shingle").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo < hi").select("shingle")
    rows = stash(every.join(several, "shingle", "left_semi").dropDuplicates(["shingle", "key"]), "jac-shared")
    drop(every)
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("shared"))
    once, rows = rows, stash(rows.join(shared, "key").withColumn("comp", F.col("key")), "jac-open")
    drop(once)
    mine = known.filter("n > 0 and doc_id is not null").join(rows.select("key").distinct(), "key", "left_semi")
    least = F.min(F.struct("doc_id", "n", "parts", *ODD)).alias("v")
    sets = stash(mine.groupBy("key").agg(least).select("key", "v.*"), "jac-sets")
    verify = Verifier(docs, sets, twins, width, percent)

    comps = sets.select("key", F.col("key").alias("comp"))
    for turn in range(STAR_ROUNDS + 1):
        pairs = stash(_ordered(_stars(rows, percent) if turn < STAR_ROUNDS else _crossing(rows, sets, percent)), "jac-pairs")
        links = verify(pairs.select("a", "b")).join(pairs, ["a", "b"])
        moves = components(links.select(F.col("c1").alias("a"), F.col("c2").alias("b")))
        comps = _moved(comps, moves)
        if turn < STAR_ROUNDS:
            old, rows = rows, _open(_moved(rows, moves))
            drop(old)
        drop(pairs)

    roots = known.join(comps.toDF("c_key", "root"), F.col("key") == F.col("c_key"), "left").select("doc_id", "n", F.coalesce("root", "key").alias("root"))
    roots = stash(roots, "jac-roots")
    lowest = roots.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least")).withColumnRenamed("root", "l_root")
    joined = roots.join(lowest, (F.col("root") == F.col("l_root")) & (F.col("n") > 0), "left")
    member = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(member, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, width=5, percent=80) -> DataFrame:
    """``docs`` with the lowest id of every component only; rows repeated under that id all stay."""
    found = jaccard_components(docs, width, percent)
    gone = found.filter("doc_id != component_id").select(F.col("doc_id").alias("vg_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["vg_gone"], "left_anti")


def op6(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs, 3, 90)
