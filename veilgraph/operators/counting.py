"""Counting over sets of names: which sets hold all, some or two of the names asked for.

Sets and what is asked of them meet in tiles of bounded size. In a tile each name has a bitmap over the sets, so a pair of a
set and an asked row costs a few bits, and no row is made of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .loops import settle

#: The most sets, asked rows, and names of either in a tile.
SETS, ASKED, NAMES = 1 << 16, 1 << 12, 1 << 21
NOWHERE = np.zeros(0, np.int64)


class Sets:
    """Sets of names as bitmaps by name. ``times``: how often each counts; the heaviest stand first, so the higher bits of ``times`` have short bitmaps."""

    def __init__(self, names: pa.ChunkedArray, times=None):
        lists = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        times = np.ones(len(lists), np.int64) if times is None else np.asarray(times, np.int64)
        self.size, self.order = len(lists), np.argsort(-times, kind="stable")
        place = np.empty(self.size, np.int64)
        place[self.order] = np.arange(self.size)
        coded = lists.flatten().dictionary_encode()
        known = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        owner = place[np.repeat(np.arange(self.size), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))]
        by = np.lexsort((owner, codes))
        owner, ends = owner[by], np.searchsorted(codes[by], np.arange(len(known) + 1))
        self.at = {name: owner[ends[i] : ends[i + 1]] for i, name in enumerate(known)}
        self.times, self.packed = times[self.order], {}
        self.full = np.packbits(np.ones(self.size, bool))
        self.slices = []
        for b in range(int(times.max(initial=0)).bit_length()):
            held = np.flatnonzero((self.times >> b) & 1)
            if len(held):
                mask = np.zeros(held[-1] + 1, bool)
                mask[held] = True
                self.slices.append((1 << b, np.packbits(mask)))

    def bits(self, name: str | None) -> np.ndarray:
        """The sets that hold a name; kept unless the name is rare."""
        got = self.packed.get(name)
        if got is None:
            at = self.at.get(name, NOWHERE)
            mask = np.zeros(self.size, bool)
            mask[at] = True
            got = np.packbits(mask)
            if len(at) * 32 >= self.size:
                self.packed[name] = got
        return got

    def all_of(self, names) -> np.ndarray:
        out = self.full
        for name in names:
            out = out & self.bits(name)
        return out

    def any_of(self, names) -> np.ndarray:
        out = np.zeros_like(self.full)
        for name in names:
            out = out | self.bits(name)
        return out

    def count(self, bits: np.ndarray) -> int:
        """How many sets, each as often as it counts."""
        return sum(v * int(np.bitwise_count(bits[: len(m)] & m).sum()) for v, m in self.slices)

    def places(self, bits: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bits, count=self.size))

    def tally(self, names) -> tuple[int, int, int]:
        """How many hold all the names, one at least, two at least."""
        if not names:
            return self.count(self.full), 0, 0
        every = some = self.bits(names[0])
        two = np.zeros_like(some)
        for name in names[1:]:
            b = self.bits(name)
            two, every, some = two | (some & b), every & b, some | b
        return self.count(every), self.count(some), self.count(two)


def _parts(df: DataFrame, names: str, rows: int) -> int:
    n = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(names)), F.lit(0)).alias("names")).first()
    return max(1, math.ceil(n["n"] / rows), math.ceil(n["names"] / NAMES))


def tiled(asked: DataFrame, sets: DataFrame, run: Callable, schema: str, want: str = "want", rows: int = ASKED, at: Column | None = None) -> DataFrame:
    """``run`` (of two Arrow tables, the asked rows and the sets) for every tile; ``asked`` has ``want``, ``sets`` has ``names``.

    ``at``: the tile of an asked row, a text, where rows must meet; by the digest of ``want`` otherwise.
    """
    n_asked, n_sets = _parts(asked, want, rows), _parts(sets, "names", SETS)
    at = F.pmod(F.xxhash64(want), F.lit(n_asked)).cast("string") if at is None else at(n_asked)
    left = asked.withColumn("a_tile", at)
    tiles = settle(left.select("a_tile").distinct())
    left = left.withColumn("s_tile", F.explode(F.sequence(F.lit(0), F.lit(n_sets - 1))))
    right = sets.withColumn("s_tile", F.pmod(F.xxhash64("names"), F.lit(n_sets)).cast("int")).crossJoin(F.broadcast(tiles))
    n = min(2 * n_sets * max(n_asked, tiles.count()), 2000)
    by = ["a_tile", "s_tile"]
    return left.repartition(n, *by).groupBy(*by).cogroup(right.repartition(n, *by).groupBy(*by)).applyInArrow(run, schema)


def counted_sets(perms: DataFrame) -> DataFrame:
    """names, n: the distinct sets of (perm), and how often each stands there."""
    return settle(perms.groupBy(F.col("perm").alias("names")).agg(F.count(F.lit(1)).alias("n")))


def wanted(*names: Column) -> Column:
    """One sorted array of all the names; null if any part is."""
    out = names[0]
    for x in names[1:]:
        out = F.array_union(out, x)
    return F.array_sort(F.array_distinct(out))


def holders(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """want, n_all, n_any, n_two: how many of ``sets`` (names, n) hold all of the names in ``want``, one or two of them at least.

    ``asked``: want, sorted. A null among the names is held by no set.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        s = Sets(right["names"], right["n"].to_numpy())
        rows = [s.tally(w) for w in left["want"].to_pylist()]
        n = np.array(rows, np.int64).reshape(-1, 3)
        kept = pa.array(left["want"].to_pylist(), pa.list_(pa.string()))
        return pa.table({"want": kept, "n_all": n[:, 0], "n_any": n[:, 1], "n_two": n[:, 2]})

    asked = settle(asked.select("want").filter("want is not null").distinct())
    out = tiled(asked, sets, run, "want array<string>, n_all long, n_any long, n_two long")
    return settle(out.groupBy("want").agg(*[F.sum(c).alias(c) for c in ("n_all", "n_any", "n_two")]))


def _keyed(sets: DataFrame, by: str) -> str:
    return f"{by} {sets.schema[by].dataType.simpleString()}"


def covered(sets: DataFrame, asked: DataFrame, by: str) -> DataFrame:
    """by, n: the sum of ``n`` over the rows of ``asked`` (want, n) all of whose names a set (by, names) holds; sets that hold none have no row or 0."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        s = Sets(right["names"])
        n = np.zeros(s.size, np.int64)
        for want, times in zip(left["want"].to_pylist(), left["n"].to_pylist()):
            n[s.places(s.all_of(want))] += times
        hit = np.flatnonzero(n)
        return pa.table({by: right[by].take(pa.array(s.order[hit])), "n": n[hit]})

    asked = settle(asked.select("want", "n").filter("want is not null"))
    out = tiled(asked, sets, run, f"{_keyed(sets, by)}, n long")
    return out.groupBy(by).agg(F.sum("n").alias("n"))


def one_short(sets: DataFrame, asked: DataFrame, by: str) -> DataFrame:
    """by, name, n, n_more: the sum of ``n`` over the rows of ``asked`` (want, n) of whose names a set (by, names) lacks ``name`` alone; n_more: of those that ask for more than it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        s, rows = Sets(right["names"]), {}
        for name, rest, times in zip(left["name"].to_pylist(), left["rest"].to_pylist(), left["n"].to_pylist()):
            rows.setdefault(name, []).append((rest, times))
        out = {by: [], "name": [], "n": [], "n_more": []}
        for name, asks in rows.items():
            lack, n = s.full & ~s.bits(name), np.zeros((2, s.size), np.int64)
            for rest, times in asks:
                at = s.places(lack & s.all_of(rest))
                n[0][at] += times
                if rest:
                    n[1][at] += times
            hit = np.flatnonzero(n[0])
            out[by].append(right[by].take(pa.array(s.order[hit])).combine_chunks())
            out["name"].append(pa.array([name] * len(hit), pa.string()))
            out["n"].append(pa.array(n[0][hit]))
            out["n_more"].append(pa.array(n[1][hit]))
        kinds = {by: right.schema.field(by).type, "name": pa.string(), "n": pa.int64(), "n_more": pa.int64()}
        return pa.table({c: pa.chunked_array([x for y in v for x in (y.chunks if isinstance(y, pa.ChunkedArray) else [y])], kinds[c]) for c, v in out.items()})

    rows = 1 << 14
    asks = settle(asked.filter("want is not null").select(F.explode("want").alias("name"), "want", "n").select("name", F.array_remove("want", F.col("name")).alias("rest"), "n"))
    parts = asks.groupBy("name").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("parts"))
    asks = settle(asks.join(parts, "name"))

    # rows of one name meet in one tile, unless they are too many
    def at(n: int) -> Column:
        alone = F.concat(F.col("name"), F.lit("#"), F.pmod(F.xxhash64("rest"), "parts").cast("string"))
        return F.when(F.col("parts") > 1, alone).otherwise(F.pmod(F.xxhash64("name"), F.lit(n)).cast("string"))

    out = tiled(asks, sets, run, f"{_keyed(sets, by)}, name string, n long, n_more long", "rest", rows, at)
    return out.groupBy(by, "name").agg(F.sum("n").alias("n"), F.sum("n_more").alias("n_more"))
