"""Embedding near-duplicates by sorted projections.

Every link is found, at every table size and however the vectors lie: the distinct vectors are dealt into blocks, and every pair of
blocks is compared in a task of its own. Within a task the vectors are sorted by the signs of their projections on ``AXES`` orthonormal
directions and cut into runs of ``RUN``; two runs are compared unless the boxes of their projections are further apart than vectors at
the limit can be (``|Pu - Pv|^2 <= |u - v|^2 = 2 - 2 cos``). A pair is looked at in single precision first, by as few projections as part a
sample well (``u v <= Pu Pv + |Ru| |Rv|``, ``R`` being what they leave of a vector) or by all components, with room for rounding; what passes is decided in
double precision, pair by pair. Pruning hangs on the data, results do not. Where vectors lie evenly in many dimensions nothing is too far apart
to be looked at, and the work is quadratic in the distinct vectors; blocks are dealt out in parts of ``COPIES`` copies of the table, so disk is not.

A caller that names a ``recall`` below 1 chooses random hashes instead, for tables where that is too much; no table size does. In every
pass the vectors are then ordered by the signs of their products with fresh random directions, and a vector is compared with its window: all
vectors that share the first ``bits`` signs. Two vectors at the limit agree in a sign with probability ``p = 1 - acos(limit) / pi``, so
``ceil(log(1 - recall) / log(1 - p^bits))`` passes find any such pair with a probability of ``recall`` at least; what is closer is found more
surely. :func:`plan` chooses ``bits`` by the work it costs, from the number of vectors and from how crowded the windows of a bounded sample are.
Windows are compared as the whole table is, less the pairs that an earlier pass has compared: a pair counts in the first pass whose
window holds both, so passes add up.

Only a row per linked vector leaves a task: how many rows it links with there, and the least node it is connected to there, which together
give link counts and components without listing pairs.
Vectors equal in every component are one node with a multiplicity, so one very common vector costs one row.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing,
as do vectors of different lengths; equal cosines need no tie-break; rows repeated under an
id are nodes of their own for the link counts; an empty table gives an empty
result; extra columns are not returned.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import stash

AXES, RUN = 64, 1024
#: Most vectors of a block; a smaller window makes up to ``SPREAD`` blocks of at least ``LEAST_BLOCK``, for tasks to share. No result hangs on them.
BLOCK, SPREAD, LEAST_BLOCK = 65536, 8, 2048
#: Most copies of a vector that are dealt out at a time where the whole table is one window.
COPIES = 4
#: Projections of a first look at a pair, the rows of a sample that tells if they do, the share of its pairs they may leave, and the pairs of two runs that are worth a product of matrices.
LOOKS, LOOK_ROWS, FEW, MANY = (16, 32), 256, 1 / 256, 16384
#: The least probability with which passes find a pair at the limit.
RECALL = 0.999
#: Passes whose rows are dealt out together, and most passes of a plan.
TOGETHER, MOST_PASSES = 4, 96
#: Vectors (of the lowest digests) from which the crowding of windows is told, and how many comparisons a vector's move is worth.
SAMPLE, MOVE = 4096, 1024


def _unit(lists) -> list[np.ndarray | None]:
    out = []
    for x in lists:
        v = None if x is None or any(c is None for c in x) else np.asarray(x, np.float64)
        if v is not None and len(v) and np.isfinite(v).all() and v.any():
            v = v / np.abs(v).max()
            out.append(v / np.sqrt(v @ v))
        else:
            out.append(None)
    return out


def unit_vectors(rows: DataFrame) -> DataFrame:
    """node, unit: the distinct usable vectors as bytes of doubles; ``node`` is a digest."""
    import xxhash

    def run(batches):
        for b in batches:
            ids, units, nodes = [], [], []
            for i, v in zip(b.column(0).to_pylist(), _unit(b.column(1).to_pylist())):
                data = None if v is None else v.tobytes()
                ids.append(i)
                units.append(data)
                nodes.append(None if v is None else int(np.frombuffer(xxhash.xxh128_digest(data)[:8], np.int64)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(units, pa.binary())], names=["vec_id", "node", "unit"])

    return rows.select("vec_id", "embedding").mapInArrow(run, "vec_id long, node long, unit binary")


def _sorted_runs(x: np.ndarray, axes: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows of ``x`` by the signs of their projections, and the boxes (least, greatest) of its runs of ``RUN``."""
    at = x @ axes
    order = np.lexsort((at > centre).T[::-1])
    starts = np.arange(0, len(x), RUN)
    return order, np.minimum.reduceat(at[order], starts), np.maximum.reduceat(at[order], starts)


def _look(x: np.ndarray, width: int) -> np.ndarray:
    """Rows in single precision whose products are the cosines' upper bounds by ``width`` projections, or the cosines if it is 0."""
    if not width:
        return x.astype(np.float32)
    at = x @ _axes(x.shape[1])[:, :width]
    rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", at, at), 0))
    return np.column_stack([at, rest]).astype(np.float32)


def _least(limit: float, columns: int) -> np.float32:
    """What products of ``columns`` numbers in single precision may come to for a pair at ``limit``."""
    return np.float32(limit - (columns + 8) * 2.0**-23)


def _width(x: np.ndarray, y: np.ndarray, limit: float) -> int:
    """The fewest projections of ``LOOKS`` that leave few pairs of a sample, else 0: all components. It tells in the work only."""
    step, other = -(-len(x) // LOOK_ROWS), -(-len(y) // LOOK_ROWS)
    a, b = x[::step], y[other // 2 :: other]
    for width in LOOKS:
        if width < x.shape[1] and (_look(a, width) @ _look(b, width).T >= _least(limit, width + 1)).mean() <= FEW:
            return width
    return 0


def _places(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` for few hits: eight places are passed over at a time."""
    flat = hits.ravel()
    if len(flat) % 8:
        return np.divmod(np.flatnonzero(flat), hits.shape[1])
    eights = np.flatnonzero(flat.view(np.int64))
    row, at = np.nonzero(flat.reshape(-1, 8)[eights])
    return np.divmod(eights[row] * 8 + at, hits.shape[1])


def _near(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Which of the pairs of rows ``a`` of ``x`` and ``b`` of ``y`` link, by sums over one pair at a time: the last digits hang on no block."""
    near, doubt = np.zeros(len(a), bool), np.arange(len(a))
    if len(a) > MANY:
        cosines = (x @ y.T)[a, b]
        near = cosines >= limit
        doubt = np.flatnonzero(np.abs(cosines - limit) <= (x.shape[1] + 8) * 2.0**-51)
    step = max(1, 2**20 // x.shape[1])
    for first in range(0, len(doubt), step):
        some = doubt[first : first + step]
        near[some] = np.einsum("ij,ij->i", x[a[some]], y[b[some]]) >= limit
    return near


def _joined(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lets each place of ``roots`` point to the least place it is connected to, now that ``a`` and ``b`` are."""
    while True:
        x, y = roots[a], roots[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(roots, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (roots[roots] != roots).any():
            roots[:] = roots[roots]


@lru_cache(64)
def _directions(dim: int, turn: int, bits: int) -> np.ndarray:
    return np.random.default_rng([20240731, dim, turn]).standard_normal((dim, max(bits, 1)))[:, :bits]


@lru_cache(8)
def _axes(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([977, dim]).standard_normal((dim, min(dim, AXES))))[0]


def windows(x: np.ndarray, turns, bits: int) -> np.ndarray:
    """The window of each row of ``x`` in each of the passes ``turns``: its first ``bits`` signs as a number."""
    out = np.zeros((len(x), len(turns)), np.int64)
    for j, turn in enumerate(turns):
        signs = x @ _directions(x.shape[1], turn, bits) > 0
        out[:, j] = signs @ (1 << np.arange(bits, dtype=np.int64))
    return out


def plan(number: int, sample: list[np.ndarray], limit: float, recall=RECALL, move=MOVE) -> tuple[int, int]:
    """bits and passes with the least work; any plan reaches ``recall``."""
    agree, best = 1 - math.acos(limit) / math.pi, None
    by_dim: dict[int, list] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    pairs = max(len(sample) * (len(sample) - 1), 1)
    for bits in range(40):
        passes = math.ceil(math.log(1 - recall) / math.log1p(-(agree**bits))) if bits else 1
        if passes > MOST_PASSES:
            break
        met = 0.0
        for rows in by_dim.values():
            for code in windows(np.array(rows), range(4), bits).T:
                _, n = np.unique(code, return_counts=True)
                met += float((n * (n - 1)).sum()) / 4
        work = passes * (number * met / pairs + move)
        if best is None or work < best[0]:
            best = (work, bits, passes)
    return best[1:]


def _links(x, y, times_x, times_y, limit: float, past_x=None, past_y=None) -> tuple[np.ndarray, np.ndarray]:
    """For the rows of ``x``, then of ``y``: with how many rows of the other each links, and the least place it is connected to.

    Without ``y`` the rows of ``x`` are compared with each other. ``past_x`` and ``past_y`` hold the rows' windows in earlier
    passes; pairs that shared one are left out.
    """
    axes, own = _axes(x.shape[1]), y is None
    centre = np.median(x @ axes, axis=0)
    if past_x is None:
        past_x, past_y = np.empty((len(x), 0), np.int64), None if own else np.empty((len(y), 0), np.int64)
    sides = [(x, times_x, past_x, 0)] if own else [(x, times_x, past_x, 0), (y, times_y, past_y, len(x))]
    parts = []
    for m, times, past, first in sides:
        order, low, high = _sorted_runs(m, axes, centre)
        past, starts = past[order], np.arange(0, len(m), RUN)
        parts.append((m[order], times[order], first + order, low, high, past, np.minimum.reduceat(past, starts), np.maximum.reduceat(past, starts)))
    (m, tm, pm, low, high, past, p_low, p_high), (o, to, po, o_low, o_high, o_past, o_p_low, o_p_high) = parts[0], parts[-1]
    total = sum(len(s[0]) for s in sides)
    width = _width(m, o, limit)
    look = _look(m, width)
    o_look, least = look if own else _look(o, width), _least(limit, look.shape[1])
    counts, roots = np.zeros(total, np.int64), np.arange(total)
    reach = 2 - 2 * limit + 1e-9
    for i in range(len(low)):
        gap = np.maximum(np.maximum(o_low - high[i], low[i] - o_high), 0.0)
        same = ((p_low[i] == p_high[i]) & (o_p_low == p_low[i]) & (o_p_high == p_low[i])).any(axis=1)  # compared before, as a whole
        r = slice(i * RUN, (i + 1) * RUN)
        for j in np.flatnonzero(((gap * gap).sum(axis=1) <= reach) & ~same):
            if own and j < i:
                continue
            c = slice(j * RUN, (j + 1) * RUN)
            a, b = _places(look[r] @ o_look[c].T >= least)
            if own and i == j:
                a, b = a[a < b], b[a < b]
            near = _near(m[r], o[c], a, b, limit)
            a, b = a[near], b[near]
            for q in range(past.shape[1]):
                new = past[r][a, q] != o_past[c][b, q]
                a, b = a[new], b[new]
            if not len(a):
                continue
            counts[pm[r]] += np.bincount(a, to[c][b], len(pm[r])).astype(np.int64)
            np.add.at(counts, po[c], np.bincount(b, tm[r][a], len(po[c])).astype(np.int64))
            _joined(roots, pm[r][a], po[c][b])
    return counts, roots


def linked(nodes: DataFrame, turns, bits: int, limit: float, block=BLOCK, part=0, parts=1) -> DataFrame:
    """node, head, n: for (node, unit, times), a row per node and task that found links of it in the passes ``turns``.

    Of the pairs of blocks of a window, only those of ``part`` are compared; each is in one of the ``parts``.
    ``n`` adds up over the tasks, parts and passes to the rows that the node links with, its equals not counted; the edges
    (node, head) have the components of the links.
    """

    def deal(batches):
        for b in batches:
            units = b.column(1).to_pylist()
            codes = np.zeros((len(units), len(turns)), np.int64)
            dims = np.array([len(u) // 8 for u in units], np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                codes[at] = windows(np.frombuffer(b"".join([units[i] for i in at]), np.float64).reshape(len(at), -1), turns, bits)
            for j, turn in enumerate(turns):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(units), turn, np.int32)), pa.array(dims), pa.array(codes[:, j])], names=["node", "unit", "times", "turn", "dim", "window"])

    key = ["turn", "dim", "window"]
    dealt = nodes.select("node", "unit", "times")
    if bits:
        dealt = dealt.mapInArrow(deal, "node long, unit binary, times long, turn int, dim long, window long")
    else:
        dealt = dealt.select("*", F.lit(turns[0]).alias("turn"), (F.length("unit") / 8).cast("long").alias("dim"), F.lit(0).cast("long").alias("window"))
    # windows of more than a block: a row for LEAST_BLOCK vectors of a pass at most, so they are broadcast; a join by their
    # key would leave all blocks of a window in one task
    size = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
    blocks = F.greatest(F.ceil(F.col("size") / block), F.least(F.lit(SPREAD), F.ceil(F.col("size") / LEAST_BLOCK)), F.lit(1)).cast("int")
    large = size.select(*key, blocks.alias("blocks")).filter("blocks > 1")
    spread = dealt.join(F.broadcast(large), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *key, "node", "unit", "times", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block"
    )
    spread = spread.filter(F.pmod(F.col("lo") + F.col("hi"), F.lit(parts)) == part)

    def run(group, pdf):
        import pandas as pd

        turn, _, _, lo, hi = group
        out = (np.empty(0, np.int64),) * 3
        sides = [pdf] if lo == hi else [pdf[pdf["block"] == lo], pdf[pdf["block"] == hi]]
        if all(len(s) for s in sides) and len(pdf) > 1:
            rows = [np.frombuffer(b"".join(s["unit"]), np.float64).reshape(len(s), -1) for s in sides]
            times, past = [s["times"].to_numpy() for s in sides], [windows(r, range(turn), bits) for r in rows]
            counts, roots = _links(rows[0], *(rows[1:] or [None]), times[0], *(times[1:] or [None]), limit, past[0], *(past[1:] or [None]))
            names, hit = np.concatenate([s["node"].to_numpy() for s in sides]), counts > 0
            out = names[hit], names[roots[hit]], counts[hit]
        return pd.DataFrame(dict(zip(("node", "head", "n"), out)))

    return spread.groupBy(*key, "lo", "hi").applyInPandas(run, "node long, head long, n long")


def near_duplicates(rows: DataFrame, limit=0.95, block=BLOCK, recall=1.0, move=MOVE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``rows`` (vec_id, embedding).

    All links count; with a ``recall`` below 1, those that hashes find (``move`` is what :func:`plan` takes).
    """
    known = stash(unit_vectors(rows), "vec-units")
    nodes = stash(
        known.filter("node is not null").groupBy("node").agg(F.first("unit").alias("unit"), F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least")),
        "vec-nodes",
    )
    number, bits, passes, parts = nodes.count(), 0, 1, 1
    if recall < 1:
        sample = [np.frombuffer(bytes(r["unit"]), np.float64) for r in nodes.select("node", "unit").orderBy("node").limit(SAMPLE).collect()]
        bits, passes = plan(number, sample, limit, recall, move)
    if not bits:
        parts = max(1, math.ceil(max(number / block, min(SPREAD, number / LEAST_BLOCK)) / COPIES))
    found = None
    for first in range(0, passes, TOGETHER):
        for part in range(parts):
            some = stash(linked(nodes, tuple(range(first, min(first + TOGETHER, passes))), bits, limit, block, part, parts), "vec-links")
            found = some if found is None else found.unionByName(some)
    roots = components(found.select(F.col("node").alias("a"), F.col("head").alias("b")))
    links = found.groupBy("node").agg(F.sum("n").alias("links"))
    named = nodes.select("node", "times", "least").join(roots.toDF("r_node", "root"), F.col("node") == F.col("r_node"), "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "c_root")
    full = (
        named.join(lowest, F.col("root") == F.col("c_root"))
        .join(links.toDF("l_node", "links"), F.col("node") == F.col("l_node"), "left")
        .select(F.col("node").alias("f_node"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    )
    out = known.select("vec_id", "node").join(full, F.col("node") == F.col("f_node"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )


def op9(rows: DataFrame) -> DataFrame:
    return near_duplicates(rows)
