"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are words, lower-cased and cut to their first ``PREFIX`` characters. Each label gives up to
``EXAMPLES_PER_CLASS`` examples (lowest digests of distinct texts), and all terms of theirs are the vocabulary. A term
weighs ``(1 + log count) * idf * (FLOOR + telling)``: inverse document frequencies are counted over all
documents, and ``telling``, up to 1, is the square of the term's log-likelihood ratio against the labels (G2 over ``SURE``), so that words
that say nothing about the label still tell documents apart, but faintly. The unit vectors of the examples are
held in an inverted index whose postings, in blocks, carry the greatest weight within. A
document's ``NEIGHBOURS`` nearest examples are exact: blocks are passed over only where their
bounds cannot reach the least cosine kept. Votes are weighted by ``cosine^2 / (1 + EPS - cosine)``
against a constant ``DOUBT``, and by class, so that they stand for the label table and not for the sample; the share of toxic votes is calibrated by
a monotone fit to the leave-one-out shares of the examples. Labels, languages, sources and
ids are no input of a score: equal texts have equal scores.

Defined results: null and empty texts, and texts with no term of the vocabulary, score
as the share of toxic labels, as do all texts where there are no labels of both classes (0 without labels);
ties in cosine go to the lower example number; labels repeated
under an id count as toxic if any is; repeated rows are each scored; an empty table gives an
empty result; extra columns pass through (the columns added are ``vg_score`` and ``vg_evidence``; a table that
has them already is refused).
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import in_slices
from .scratch import stash
from .units import ranges

PREFIX, EXAMPLES_PER_CLASS, NEIGHBOURS, EPS, DOUBT, BLOCK = 5, 2000, 15, 0.05, 0.5, 64
SURE, FLOOR, COMMON = 40.0, 0.005, 0.2
EVIDENCE = T.ArrayType(T.StructType().add("doc_id", "long").add("cosine", "double").add("label", "integer"))
SPLIT_WORDS = re.compile(r"[^\W_]+")
#: Marks that stand around words.
MARKS = ".,;:!?\"'()[]{}|*_-"
#: Terms of a slice of the document frequencies.
SLICE = 1 << 14


def slice_terms(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Terms of the slice, the number of the term of each word of all texts, and where each text's words begin, with the end.

    Terms may be repeated. The distinct runs without ASCII white space are taken apart: most are a word and marks around it.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(pa.array(texts, pa.large_string()), ""))
    flat = split.flatten().dictionary_encode()
    runs, codes, bounds = pc.utf8_lower(flat.dictionary), flat.indices.to_numpy(), split.offsets.to_numpy()
    core = pc.utf8_trim(runs, characters=MARKS)
    plain = pc.utf8_is_alnum(core).to_numpy(zero_copy_only=False)
    odd = np.flatnonzero(~plain)
    found = [SPLIT_WORDS.findall(x) for x in runs.take(pa.array(odd)).to_pylist()]
    n = plain.astype(np.int64)
    n[odd] = [len(f) for f in found]
    begins = np.empty(len(n), np.int64)
    begins[plain] = np.arange(int(plain.sum()))
    begins[odd] = int(plain.sum()) + np.cumsum(n[odd]) - n[odd]
    words = pa.concat_arrays([core.filter(pa.array(plain)), pa.array([w for f in found for w in f], core.type)])
    ends = np.r_[0, np.cumsum(n[codes])]
    return pc.utf8_slice_codeunits(words, 0, PREFIX), ranges(begins[codes], n[codes]), ends[bounds]


def counted(ids: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids (ascending) of each text and their counts, one after the other, and where each text's begin, with the end; ids below 0 do not count."""
    key = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * size + ids
    key, counts = np.unique(key[ids >= 0], return_counts=True)
    return key % size, counts, np.searchsorted(key // size, np.arange(len(bounds)))


class Counter:
    """Counts the vocabulary's terms in texts."""

    def __init__(self, vocabulary: list[str]):
        self.size, self.terms = len(vocabulary), pa.array(vocabulary, pa.large_string())

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        terms, words, bounds = slice_terms(texts)
        ids = pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return counted(ids[words], bounds, max(self.size, 1))


def labelled(docs: DataFrame, labels: DataFrame, per_class=EXAMPLES_PER_CLASS) -> tuple[DataFrame, dict[int, float]]:
    """The examples (doc_id, text, label), of distinct texts within a label, and how many labelled rows stand behind each, by label.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    count = {int(r["label"]): r["count"] for r in known.groupBy("label").count().collect()}
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("vg_text", F.xxhash64("text"))
    distinct = texts.select("doc_id", "vg_text").join(known, "doc_id").groupBy("label", "vg_text").agg(F.min("doc_id").alias("doc_id"))
    ids = None
    for label in sorted(count):
        some = distinct.filter(F.col("label") == label).orderBy("vg_text", "doc_id").limit(per_class)
        ids = some if ids is None else ids.union(some)
    if ids is None:
        return docs.select("doc_id", "text", F.lit(0).alias("label")).limit(0), {}
    chosen = texts.join(F.broadcast(ids), ["doc_id", "vg_text"]).dropDuplicates(["label", "vg_text"])
    return chosen.select("doc_id", "text", "label"), {k: float(n) for k, n in count.items()}


def example_terms(examples: DataFrame) -> DataFrame:
    """doc_id, label, terms, counts of the examples."""

    def run(batches):
        for b, texts in in_slices(batches, "text"):
            terms, words, bounds = slice_terms(texts)
            terms = terms.dictionary_encode()
            ids, counts, ends = counted(terms.indices.to_numpy().astype(np.int64)[words], bounds, max(len(terms.dictionary), 1))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (terms.dictionary.take(pa.array(ids)).cast(pa.string()), pa.array(counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *lists], names=["doc_id", "label", "terms", "counts"])

    return examples.select("doc_id", "text", F.col("label").cast("long")).mapInArrow(run, "doc_id long, label long, terms array<string>, counts array<long>")


def telling(has: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each term, from how many examples of each label have it (terms x 2) out of ``n``: (G2 / SURE)^2, 1 at most."""
    part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(e, 1e-300)), 0.0)
    rate = has.sum(1, keepdims=True) / n.sum()
    g2 = 2 * (part(has, rate * n) + part(n - has, (1 - rate) * n)).sum(1)
    return np.minimum(np.maximum(g2, 0) / SURE, 1.0) ** 2


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, int]:
    """In how many rows of ``docs`` (text) each term stands, and how many rows there are.

    Every task sends its counts in packed slices, so what is shuffled hangs on tasks and on the vocabulary, which the
    sample bounds.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        counter, total, rows = Counter(sent.value), np.zeros(len(sent.value), np.uint32), 0
        for _, texts in in_slices(batches, "text"):
            rows += len(texts)
            total += np.bincount(counter(texts)[0], minlength=len(total)).astype(np.uint32)
        parts = [(-1, np.uint32(rows).tobytes())] + [(i, total[i : i + SLICE].tobytes()) for i in range(0, len(total), SLICE) if total[i : i + SLICE].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([zlib.compress(x, 1) for _, x in parts], pa.binary())], names=["part", "counts"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for part, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.int64)
                held[part] = held[part] + x if part in held else x
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["part", "counts"])

    kinds, df, rows = "part int, counts binary", np.zeros(len(vocabulary), np.int64), 0
    for r in docs.select("text").mapInArrow(count, kinds).repartition("part").mapInArrow(add, kinds).collect():
        x = np.frombuffer(bytes(r["counts"]), np.int64)
        if r["part"] < 0:
            rows = int(x[0])
        else:
            df[r["part"] : r["part"] + len(x)] = x
    return df, rows


@dataclass
class Index:
    """Inverted lists of unit vectors: a term's cells, one for each block of ``BLOCK`` examples that have it, with the
    greatest weight within, and each cell's postings. The lists of terms that ``COMMON`` of the examples have are rows of a matrix."""

    labels: np.ndarray
    ids: np.ndarray
    n_blocks: int
    cells: np.ndarray  # where a term's cells begin, with the end
    blocks: np.ndarray
    greatest: np.ndarray
    starts: np.ndarray  # where a cell's postings begin, with the end
    examples: np.ndarray
    weights: np.ndarray
    row: np.ndarray  # a common term's row of the matrix, else -1
    matrix: np.ndarray
    votes: np.ndarray = field(default_factory=lambda: np.ones(2))

    @classmethod
    def build(cls, vectors, labels, ids, n_terms: int) -> Index:
        rows = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors]).astype(np.int32)
        terms = np.concatenate([t for t, _ in vectors] + [np.empty(0, np.int64)]).astype(np.int64)
        weights = np.concatenate([w for _, w in vectors] + [np.empty(0)])
        n_blocks = max(1, -(-len(vectors) // BLOCK))
        common = np.flatnonzero(np.bincount(terms, minlength=n_terms) > COMMON * len(vectors))
        row = np.full(n_terms, -1, np.int64)
        row[common] = np.arange(len(common))
        matrix, dense = np.zeros((len(common), n_blocks * BLOCK)), row[terms] >= 0
        matrix[row[terms[dense]], rows[dense]] = weights[dense]
        rows, terms, weights = rows[~dense], terms[~dense], weights[~dense]
        order = np.lexsort((rows, terms))
        rows, terms, weights = rows[order], terms[order], weights[order]
        cell = terms * n_blocks + rows // BLOCK
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)
        greatest = np.maximum.reduceat(weights, starts) if len(cell) else np.empty(0)
        at = np.searchsorted(cell[starts] // n_blocks, np.arange(n_terms + 1))
        return cls(
            np.asarray(labels), np.asarray(ids), n_blocks, at, (cell[starts] % n_blocks).astype(np.int32), greatest, np.r_[starts, len(cell)], rows, weights, row, matrix
        )

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of the greatest positive cosine, exactly; ``skip`` is left out."""
        row = self.row[terms]
        dense, size = row >= 0, len(self.labels)
        score = weights[dense] @ self.matrix[row[dense]]
        terms, weights = terms[~dense], weights[~dense]
        n = self.cells[terms + 1] - self.cells[terms]
        cells, q = ranges(self.cells[terms], n), np.repeat(weights, n)
        blocks = self.blocks[cells]
        bound = score.reshape(-1, BLOCK).max(axis=1) + np.bincount(blocks, q * self.greatest[cells], self.n_blocks)

        def opened(which: np.ndarray) -> float:
            """Completes the scores of the examples of these blocks; returns the ``k``-th best score so far, or 0."""
            shut[which] = False
            mask = np.zeros(self.n_blocks, bool)
            mask[which] = True
            take = mask[blocks]
            c = cells[take]
            m = self.starts[c + 1] - self.starts[c]
            p = ranges(self.starts[c], m)
            score[:] += np.bincount(self.examples[p], np.repeat(q[take], m) * self.weights[p], len(score))
            if skip >= 0:
                score[skip] = 0
            done = score.reshape(-1, BLOCK)[~shut].ravel()
            return float(np.partition(done, -k)[-k]) if len(done) >= k else 0.0

        shut = np.ones(self.n_blocks, bool)
        least = opened(np.argsort(-bound, kind="stable")[:4])
        rest = np.flatnonzero(shut & (bound >= least - 1e-9))
        if len(rest):
            least = opened(rest)
        score.reshape(-1, BLOCK)[shut] = 0
        found = np.flatnonzero((score[:size] > 0) & (score[:size] >= least - 1e-9))
        top = found[np.lexsort((found, -np.round(score[found], 12)))[:k]]
        return np.minimum(score[top], 1.0), top

    def share(self, cosines: np.ndarray, rows: np.ndarray) -> float:
        w = self.votes[self.labels[rows]] * cosines**2 / (1 + EPS - cosines)
        # far neighbours alone do not outvote the doubt
        return float(w[self.labels[rows] == 1].sum() / (w.sum() + DOUBT * self.votes[1]))


def monotone(shares: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: upper ends of the shares' ranges (midway to the next range) and the share of toxic rows in each."""
    order = np.argsort(shares, kind="stable")
    pools: list[list[float]] = []  # toxic weight, weight, least share, greatest share
    for s, y, w in zip(shares[order], labels[order], weights[order]):
        if pools and pools[-1][3] == s:
            pools[-1][0] += w * y
            pools[-1][1] += w
        else:
            pools.append([w * y, w, s, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [pools[-1][0] + top[0], pools[-1][1] + top[1], pools[-1][2], top[3]]
    ends = np.array([(p[3] + q[2]) / 2 for p, q in zip(pools, pools[1:])] + [p[3] for p in pools[-1:]])
    rates = np.array([(p[0] + 0.05) / (p[1] + 0.1) for p in pools])
    return ends, np.maximum.accumulate(rates)


class Model:
    """What :func:`fit` learns; the sample bounds its size (some tens of MB), so it is sent to every worker."""

    def __init__(self, vocabulary, worth, index, ends, rates, rate, k):
        self.vocabulary, self.worth, self.index, self.ends, self.rates, self.rate, self.k = vocabulary, worth, index, ends, rates, rate, k

    def vector(self, terms, counts):
        w = (1 + np.log(counts)) * self.worth[terms]
        norm = math.sqrt(float(w @ w))
        return w / norm if norm else w

    def score(self, terms, counts):
        """score, ids, cosines and labels of the evidence."""
        if self.index is None or not len(terms):
            return self.rate, (), (), ()
        c, i = self.index.nearest(terms, self.vector(terms, counts), self.k)
        if not len(i):
            return self.rate, (), (), ()
        s = self.index.share(c, i)
        at = min(int(np.searchsorted(self.ends, s)), len(self.rates) - 1)
        lo, hi = (self.rates[at - 1], self.rates[at]) if at else (self.rates[0], self.rates[0])
        # within a range the share itself still orders documents
        return float(np.clip(hi - 1e-3 * (1 - s), min(lo, hi), hi)), self.index.ids[i], c, self.index.labels[i]


def fit(docs: DataFrame, labels: DataFrame, per_class=EXAMPLES_PER_CLASS, k=NEIGHBOURS) -> Model:
    """The model of ``docs`` (doc_id, text)."""
    examples, behind = labelled(docs, labels, per_class)
    total = sum(behind.values())
    rate = behind.get(1, 0.0) / total if total else 0.0
    nothing = Model([], np.empty(0), None, np.empty(0), np.empty(0), rate, k)
    if len(behind) < 2:
        return nothing
    own = stash(example_terms(examples), "tox-examples").toArrow()
    ys, ids, flat = own["label"].to_numpy(), own["doc_id"].to_numpy(), pc.list_flatten(own["terms"]).combine_chunks().dictionary_encode()
    if not len(flat) or len(set(ys.tolist())) < 2:
        return nothing
    vocabulary = flat.dictionary.to_pylist()
    terms, counts = flat.indices.to_numpy().astype(np.int64), pc.list_flatten(own["counts"]).to_numpy()
    sizes = pc.list_value_length(own["terms"]).to_numpy()
    n = np.bincount(ys, minlength=2).astype(float)
    has = np.stack([np.bincount(terms, np.repeat(ys == y, sizes), len(vocabulary)) for y in (0, 1)], axis=1)
    df, n_docs = document_frequencies(docs, vocabulary)
    worth = (np.log((n_docs + 1) / (df + 1)) + 1) * (FLOOR + telling(has, n))
    model = Model(vocabulary, worth, None, np.empty(0), np.empty(0), rate, k)
    ends = np.cumsum(sizes)
    vectors = []
    for a, b in zip(ends - sizes, ends):
        order = np.argsort(terms[a:b])
        t = terms[a:b][order]
        vectors.append((t, model.vector(t, counts[a:b][order])))
    # examples with the same strongest term lie together, so that the blocks' bounds are tight
    strongest = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
    order = np.lexsort((ids, strongest, ys))
    vectors, ys, ids = [vectors[i] for i in order], ys[order], ids[order]
    index = Index.build(vectors, ys, ids, len(vocabulary))
    each = np.array([behind.get(y, 0.0) for y in (0, 1)]) / n  # rows that an example stands for
    index.votes = each / each.max()
    shares, kept = [], []
    for i, (t, w) in enumerate(vectors):
        c, rows = index.nearest(t, w, k, skip=i)
        if len(rows):
            shares.append(index.share(c, rows))
            kept.append(i)
    if kept:
        model.index = index
        model.ends, model.rates = monotone(np.asarray(shares), ys[kept], each[ys[kept]])
    return model


def _slices(docs: DataFrame, model: Model):
    """A function for mapInArrow's batches: (slice, model, terms, counts, bounds)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches, text):
        m = sent.value
        counter = Counter(m.vocabulary)
        for part, texts in in_slices(batches, text):
            terms, counts, bounds = counter(texts)
            yield part, [m.score(terms[a:b], counts[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]

    return each


def _plain(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", F.col(text).alias("text"))


def score(docs: DataFrame, labels: DataFrame, text="text", **rules) -> DataFrame:
    """``docs`` without ``text``, with vg_score and vg_evidence, its nearest examples."""
    taken = {"vg_score", "vg_evidence"} & set(docs.columns)
    if taken:
        raise ValueError(f"the table has columns of the result's names: {sorted(taken)}")
    each = _slices(docs, fit(_plain(docs, text), labels, **rules))
    names = [c for c in docs.columns if c != text]

    def run(batches):
        for part, found in each(batches, text):
            evidence = [[{"doc_id": int(a), "cosine": float(b), "label": int(c)} for a, b, c in zip(*f[1:])][:3] for f in found]
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
            kept = [part.column(part.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([f[0] for f in found], pa.float64()), pa.array(evidence, kind)], names=[*names, "vg_score", "vg_evidence"])

    return docs.mapInArrow(run, T.StructType([*docs.select(*names).schema.fields, T.StructField("vg_score", T.DoubleType()), T.StructField("vg_evidence", EVIDENCE)]))


def keep_harmless(docs: DataFrame, labels: DataFrame, limit=0.5, text="text", **rules) -> DataFrame:
    """The documents whose score is below ``limit``, with the columns of ``docs`` alone."""
    each = _slices(docs, fit(_plain(docs, text), labels, **rules))

    def run(batches):
        for part, found in each(batches, text):
            yield part.filter(pa.array([f[0] < limit for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs.select("doc_id", "text"), labels)
    return found.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        F.col("vg_score").alias("score"),
        (F.col("vg_score") >= 0.5).cast("int").alias("predicted"),
        F.to_json("vg_evidence").alias("evidence"),
    )
