"""Token-id output as directly addressable codes.

Ids are split into chunks of 8 bits. Level 0 holds the low chunk of every id and
a continuation bitmap says which ids have more; level 1 holds the next chunk of
those, and so on. A rank directory counts the set bits before each stretch of
``STRETCH`` bits, so the chunk of a token on the next level is found without
decoding what lies before it. A segment file holds whole documents: a header, the
document table and the levels. Segments are rows of a Parquet table (part, seq,
first_id, last_id, n_docs, n_tokens, payload), in ascending order of doc_id.

Defined results: null and empty texts have the end id alone; documents without an
id come first; rows repeated under an id stand side by side, ordered by a digest of the text; an
empty table gives an empty result; extra columns are not written.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import ENCODED_BYTES, in_slices
from .scratch import new_path
from .units import library_encoder

MAGIC = b"VGDAC1\0\0"
STRETCH = 512
END_ID = 2
#: A segment is closed once it holds so many tokens.
SEGMENT_TOKENS = 1 << 20
SEGMENTS = "part int, seq int, first_id long, last_id long, n_docs long, n_tokens long, payload binary"


class Level:
    """One level: a chunk per entry, the continuation bits and their rank directory."""

    def __init__(self, chunks, bits, ranks):
        self.chunks, self.bits, self.ranks = chunks, bits, ranks

    @classmethod
    def build(cls, values: np.ndarray) -> tuple[Level, np.ndarray]:
        more = values > 255
        pad = np.zeros(-(-max(len(values), 1) // STRETCH) * STRETCH, bool)
        pad[: len(values)] = more
        ones = pad.reshape(-1, STRETCH).sum(1)
        ranks = np.r_[0, np.cumsum(ones)].astype(np.uint32)
        return cls((values & 255).astype(np.uint8), np.packbits(pad, bitorder="little"), ranks), values[more] >> 8

    def goes_on(self, i: int) -> bool:
        return bool(self.bits[i >> 3] >> (i & 7) & 1)

    def rank(self, i: int) -> int:
        """Set bits before ``i``."""
        s = i // STRETCH
        part = np.unpackbits(self.bits[s * STRETCH // 8 : (i + 7) // 8], bitorder="little")
        return int(self.ranks[s]) + int(part[: i - s * STRETCH].sum())


class Segment:
    """Documents' ids under directly addressable codes."""

    def __init__(self, doc_ids, known, starts, levels):
        self.doc_ids, self.known, self.starts, self.levels = doc_ids, known, starts, levels

    @classmethod
    def build(cls, doc_ids: list, ids: list[np.ndarray]) -> Segment:
        starts = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.uint64)
        rest = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        levels = []
        while len(rest) or not levels:
            level, rest = Level.build(rest)
            levels.append(level)
        return cls(np.array([d or 0 for d in doc_ids], np.int64), np.array([d is not None for d in doc_ids], np.uint8), starts, levels)

    def dump(self) -> bytes:
        out = [MAGIC, struct.pack("<QQ", len(self.doc_ids), len(self.levels)), self.doc_ids.tobytes(), self.known.tobytes(), self.starts.tobytes()]
        for x in self.levels:
            out += [struct.pack("<QQQ", len(x.chunks), len(x.bits), len(x.ranks)), x.chunks.tobytes(), x.bits.tobytes(), x.ranks.tobytes()]
        return b"".join(out)

    @classmethod
    def parse(cls, data: bytes) -> Segment:
        if data[:8] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        n, n_levels = struct.unpack_from("<QQ", data, 8)
        at = 24

        def take(kind, count):
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += got.nbytes
            return got

        doc_ids, known, starts = take(np.int64, n), take(np.uint8, n), take(np.uint64, n + 1)
        levels = []
        for _ in range(n_levels):
            a, b, c = struct.unpack_from("<QQQ", data, at)
            at += 24
            levels.append(Level(take(np.uint8, a), take(np.uint8, b), take(np.uint32, c)))
        return cls(doc_ids, known, starts, levels)

    def token(self, i: int) -> int:
        """The id at place ``i`` of the segment, from one chunk per level."""
        value = shift = 0
        for level in self.levels:
            value |= int(level.chunks[i]) << shift
            if not level.goes_on(i):
                break
            i, shift = level.rank(i), shift + 8
        return value

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids at places ``start`` to ``end`` (exclusive)."""
        out = np.zeros(end - start, np.uint32)
        places, lo, hi = np.arange(end - start), start, end
        for depth, level in enumerate(self.levels):
            out[places] |= level.chunks[lo:hi].astype(np.uint32) << np.uint32(8 * depth)
            bits = np.unpackbits(level.bits[lo // 8 : (hi + 7) // 8], bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
            places = places[bits]
            if not len(places):
                break
            lo, hi = level.rank(lo), level.rank(lo) + len(places)
        return out


_encoders: dict = {}


def encoder_of(path: str):
    """One encoder per worker, so that what it remembers serves all of the worker's tasks."""
    if path not in _encoders:
        _encoders[path] = library_encoder(path)
    return _encoders[path]


def write(docs: DataFrame, path: str, out: str, text="text", end_id=END_ID, segment_tokens=SEGMENT_TOKENS) -> None:
    """Encode every text under the tokenizer file ``path`` and write the segments to ``out``."""
    from pyspark import TaskContext

    tie = F.xxhash64(text)
    keyed = docs.select("doc_id", F.col(text).alias("text"), tie.alias("tie"))
    sorted_docs = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches):
        encoder, part, seq = encoder_of(path), TaskContext.get().partitionId(), 0
        doc_ids, ids, held = [], [], 0

        def flush():
            payload = Segment.build(doc_ids, ids).dump()
            ends = (part, pa.int32()), (seq, pa.int32()), (doc_ids[0], pa.int64()), (doc_ids[-1], pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in (*ends, (len(doc_ids), pa.int64()), (held, pa.int64()), (payload, pa.binary()))], names=[f.split()[0] for f in SEGMENTS.split(", ")]
            )

        end = np.array([end_id], np.uint32)
        for slice_, texts in in_slices(batches, "text", ENCODED_BYTES):
            coded, bounds = encoder.encode(texts)
            for doc_id, a, b in zip(slice_.column(0).to_pylist(), bounds[:-1], bounds[1:]):
                doc_ids.append(doc_id)
                ids.append(np.concatenate([coded[a:b], end]))
                held += len(ids[-1])
                if held >= segment_tokens:
                    yield flush()
                    doc_ids, ids, held, seq = [], [], 0, seq + 1
        if doc_ids:
            yield flush()

    rows = sorted_docs.mapInArrow(run, SEGMENTS)
    rows.write.option("compression", "zstd").parquet(out)


def read(spark, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the segments of ``out``."""
    segments = spark.read.parquet(out)
    # sums over the parts, of which there are as many as tasks wrote, then within each
    past = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", past(Window.orderBy("part")).alias("head"))
    within = segments.select("part", "seq", past(Window.partitionBy("part").orderBy("seq")).alias("before"))
    starts = within.join(parts, "part").select("part", "seq", (F.col("head") + F.col("before")).alias("base"))

    def run(batches):
        for batch in batches:
            for part, seq, payload in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                s = Segment.parse(payload)
                bounds = s.starts.astype(np.int64)
                every = s.ids(0, int(bounds[-1])) if len(bounds) > 1 else np.empty(0, np.uint32)
                crc = [zlib.crc32(every[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
                n = len(s.doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, seq), pa.int32()),
                        pa.array(s.doc_ids, pa.int64(), mask=s.known == 0), pa.array(bounds[:-1], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64()),
                    ],
                    names=["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    found = segments.select("part", "seq", "payload").mapInArrow(run, "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_at(spark, out: str, doc_id: int, place: int) -> int | None:
    """One token of one document: reads the payloads of the segments whose range of ids holds it, and decodes one token."""
    here = spark.read.parquet(out).filter(F.lit(doc_id).between(F.col("first_id"), F.col("last_id")) | F.col("first_id").isNull())

    def find(batches):
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                s = Segment.parse(payload)
                for i in np.flatnonzero((s.doc_ids == doc_id) & (s.known == 1))[:1]:
                    at = int(s.starts[i]) + place
                    if at < int(s.starts[i + 1]):
                        yield pa.RecordBatch.from_arrays([pa.array([s.token(at)], pa.int64())], names=["id"])

    got = here.select("payload").mapInArrow(find, "id long").head()
    return got["id"] if got else None


def op5(docs: DataFrame, path: str) -> DataFrame:
    spark = docs.sparkSession
    out = new_path(spark, "dac")
    write(docs.select("doc_id", "text"), path, out)
    return read(spark, out)
