"""Media columns: content-defined chunking, deduplicated and reassembled by Spark joins.

A text's payload is its UTF-8 bytes with bytes 0 up to a positive multiple of 64, and is stored
losslessly as the 8-bit samples of a mono WAV file, the media. A rolling gear hash
over the last 32 bytes cuts the media into chunks where its low bits are 0 (``LEAST`` to ``MOST`` bytes,
about ``MEAN`` beyond the least). Digests alone tell which chunks stand in more than one place; those are stored
once by their owner, the others of a media lie together in one row. A media's recipe is its ordered list of
digests. To read back, shared chunks are joined by digest to the media that hold them, and
the bytes of media without any never move. Every media is verified against its digest.

Defined results: null and empty texts are 64 bytes 0; equal texts share media, chunks and
values; repeated rows have a row each; an empty table gives an empty result;
extra columns pass through :func:`recipes` (the columns added start with ``vg_``; a table that has them already is refused).
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import in_slices, with_room
from .scratch import drop, new_path, stash, writing

UNIT, RATE = 64, 8000
LEAST, MEAN, MOST = 1024, 4096, 16384
#: Chunks remembered by a task so as not to send them twice; forgetting one costs only a row.
REMEMBERED = 100_000
#: Bodies are dealt by digest one portion at a time, so that shuffle files never hold more than that part of all media.
PORTIONS = 4


def gear() -> np.ndarray:
    """A fixed random 32-bit number per byte value."""
    return np.random.default_rng(20240607).integers(0, 2**32, 256, np.uint32)


GEAR = gear()


def cut_points(data: bytes) -> list[int]:
    """The ends of the chunks of ``data``."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # sums over 2, 4, ... 32 bytes, each shifted by its age
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        h = h + shifted
    at = np.flatnonzero((h & np.uint32(MEAN - 1)) == 0) + 1
    ends, last = [], 0
    while n - last > LEAST:
        i = np.searchsorted(at, last + LEAST)
        end = min(int(at[i]) if i < len(at) else n, last + MOST, n)
        ends.append(end)
        last = end
    if last < n:
        ends.append(n)
    return ends


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload and the number of bytes without padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def to_wav(samples: bytes) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def from_wav(media: bytes) -> bytes:
    """The samples of such a file."""
    if media[:4] != b"RIFF" or media[36:40] != b"data":
        raise ValueError("not a WAV file of this store")
    return media[44 : 44 + struct.unpack_from("<I", media, 40)[0]]


def feature(samples: bytes) -> str:
    """Mean, spread, peak and crossings of the middle, from exact integers."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    high = x >= 128
    mean = int(x.sum()) * 1000 // len(x)
    square = int((x * x).sum()) * 1000 // len(x)
    return f"mean={mean};square={square};peak={int(x.max())};crossings={int((high[1:] != high[:-1]).sum())}"


def _chunks(media: bytes):
    last = 0
    for end in cut_points(media):
        part = media[last:end]
        yield hashlib.sha256(part).digest(), part
        last = end


def recipes(docs: DataFrame, text="text") -> DataFrame:
    """``docs`` without ``text``, with vg_n_bytes, vg_media (its digest), vg_media_bytes and vg_chunks."""
    names = [c for c in with_room(docs, "vg_n_bytes", "vg_media", "vg_media_bytes", "vg_chunks") if c != text]

    def run(batches):
        for part, texts in in_slices(batches, text):
            rows = []
            for t in texts:
                payload, n = payload_of(t)
                media = to_wav(payload)
                rows.append((n, hashlib.sha256(media).digest(), len(media), [d for d, _ in _chunks(media)]))
            kept = [part.column(part.schema.get_field_index(c)) for c in names]
            n, digest, size, chunks = zip(*rows)
            cols = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(chunks, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*kept, *cols], names=[*names, "vg_n_bytes", "vg_media", "vg_media_bytes", "vg_chunks"])

    fields = docs.select(*names).schema.fields
    new = [("vg_n_bytes", T.LongType()), ("vg_media", T.BinaryType()), ("vg_media_bytes", T.LongType()), ("vg_chunks", T.ArrayType(T.BinaryType()))]
    return docs.mapInArrow(run, T.StructType([*fields, *[T.StructField(n, t) for n, t in new]]))


def sharing(known: DataFrame) -> DataFrame:
    """media, shared: the places of each media's chunks that stand elsewhere too, as array<struct<place, owned>>.

    A chunk's owner is its least (media, place), and stores it. Digests alone are dealt out here.
    """
    distinct = known.select("vg_media", "vg_chunks").dropDuplicates(["vg_media"])
    refs = stash(distinct.select(F.col("vg_media").alias("media"), F.posexplode("vg_chunks").alias("place", "digest")), "chunk-refs")
    many = refs.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("media", "place")).alias("owner")).filter("n > 1")
    places = refs.join(many.select("digest", "owner"), "digest").select("media", F.struct("place", (F.struct("media", "place") == F.col("owner")).alias("owned")).alias("s"))
    shared = stash(places.groupBy("media").agg(F.array_sort(F.collect_list("s")).alias("shared")), "chunk-shared")
    drop(refs)
    return shared


def bodies(docs: DataFrame, text="text") -> DataFrame:
    """media, body: every distinct media, compressed, about once a task."""

    def run(batches):
        import zstandard

        pack, sent = zstandard.ZstdCompressor(level=9), set()
        for _, texts in in_slices(batches, text):
            rows = []
            for t in texts:
                body = to_wav(payload_of(t)[0])
                media = hashlib.sha256(body).digest()
                if media not in sent:
                    if len(sent) >= REMEMBERED:
                        sent.clear()
                    sent.add(media)
                    rows.append((media, pack.compress(body)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], names=["media", "body"])

    return docs.select(text).mapInArrow(run, "media binary, body binary")


STORE = "media binary, digest binary, lengths array<int>, shared array<int>, data binary, kind string"


def write_store(docs: DataFrame, known: DataFrame, text="text") -> str:
    """Write every distinct chunk once; returns the folder. ``known`` are the recipes.

    Chunks that stand in one place only lie together in a row of kind ``whole`` (a media of nothing
    else) or ``part``, shared ones in a row of kind ``shared`` each.
    """
    spark, shared = docs.sparkSession, sharing(known)
    # Texts that differ in bytes 0 at their end alone may have the same media, so they are of one portion.
    portion = F.pmod(F.xxhash64(F.rtrim(F.coalesce(text, F.lit("")), F.lit("\0"))), F.lit(PORTIONS))

    def run(batches):
        import zstandard

        pack, unpack = zstandard.ZstdCompressor(level=9), zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part, rows = b.slice(i, 256), []
                for media, body, shared in zip(*[part.column(j).to_pylist() for j in range(3)]):
                    if not shared:
                        body_ = unpack.decompress(body)
                        rows.append((media, None, [len(p) for _, p in _chunks(body_)], None, body, "whole"))
                        continue
                    owned = {x["place"]: x["owned"] for x in shared}
                    own, lengths = [], []
                    for place, (digest, piece) in enumerate(_chunks(unpack.decompress(body))):
                        if place not in owned:
                            own.append(piece)
                            lengths.append(len(piece))
                        elif owned[place]:
                            rows.append((None, digest, None, None, pack.compress(piece), "shared"))
                    rows.append((media, None, lengths, sorted(owned), pack.compress(b"".join(own)), "part"))
                kinds = (pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.string())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["media", "digest", "lengths", "shared", "data", "kind"])

    out = new_path(spark, "chunks")
    for k in range(PORTIONS):
        once = bodies(docs.filter(portion == k), text).groupBy("media").agg(F.first("body").alias("body"))
        rows = once.join(shared, "media", "left").select("media", "body", "shared").mapInArrow(run, STORE)
        with writing(spark):
            rows.write.mode("append").option("compression", "none").partitionBy("kind").parquet(out)
    drop(shared)
    return out


READ = "vg_media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _verified(media: bytes, body: bytes) -> tuple:
    digest = hashlib.sha256(body).digest()
    if digest != media:
        raise ValueError(f"media {media.hex()} does not verify: {digest.hex()}")
    samples = from_wav(body)
    return media, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(body), digest.hex(), feature(samples)


def read_back(spark, store: str, known: DataFrame) -> DataFrame:
    """vg_media and, from the media put together again and verified: payload and feature columns."""
    chunks = spark.read.schema(STORE).parquet(store)

    def assemble(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                rows = []
                for media, lengths, data, foreign in zip(*[b.slice(i, 256).column(j).to_pylist() for j in range(4)]):
                    own, at = unpack.decompress(data), 0
                    there = {x["place"]: x["data"] for x in foreign or []}
                    parts = []
                    for place in range(len(lengths) + len(there)):
                        if place in there:
                            parts.append(unpack.decompress(there[place]))
                        else:
                            n = lengths[len(parts) - sum(p < place for p in there)]
                            parts.append(own[at : at + n])
                            at += n
                    rows.append(_verified(media, b"".join(parts)))
                kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in READ.split(", ")])

    none = F.lit(None).cast("array<struct<place:int,data:binary>>").alias("foreign")
    whole = chunks.filter("kind = 'whole'").select("media", "lengths", "data", none)
    part = chunks.filter("kind = 'part'").select("media", "lengths", "data", "shared")
    digests = known.select(F.col("vg_media").alias("media"), "vg_chunks").dropDuplicates(["media"])
    refs = part.select("media", F.explode("shared").alias("place")).join(digests, "media").select("media", "place", F.get("vg_chunks", F.col("place")).alias("digest"))
    shared = chunks.filter("kind = 'shared'").select("digest", F.col("data").alias("piece"))
    foreign = refs.join(shared, "digest").groupBy("media").agg(F.collect_list(F.struct("place", F.col("piece").alias("data"))).alias("foreign"))
    return whole.unionByName(part.drop("shared").join(foreign, "media")).mapInArrow(assemble, READ)


def op4(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    d = docs.select("doc_id", "text")
    known = stash(recipes(d), "recipes")
    store = write_store(d, known)
    found = read_back(spark, store, known)
    slim = known.select("doc_id", F.col("vg_n_bytes").alias("n_bytes"), "vg_media", F.size("vg_chunks").alias("n_chunks"))
    return slim.join(found, "vg_media").drop("vg_media")
