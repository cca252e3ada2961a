"""Media chunking: exact round trip."""

import hashlib
import zlib

import numpy as np

from veilgraph.llm import media


def slow_cuts(data):
    ends, last, h = [], 0, 0
    for i, b in enumerate(data):
        h = (h * 2 + int(media.GEAR[b])) % 2**32
        size = i + 1 - last
        if len(data) - last > media.LEAST and ((size >= media.LEAST and h % media.MEAN == 0) or size >= media.MOST):
            ends.append(i + 1)
            last = i + 1
    return ends if last == len(data) else [*ends, len(data)]


def test_cuts_match_a_rolling_loop():
    rng = np.random.default_rng(1)
    for n in (1, 64, 1024, 1025, 60_000):
        data = rng.integers(0, 256, n, np.uint8).tobytes()
        assert media.cut_points(data) == slow_cuts(data)
    assert media.cut_points(bytes(50_000))[-1] == 50_000


def test_round_trip(docs_of):
    rng = np.random.default_rng(2)
    shared = "".join(map(chr, rng.integers(97, 123, 30_000)))
    texts = [None, "", "x", "é" * 40, "a" * 64, shared, "before " + shared, shared + " after", shared, "q" * 100_000]
    found = {r.doc_id: r for r in media.op4(docs_of(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest())
        assert r.tail_crc32 == zlib.crc32(pad[-64:]) and r.media_bytes == len(pad) + 44
        assert r.media_sha256 == hashlib.sha256(media.to_wav(pad)).hexdigest() and r.feature == media.feature(pad)


def test_chunks_are_stored_once_and_shared(spark, docs_of):
    rng = np.random.default_rng(3)
    body = "".join(map(chr, rng.integers(97, 123, 50_000)))
    docs = docs_of([(1, body), (2, "new start " + body), (3, body)])
    known = media.recipes(docs)
    store = spark.read.schema(media.STORE).parquet(media.write_store(docs, known)).collect()
    lists = {r.doc_id: [bytes(d) for d in r.vg_chunks] for r in known.collect()}
    assert len(set(lists[1]) & set(lists[2])) > len(lists[1]) // 2
    shared = [bytes(r.digest) for r in store if r.kind == "shared"]
    assert len(shared) == len(set(shared)) and set(shared) == set(lists[1]) & set(lists[2])
    assert len(shared) + sum(len(r.lengths) for r in store if r.kind != "shared") == len(set(lists[1]) | set(lists[2]))


def test_empty_table(docs_of):
    assert media.op4(docs_of([])).count() == 0
