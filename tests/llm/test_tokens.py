"""BPE and token output against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from veilgraph.llm import bpe, codes, units  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    odd = [None, "", " ", "  ", "\n ", "foo\n \nbar", "a　 b", "x\r\n y", "<|endoftext|>", "a<|endoftext|> b", "aaaaaaaaaaaaaaaaa", "日本語 😀😀", "I'm  can't", "z" * 5000]
    return odd + ["".join(rng.choice(" \n\ta'b1é.! 日<|>") for _ in range(rng.randint(1, 40))) for _ in range(400)]


def test_bpe_matches_the_library(docs_of, texts):
    t = units.load(PATH)
    found = {r.doc_id: r for r in bpe.op8(docs_of(list(enumerate(texts))), PATH).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), text
        assert found[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), text


def test_round_trip_and_extra_columns(docs_of):
    from pyspark.sql import functions as F

    docs = docs_of([(1, "one two"), (1, "one two"), (None, None)]).withColumn("ids", F.lit("clash"))
    out = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted((r.text or "", r.vg_text, r.ids) for r in out.collect()) == [("", "", "clash"), ("one two", "one two", "clash"), ("one two", "one two", "clash")]


def test_segment_gives_any_token():
    rng = np.random.default_rng(0)
    ids = [rng.integers(0, 2 ** rng.integers(1, 31), rng.integers(0, 700)).astype(np.uint32) for _ in range(40)]
    s = codes.Segment.parse(codes.Segment.build([None, *range(39)], ids).dump())
    flat = np.concatenate(ids)
    assert (s.ids(0, len(flat)) == flat).all() and (s.ids(513, 2001) == flat[513:2001]).all()
    assert all(s.token(i) == flat[i] for i in range(0, len(flat), 37))


def test_files_hold_every_id_in_order(spark, docs_of, texts):
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    t, start = units.load(PATH), 0
    found = {r.doc_id: r for r in codes.op5(docs_of(rows), PATH).collect()}
    for doc_id, text in sorted(rows):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        r = found[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_random_access_and_small_segments(spark, docs_of, tmp_path):
    out = f"file://{tmp_path}/seg"
    codes.write(docs_of([(5, "one two three"), (2, "four"), (None, "x")]), PATH, out, segment_tokens=2)
    ids = units.load(PATH).encode("one two three").ids
    assert codes.token_at(spark, out, 5, 1) == ids[1] and codes.token_at(spark, out, 5, 9) is None
    assert [r.doc_id for r in codes.read(spark, out).orderBy("start").collect()] == [None, 2, 5]


def test_empty_table(docs_of):
    assert codes.op5(docs_of([]), PATH).count() == 0 and bpe.op8(docs_of([]), PATH).count() == 0


def test_names_that_clash_are_refused(docs_of):
    from pyspark.sql import functions as F

    with pytest.raises(ValueError, match="vg_ids"):
        bpe.encode(docs_of([(1, "x")]).withColumn("VG_ids", F.lit(1)), PATH)
