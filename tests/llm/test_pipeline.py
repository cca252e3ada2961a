"""The pipeline's stages on a fixture where the right rows are known."""

import gc
import random
import time

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as cp  # noqa: E402
from veilgraph.llm import units  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, docs_of, tmp_path_factory):
    rng = random.Random(7)
    vocab = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, labels = [], []
    for i in range(240):
        w = prose(40)
        if i % 4 == 0:
            w[5:5] = ["vilecur", "rottenoaf"]
            w[20:20] = [rng.choice(["vilecur", "rottenoaf"])]
        rows.append((i, " ".join(w), f"src{i % 3}"))
        labels.append((i, 1, int(i % 4 == 0)))
    base = prose(80)
    rows += [(1000 + k, " ".join([*base[:-1], vocab[k]]), "src1") for k in range(6)]
    rows += [(2000, "Write to a.b@mail.org now " + " ".join(prose(30)), None), (2001, None, "src0"), (2002, "", "src0")]
    d = tmp_path_factory.mktemp("corpus")
    docs_of(rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows


def test_stages(spark, corpus):
    d, rows = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = cp.stash(cp.reject_toxic(spark, docs, d), "t")
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids == {i for i, *_ in rows if i >= 240 or i % 4}
    one = cp.stash(cp.merge_near_copies(spark, kept, d), "t")
    ids -= set(range(1001, 1006))
    assert {r.doc_id for r in one.select("doc_id").collect()} == ids
    clean = cp.stash(cp.sanitise(spark, one, d), "t")
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert set(texts) == ids and texts[2000].startswith("Write to [EMAIL] now ") and texts[2001] is None
    assert all(texts[i] == t for i, t, _ in rows if i in texts and i != 2000)
    mixed = cp.stash(cp.mix_sources(spark, clean, d), "t")
    assert mixed.columns == cp.COLUMNS and {r.doc_id for r in mixed.select("doc_id").collect()} <= ids
    assert mixed.count() > len(ids)
    t = units.load(cp.tokenizer_path())
    for r in cp.encode(spark, mixed, d).limit(50).collect():
        assert list(r.ids) == t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run(spark, corpus):
    assert cp.run(spark, corpus[0]).count() > 200


def test_nulls_repeats_and_long_texts_in_every_stage(spark, tmp_path):
    long = " ".join(f"w{i % 977} x{i}" for i in range(120_000))
    rows = [
        (None, None, None, None, None), (None, "an id is missing here", "en", "s", 5), (1, None, "en", None, None), (1, None, "en", None, None), (2, "", None, "s", 0),
        (3, long, "en", "s", len(long)), (4, long + " tail", "en", "s", None), (5, "twice the same row", "en", "s", 1), (5, "twice the same row", "en", "s", 1), (6, "mail a.b@c.org", "en", None, 1),
    ]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None, 1), (5, 1, None), (6, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = cp.stash(cp.reject_toxic(spark, docs, str(tmp_path)), "t")
    assert kept.count() == len(rows)  # without labels of both kinds nothing is toxic
    one = cp.stash(cp.merge_near_copies(spark, kept, str(tmp_path)), "t")
    assert sorted((r.doc_id or 0) for r in one.collect()) == [0, 0, 1, 1, 2, 3, 5, 5, 6]
    clean = cp.stash(cp.sanitise(spark, one, str(tmp_path)), "t")
    assert {r.text for r in clean.filter("doc_id = 6").collect()} == {"mail [EMAIL]"} and clean.count() == 9
    mixed = cp.stash(cp.mix_sources(spark, clean, str(tmp_path)), "t")
    assert mixed.columns == cp.COLUMNS
    assert {r.n_tokens for r in cp.encode(spark, one.filter("doc_id in (1, 2)"), str(tmp_path)).collect()} == {0}
    assert cp.run(spark, str(tmp_path)).columns == ["doc_id", "source", "n_tokens", "ids"]


def test_heap_is_handed_back_before_bpe(spark, corpus):
    docs, jvm = spark.read.parquet(f"{corpus[0]}/documents.parquet"), spark._jvm.java.lang.Runtime.getRuntime()
    large = spark.sparkContext._gateway.new_array(spark._jvm.long, 60 << 20)  # 480 MB
    used, grown = jvm.totalMemory() - jvm.freeMemory(), jvm.totalMemory()
    assert used > 480e6
    del large
    gc.collect()
    time.sleep(1)  # Python tells the JVM from a thread of its own
    cp.encode(spark, docs, corpus[0])
    assert jvm.totalMemory() - jvm.freeMemory() < used - 400e6 and jvm.totalMemory() < grown


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_each_stage_hands_the_heap_back_first(spark, corpus, monkeypatch, name):
    class Begun(Exception):
        pass

    def give_back(_):
        raise Begun

    monkeypatch.setattr(cp, "give_back", give_back)
    with pytest.raises(Begun):
        dict(cp.STAGES)[name](spark, spark.read.parquet(f"{corpus[0]}/documents.parquet"), corpus[0])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
