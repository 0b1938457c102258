import hashlib
import os
import random

import corpus_pipeline
import pytest

from peerlens.llm import bpe, decontam
from tests.llm.test_minhash import brute as groups
from tests.llm.test_substrings import brute as repeats


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    item = " ".join(rng.choices(words, k=25))
    passage = " ".join(rng.choices(words, k=60))
    docs, labels = [], []
    for i in range(160):
        own = rng.choices(words, k=rng.randrange(30, 200))
        toxic = i % 5 == 0
        if toxic:
            for k in range(0, len(own), 8):
                own[k] = rng.choice(["moronic", "hateful", "scummy"])
        text = " ".join(own)
        if i % 20 == 3:
            text += " " + item
        if i % 20 in (7, 9):
            text += "\n" + passage
        docs.append([i, text, "en", f"s{i % 3}", len(text)])
        labels.append((i, 1, int(toxic)))
    for k, i in enumerate((11, 12, 13)):
        near = docs[i][1].split(" ")
        near[5] = "changed"
        docs.append([200 + k, " ".join(near), "en", "s1", 0])
        docs.append([300 + k, docs[i][1], "en", "s1", 0])
    docs += [[400, None, None, None, None], [401, "", "en", "s0", 0], [None, "no id here", "en", "s0", 10]]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), docs, item


def test_stages_and_result(spark, folder):
    out, docs, item = folder
    got = sorted(((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, out).collect()), key=str)
    left = [(d[0], d[1]) for d in docs if d[0] is None or d[0] % 5 or d[0] >= 160]
    with_id = [r for r in left if r[0] is not None]
    group = groups(with_id)
    left = [r for r in left if r[0] is None or group[r[0]][1] == r[0]]
    ordered = [(-1 if i is None else i, t) for i, t in left]
    kept = repeats(ordered, texts=True)
    windows = decontam.windows_of(decontam.words_of(item))
    clean = {i: t for i, t in kept.items() if not any(w in b" ".join(decontam.words_of(t)) for w in windows)}
    assert 3 not in clean and 0 < len(clean) < len(kept)
    assert sorted((-1 if i is None else i, s) for i, _, s in got) == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in clean.items())


def test_columns_of_stages(spark, folder):
    out, _, _ = folder
    d = spark.read.parquet(f"{out}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, out).columns == d.columns, name
    assert len(corpus_pipeline.STAGES) == 5


def test_extra_columns_with_clashing_names(spark, folder):
    """Each stage but the last returns the columns of its input, whatever they are called, with their values."""
    out, _, _ = folder
    d = spark.read.parquet(f"{out}/documents.parquet").where("doc_id < 60 or doc_id >= 200")
    names = ["_key", "_mark", "ranges", "set_key", "bands", "component", "component_id", "score", "passages", "runs", "items", "_hash", "rep", "toxic", "fold", "_n", "h", "key"]
    d = d.select("*", *[(d.doc_id * 10 + i).alias(n) for i, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, d, out)
        assert got.columns == d.columns, name
        for r in got.collect():
            assert r.doc_id is None or [r[n] for n in names] == [r.doc_id * 10 + i for i in range(len(names))], name


def test_empty_documents(spark, folder):
    out, _, _ = folder
    d = spark.read.parquet(f"{out}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, out).count() == 0


def test_last_stage_decodes(spark):
    d = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, ids string")
    (r,) = corpus_pipeline.encode(spark, d, "").collect()
    assert r.decoded_sha256 == hashlib.sha256(b"a b").hexdigest()
    assert bpe.round_trip(d).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_release_drops_what_was_made(spark):
    from peerlens.llm import common

    common.release(spark)
    first = common.written(spark.range(2), "first")
    kept = common.written(spark.range(3), "kept")
    common.release(spark, keep=kept)
    assert kept.count() == 3 and len(common._made) == 1 and not os.path.exists(first.inputFiles()[0].removeprefix("file://"))
    table = common.bucketed(spark.range(3).withColumnRenamed("id", "doc_id"), "doc_id")
    assert kept.count() == table.count() == 3
    path = kept.inputFiles()[0].removeprefix("file://")
    common.release(spark)
    assert not os.path.exists(path) and not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]
