"""The classifier and the pipeline's stages against plain versions."""

import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

import corpus_pipeline
from edge import documents, texts
from joeira.llm import quality
from joeira.llm.queries import MIX_DEFAULT, MIX_WEIGHTS, QUERIES
from test_near_copies import plain_fingerprint, plain_repeats, union
from test_mixing import plain_schedule

SF_DIR = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data here")


def test_passages_of_a_batch_do_not_depend_on_their_neighbours():
    many = [(t or "").encode() for _, t in texts()]
    x, n_of = quality.passage_vectors(many)
    alone = [quality.passage_vectors([t])[0] for t in many]
    assert n_of.tolist() == [len(a) for a in alone] == [max(1, -(-len(t) // quality.PASSAGE)) for t in many]
    assert np.allclose(x, np.concatenate(alone)) and np.isfinite(x).all()


def test_gradient():
    rnd = np.random.default_rng(1)
    texts_ = [bytes(rnd.choice(list(b"abAB !.\n"), 700).tolist()) for _ in range(30)]
    x, n_of = quality.passage_vectors(texts_)
    y = (np.arange(30) % 2).astype(float)
    model = quality.fit(x, n_of, y)
    loss = -np.log(np.where(y == 1, p := model.forward(x.astype(float), n_of)["p"], 1 - p)).mean()
    assert loss < 0.5 < np.log(2)  # the fit has learned something from labels that are noise


def test_fit_without_two_kinds_of_labels():
    x, n_of = quality.passage_vectors([b"a", b"b"])
    assert quality.fit(x, n_of, np.array([1.0, 1.0])).score([b"c"]).tolist() == [1.0]
    assert quality.fit(x[:0], n_of[:0], np.array([])).score([b"c"]).tolist() == [0.5]


def test_classifier_on_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (12, 0), (14, 1), (7, None), (None, 1), (9, 1), (13, 0), (99, 1)], "doc_id bigint, quality int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_long_texts_are_learned_from(spark):
    assert quality.chosen(5, 8).tolist() == list(range(5))
    some = quality.chosen(1000, 64)
    assert len(set(some.tolist())) == 64 and some.min() < 50 and some.max() > 950
    good, bad = "Plain words make a sentence. " * 3000, "XQ!! 99 $$ " * 8000  # both far beyond 64 passages
    docs = spark.createDataFrame([(i, (bad, good)[i % 2]) for i in range(40)] * 2, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == 80 and all(r.predicted == r.doc_id % 2 for r in out)


@needs_data
def test_held_out_accuracy(spark):
    out = QUERIES["op5_quality"](spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(out) > 80 and np.mean([r.predicted == r.quality for r in out]) > 0.97


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return {name: (before.collect(), after.collect(), before.columns, after.columns) for name, before, after in out}


@needs_data
def test_every_stage_against_a_plain_version(spark, stages):
    assert all(before == after == ["doc_id", "text", "lang", "source", "n_chars"] for n, (_, _, before, after) in stages.items() if n != "pieces")

    before, after, *_ = stages["quality"]
    scores = {r.doc_id: r.score for r in QUERIES["op5_quality"](spark, SF_DIR).collect()}
    assert {r.doc_id for r in after} == {r.doc_id for r in before if scores[r.doc_id] >= 0.5}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    assert np.mean([scores[i] >= 0.5 for i, q in labels.items() if q == 1]) > 0.99

    # Near copies: fingerprints of three-word shingles at most two bits apart, and what they link.
    before, after, *_ = stages["simhash"]
    fps = [(r.doc_id, plain_fingerprint(r.text)) for r in before]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i][1] ^ fps[j][1]).bit_count() <= 2]
    low = union(len(fps), links)
    first = {}
    for (i, _), group in zip(fps, low):
        first[group] = min(first.get(group, i), i)
    assert sorted(r.doc_id for r in after) == sorted(first.values()) and len(after) < len(before)

    before, after, *_ = stages["repeats"]
    want = {i: (n, sha) for i, _, n, _, sha in plain_repeats([(r.doc_id, r.text) for r in before])}
    by_id = {r.doc_id: r for r in after}
    for r in before:
        n = want[r.doc_id][0]
        if n and n == len(r.text.encode()):
            assert r.doc_id not in by_id
        else:
            left = by_id[r.doc_id]
            assert left.text == r.text if n == 0 else len(left.text) == left.n_chars < len(r.text)

    before, after, *_ = stages["mixing"]
    assert sorted(before) == sorted(after)
    sources = sorted({r.source for r in before})
    weights = [MIX_WEIGHTS.get(s, MIX_DEFAULT) for s in sources]
    left = {s: sorted(r.doc_id for r in before if r.source == s) for s in sources}
    order = []
    while any(left.values()):
        for i in plain_schedule(weights):
            s = sources[i]
            order += left[s][:16]
            left[s] = left[s][16:]
    assert [r.doc_id for r in after] == order

    before, after, *_ = stages["pieces"]
    lib = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = {r.doc_id: list(r.ids) for r in after}
    assert ids == {r.doc_id: lib.encode(r.text) for r in before} and all(r.round_trip for r in after)


def test_stages_on_awkward_rows(spark, tmp_path):
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, 1), (12, 0), (14, 1), (9, 1), (13, 0)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        n = out.count()
        assert 0 < n <= docs.count() and (name == "pieces" or out.columns == docs.columns)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).where(F.col("n_pieces") > 0).count() > 0


def test_stages_keep_columns_called_like_their_own(spark, tmp_path):
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    mine = ("position", "slot", "block", "release", "_uid", "_rank", "_part", "_score", "n_removed", "n_bytes", "kept", "row", "uid", "component_id", "fingerprint")
    # One value to each row: what a stage keeps of it has to stay beside its document.
    docs = docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))) for c in mine})
    spark.createDataFrame([(1, 1), (12, 0), (14, 1), (9, 1), (13, 0)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == c + (r["source"] or "") + (r["lang"] or "") for r in rows for c in mine)
