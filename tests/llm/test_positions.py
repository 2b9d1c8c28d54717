"""The order of the mixture in what the pipeline returns."""

import random

import corpus_pipeline
from joeira.llm.mixing import mix
from joeira.llm.queries import MIX_BLOCK, MIX_DEFAULT, MIX_WEIGHTS


def test_pieces_have_the_place_of_their_document_in_the_mixture(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, "word " * rnd.choice((1, 5, 200)), "en", f"src{i * i % 5}", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = {r.doc_id: r.position for r in mix(docs, MIX_WEIGHTS, MIX_DEFAULT, block_rows=MIX_BLOCK).collect()}
    # Files of 7 rows, and parts that are cut: read back, their order is not that of the rows.
    with_files = corpus_pipeline.mixing(spark, docs, "")
    with_files.write.option("maxRecordsPerFile", 7).parquet(f"{tmp_path}/mixed")
    back = spark.read.parquet(f"{tmp_path}/mixed")
    assert len(back.inputFiles()) > 50
    out = corpus_pipeline.pieces(spark, back, "").collect()
    assert {r.doc_id: r.position for r in out} == want and sorted(want.values()) == list(range(400))
    in_memory = corpus_pipeline.pieces(spark, spark.createDataFrame(rows[:50], docs.schema), "").collect()
    assert [r.doc_id for r in sorted(in_memory, key=lambda r: r.position)] == list(range(50))
