"""The operators of this subpackage as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from joeira.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

# Rules of the URL filter (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
# Target weights of the mixture; a source that is not named has weight 5.
MIX_WEIGHTS = {"src0": 30, "src1": 10, "src2": 10}
MIX_DEFAULT = 5
MIX_BLOCK = 16


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joeira.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), radius=2, size=3)


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's piece identifiers, what they decode to, and whether that is the text."""
    from joeira.llm.pieces import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), decoded=True)


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joeira.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed here are the URLs that some page was reached by through a feed."""
    from joeira.llm.url_filter import filter_urls

    pages = table(spark, sf_dir, "pages")
    listed = pages.select("url").where(F.col("url").contains("utm_source="))
    return filter_urls(pages, listed, URL_RULES)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joeira.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joeira.llm.nearest import search

    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, k=10)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joeira.llm.repeats import repeats_report

    return repeats_report(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joeira.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joeira.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joeira.llm.mixing import mix_order

    return mix_order(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_DEFAULT, block_rows=MIX_BLOCK)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joeira.llm.packing import cut, pack

    pieces = cut(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024, end=2)
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), limit=1024)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joeira.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"), min_count=30, max_words=4, covered=80, top=2000)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joeira.llm.vector_codes import code_table

    return code_table(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_pieces": op2_pieces,
    "op3_embeddings": op3_embeddings,
    "op4_url_filter": op4_url_filter,
    "op5_quality": op5_quality,
    "op6_nearest": op6_nearest,
    "op7_repeats": op7_repeats,
    "op8_licenses": op8_licenses,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
    "op11_packing": op11_packing,
    "op12_collocations": op12_collocations,
    "op13_vector_codes": op13_vector_codes,
}
