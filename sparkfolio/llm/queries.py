"""The registered queries of this subpackage: thin wrappers that read a table, apply an operator and return its digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkfolio.llm import archive, boilerplate, byte_bpe, collocations, fill_middle, html_blocks, licenses, mixing, quality, sentencepiece_codec, simhash, substring_dedup, vector_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> bytes:
    """Content of a public vocabulary file."""
    return piece_model(name)


def piece_model(name: str = "piece_bpe_32k.model") -> bytes:
    """Content of a public model file; its place comes from the tokenizers' own package."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), piece_model()))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.deduplicate(table(spark, sf_dir, "documents"), window=50)
    return kept.selectExpr("doc_id", "n_words", "n_removed", "sha2(cast(kept as binary), 256) as kept_sha256")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.round_trip(table(spark, sf_dir, "pages"), min_bytes=0).drop("url")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a tree per source, a folder per hundred ids and one per ten; every tenth file is its folder's licence file."""
    docs = table(spark, sf_dir, "documents")
    part, folder = "concat(source, '/part', doc_id div 1000)", "concat(source, '/part', doc_id div 1000, '/set', doc_id div 100)"
    path = f"case when doc_id % 100 = 0 then concat({part}, '/LICENSE') when doc_id % 10 = 0 then concat({folder}, '/LICENSE') else concat({folder}, '/', doc_id, '.txt') end"
    return licenses.scan(docs.selectExpr("doc_id", "text", f"{path} as path"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), piece_model(), carry=["doc_id"])
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    fertility = ["n_tokens", "chars_per_token", "byte_share", "token_entropy", "script"]
    return scored.select("doc_id", *[f"quality.{c}" for c in base + fertility])


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract_pages(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), cap=3.0)


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = boilerplate.drop_boilerplate(table(spark, sf_dir, "documents"))
    return kept.selectExpr("doc_id", "n_lines", "n_dropped", "sha2(cast(text as binary), 256) as kept_sha256")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "lpad(lower(hex(fp)), 16, '0') as fingerprint", "component_id")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(byte_bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary()))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_warc": op3_warc,
    "op4_licenses": op4_licenses,
    "op5_quality": op5_quality,
    "op6_html_text": op6_html_text,
    "op7_mixing": op7_mixing,
    "op8_embeddings": op8_embeddings,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash": op10_simhash,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_fill_middle": op12_fill_middle,
    "op13_collocations": op13_collocations,
}
