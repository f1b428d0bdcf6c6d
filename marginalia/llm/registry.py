"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.fragment_bpe import encode_decode
from marginalia.llm import licenses
from marginalia.llm.packing import pack
from marginalia.llm.parity_join import jaccard_groups
from marginalia.llm.pivot_index import near_vectors
from marginalia.llm.progressive_jpeg import media_columns
from marginalia.llm.quality import classify_quality
from marginalia.llm.suffix_tree import score_contexts
from marginalia.llm.token_counts import token_counts
from marginalia.llm.toxicity import classify_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being toxic."""
    return classify_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, by the unigram base and by the suffix tree."""
    return score_contexts(_table(spark, sf_dir, "documents"))


def op3_pivot_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors of one label with a cosine of 0.98 or more."""
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_parity_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 5-word shingles have a similarity of 0.75 or more."""
    return jaccard_groups(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences among whole documents and their lines."""
    return licenses.find_licenses(_table(spark, sf_dir, "documents"))


def op7_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document kept in a progressive JPEG file: digests of what is read back, and features of the tensor."""
    media = media_columns(_table(spark, sf_dir, "documents"))
    sums = F.array_join(F.col("channel_sums").cast("array<string>"), ",")
    return media.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("%dx%d rgb %s %s", "height", "width", sums, F.substring(F.sha2("tensor", 256), 1, 16)).alias("feature"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they exceed 4096."""
    counts = token_counts(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being good."""
    return classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    coded = encode_decode(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Query]:
    found = [op1_toxicity, op2_suffix_tree, op3_pivot_neighbours, op4_parity_jaccard, op5_packing, op6_licenses, op7_progressive_jpeg, op8_token_counts, op9_quality, op10_bpe_roundtrip]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_licenses": licenses.ORACLE}
