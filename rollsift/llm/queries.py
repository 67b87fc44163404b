"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollsift.llm.common import table
from rollsift.llm.sql import DECONTAMINATION, JACCARD, secret_spans


def op6_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an Ogg stream, read back."""
    from rollsift.llm.ogg import read_media, store_texts

    return read_media(store_texts(table(spark, sf_dir, "documents")))


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids in Arrow files, read back by document."""
    from rollsift.llm.token_files import encode_to_files

    return encode_to_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in unigram pieces and back."""
    from rollsift.llm.unigram import encode_and_decode

    return encode_and_decode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the documents whose 4-word shingle sets reach 85 %."""
    from rollsift.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest rows of every 50th vector."""
    from rollsift.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids in packed sequences of 2048."""
    from rollsift.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text."""
    from rollsift.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from rollsift.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text; ``flagged`` is the decision by the language's calibrated threshold."""
    from rollsift.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text."""
    from rollsift.llm.secrets import report

    return report(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's weight towards the benchmark, and the rank of those drawn."""
    from rollsift.llm.importance import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the texts with its near words, form and root."""
    from rollsift.llm.spelling import variants

    return variants(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every text."""
    from rollsift.llm.decontaminate import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_quality": op1_quality, "op2_main_text": op2_main_text, "op3_toxicity": op3_toxicity, "op5_secrets": op5_secrets, "op4_token_files": op4_token_files, "op6_ogg": op6_ogg, "op7_unigram": op7_unigram, "op8_jaccard": op8_jaccard, "op9_topk": op9_topk, "op10_packing": op10_packing, "op11_importance": op11_importance, "op12_spelling": op12_spelling, "op13_decontamination": op13_decontamination}

SQL: dict[str, str] = {
    "op5_secrets": secret_spans(),
    "op8_jaccard": JACCARD,
    "op13_decontamination": DECONTAMINATION,
    "op9_topk": """
        WITH valid AS (
            SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
            FROM valid q JOIN valid c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        WHERE rank <= 5
    """,
}
