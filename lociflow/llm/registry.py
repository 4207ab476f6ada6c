"""The operators' queries by name, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm import annulus, byte_bpe, chat_format, decontaminate, language_id, license_scan, near_dedup, quality, secret_scan, substring_dedup, topk_search, url_filter, whitening
from lociflow.llm.common import fold, table


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from four fifths of those that name theirs."""
    docs = table(spark, folder, "documents")
    model = language_id.fit(docs.where(fold(F.col("doc_id"), 5) != 0))
    out = language_id.predict(docs, model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous", "runner_up")


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licences of every document."""
    return license_scan.scan(table(spark, folder, "documents"))


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the benchmark item that it covers best."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's url."""
    return url_filter.judge(table(spark, folder, "pages"), url_filter.RULES)


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of every document that near-duplicate one of another document."""
    found = substring_dedup.repeats(table(spark, folder, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["begin"], s["end"])), ",")
    return found.select("doc_id", "n_words", "class_rows", "n_spans", spans.alias("spans"))


def op6_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest other vectors, by inner product, of every hundredth vector."""
    return topk_search.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the class of its near-duplicates; the class's smallest doc_id is the one to keep."""
    found = near_dedup.classes(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "class_rows", "texts", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document; a document's source is both its repository and its owner."""
    return secret_scan.scan(table(spark, folder, "documents"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from three quarters of the labelled ones."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.fit(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    return quality.scored(docs, model).select("doc_id", held, "score", predicted)


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> byte_bpe.Vocabulary:
    import public_tokenizers

    return byte_bpe.read_vocabulary(public_tokenizers.path(name), public_tokenizers.PATTERN)


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, and what they decode to, as digests."""
    return byte_bpe.digests(table(spark, folder, "documents"), vocabulary())


def op11_annulus(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector with its cluster."""
    return annulus.clusters(table(spark, folder, "embeddings"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector, whitened."""
    return whitening.whiten(table(spark, folder, "embeddings"))


#: A conversation whose texts are control strings.
PROBE = "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"


def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, formatted as examples and read back from them."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(rows.union(spark.sql(PROBE)))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_decontaminate": op3_decontaminate,
    "op4_url_filter": op4_url_filter,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_topk_search": op6_topk_search,
    "op7_near_dedup": op7_near_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality": op9_quality,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_annulus": op11_annulus,
    "op12_whitening": op12_whitening,
    "op13_chat_format": op13_chat_format,
}
#: The others are tested by brute force, exact round trip or held-out accuracy in tests/llm.
ORACLE_SQL = {
    "op2_license_scan": license_scan.oracle(),
    "op4_url_filter": url_filter.oracle(),
    "op6_topk_search": topk_search.ORACLE,
    "op8_secret_scan": secret_scan.oracle(),
    "op11_annulus": annulus.oracle(),
    "op13_chat_format": chat_format.oracle(),
}
