"""Queries p1 and p5 to p10 over the tables of a data folder, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.bpe import count_column, encode_column
from gneiss.llm.handwritten import not_handwritten
from gneiss.llm.lookalike import canonical_column, look_classes, same_look
from gneiss.llm.mixture import Mix, mix
from gneiss.llm.secrets import find_secrets, redacted_column
from gneiss.llm.syntax import checked, invalid_rates
from gneiss.llm.top_n import top_n
from gneiss.operators.versions import holding
from gneiss.sources.tables import table


#: Bytes of input for each core below which a table is spread: it lies in fewer or larger pieces than there are cores.
SMALL_SHARE = 4 << 20


def _spread(df: DataFrame, column: str) -> DataFrame:
    """Rows of a table of few bytes are spread over all cores; a large one stays as it lies. The rows are the same."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size >= cores * SMALL_SHARE else df.repartition(2 * cores, column)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "source_files").select("file_id", "repositoryStableKey", "language", "absolutePath", "sourceText")
    return _spread(files, "file_id")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return not_handwritten(_files(spark, folder), "file_id", "absolutePath", "sourceText", "repositoryStableKey").select("file_id")


def p1_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Files that nobody wrote by hand, per repository and reason."""
    files = _files(spark, folder)
    found = not_handwritten(files, "file_id", "absolutePath", "sourceText", "repositoryStableKey")
    return found.join(files.select("file_id", "repositoryStableKey"), "file_id").groupBy("repositoryStableKey", "reason").agg(F.count("*").alias("files"))


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    rows = holding(table(spark, folder, "hotspots"), ["category", "targetStableKey", "score"])
    return top_n(rows, ["snapshotStableKey", "category"], "score", ["targetStableKey", "stableKey"], 5)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(spark, folder).select(F.col("snapshotStableKey").alias("snapshot_key"), "category", F.col("targetStableKey").alias("target_key"))


def p5_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(spark, folder).select(F.col("snapshotStableKey").alias("snapshot_key"), "category", F.col("targetStableKey").alias("target_key"), "score", F.col("rank").cast("long").alias("rank"))


_TOP = """h AS (SELECT * FROM hotspots QUALIFY row_number() OVER (PARTITION BY snapshotStableKey, stableKey ORDER BY loadedUtc DESC) = 1),
r AS (SELECT snapshotStableKey AS snapshot_key, category, targetStableKey AS target_key, score, row_number() OVER (PARTITION BY snapshotStableKey, category ORDER BY score DESC, targetStableKey, stableKey) AS rank
      FROM h WHERE score IS NOT NULL)"""
SQL_P5_FOUND = f"WITH {_TOP} SELECT snapshot_key, category, target_key FROM r WHERE rank <= 5"
SQL_P5_RANKED = f"WITH {_TOP} SELECT snapshot_key, category, target_key, score, rank FROM r WHERE rank <= 5"


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return checked(_files(spark, folder), "file_id", "absolutePath", "sourceText").filter(~F.col("valid")).select("file_id")


def p6_rates(spark: SparkSession, folder: str) -> DataFrame:
    """The rates of files that do not parse."""
    return invalid_rates(_files(spark, folder), "file_id", "absolutePath", "sourceText", "repositoryStableKey")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_secrets(_files(spark, folder), "file_id", "absolutePath", "sourceText").select("file_id", "line_no")


def p7_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every file's text with its credentials blanked."""
    files = _files(spark, folder)
    return files.select("file_id", redacted_column(F.col("absolutePath"), F.col("sourceText")).alias("text"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return _spread(table(spark, folder, "documents").select("doc_id", "text", "source"), "doc_id")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", encode_column(F.col("text")).alias("ids"))


def _mix(spark: SparkSession, folder: str) -> Mix:
    sizes = _documents(spark, folder).select("doc_id", "source", count_column(F.col("text")).alias("tokens"))
    return mix(sizes, table(spark, folder, "mix_targets"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The members of the mix: one row for each appearance of a document."""
    return _mix(spark, folder).members


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the mix reaches."""
    return _mix(spark, folder).report


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_look(_documents(spark, folder), "doc_id", "text").select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in the consistent form."""
    return _documents(spark, folder).select("doc_id", canonical_column(F.col("text")).alias("text"))


def p10_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The class of equal look, and of equal text, of every document with a visible text."""
    return look_classes(_documents(spark, folder), "doc_id", "text").select(F.col("id").alias("doc_id"), "class_id", "text_id", "spellings")


QUERIES = {
    "p1_found": p1_found, "p1_reasons": p1_reasons, "p5_found": p5_found, "p5_ranked": p5_ranked, "p6_found": p6_found, "p6_rates": p6_rates, "p7_found": p7_found, "p7_redacted": p7_redacted, "p8_ids": p8_ids,
    "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_texts": p10_texts, "p10_classes": p10_classes,
}
SQL = {"p5_found": SQL_P5_FOUND, "p5_ranked": SQL_P5_RANKED}
