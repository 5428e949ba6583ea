"""Corpus pipeline: quality rules, near-duplicates, repeated bytes, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept and
returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetrisk.llm.decontamination import find_contamination
from packetrisk.llm.near_duplicates import near_duplicates
from packetrisk.llm.packing import pack_documents
from packetrisk.llm.perplexity_rules import quality_rules
from packetrisk.llm.repeated_bytes import remove_repeats
from packetrisk.llm.store import discard, matching, small, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _read_from_files(docs: DataFrame) -> bool:
    """Whether the rows of ``docs`` are rows of files, some of them perhaps filtered out, and can name their files and places."""
    nodes = {line.strip(" :+-|").split("(")[0].split(" ")[0] for line in docs._jdf.queryExecution().analyzed().toString().splitlines() if line.strip()}
    if not nodes <= {"Relation", "Project", "Filter", "SubqueryAlias"}:
        return False
    try:
        return "row_index" in docs.select("_metadata.*").columns
    except AnalysisException:
        return False


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of its own for every row, and the key's name: ids may be null or repeated, rows equal.

    Rows of files are numbered by file and place, without a copy; others are stored with a number.  The key's name is none of the columns'.
    """
    key = "__row"
    while key in docs.columns:
        key += "_"
    if not _read_from_files(docs):
        return stored(docs.withColumn(key, F.monotonically_increasing_id())), key
    place, file, number = (f"{key}{x}" for x in ("place", "file", "number"))
    # one row for each file
    files = stored(docs.select(F.col("_metadata.file_path").alias(file)).distinct().withColumn(number, F.row_number().over(Window.orderBy(file))))
    files = F.broadcast(files) if small(files) else files
    rows = docs.select("*", F.col("_metadata.file_path").alias(place + "f"), F.col("_metadata.row_index").alias(place)).join(files, F.col(place + "f") == F.col(file))
    return rows.withColumn(key, F.shiftleft(F.col(number).cast("long"), 36).bitwiseOR(F.col(place))).select(*docs.columns, key), key


def _without(keyed: DataFrame, key: str, rejected: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose key is not among the rejected (doc_id), without the key."""
    return matching(keyed, rejected.select(F.col("doc_id").alias(key)), key, keep=False).drop(key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, each judged on its own text.

    A null or empty text fails and goes; a null or repeated id takes no other row along, nor does an equal row;
    an empty table gives an empty one; columns beside those of documents pass through.
    """
    keyed, key = _keyed(docs)
    judged = quality_rules(keyed, id_col=key)
    return _without(keyed, key, stored(judged.where(~F.col("kept")).select("doc_id")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8): that of the smallest id, a null id last.

    A text without words is like no other and stays; of equal rows one stays; rows of one id and different
    texts are judged apart; an empty table gives an empty one; further columns pass through.
    """
    keyed, key = _keyed(docs)
    found = stored(near_duplicates(keyed, k=5, threshold=(80, 100), id_col=key).select(F.col("doc_id").alias("__key"), "component_id"))
    # Only a group of several rows has rows to reject.
    several = found.where("component_id <> __key").select("component_id").distinct()
    ids = keyed.select(F.col(key).alias("__key"), "doc_id")
    members = found.join(several, "component_id", "left_semi").join(ids, "__key")
    members = stored(members.select("component_id", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__key").alias("rank")))
    discard(found)
    first = members.groupBy("component_id").agg(F.min("rank").alias("first"))
    rejected = members.join(first, "component_id").where(F.col("rank.__key") != F.col("first.__key"))
    rejected = stored(rejected.select(F.col("rank.__key").alias("doc_id")))
    discard(members)
    return _without(keyed, key, rejected)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat 50-byte strings of earlier documents.

    A character cut in part is dropped; a text left without a word goes, so null and empty texts go.  Rows
    with a null id stay whole; rows of one id do not cut each other; an empty table gives an empty one.  Only
    the columns of documents are returned.
    """
    cut = remove_repeats(docs)
    text = F.expr("cast(try_validate_utf8(cast(kept_bytes as string)) as string)")
    whole = F.when(F.col("n_removed") == 0, F.col("kept_bytes").cast("string")).otherwise(F.coalesce(text, F.regexp_replace(F.expr("make_valid_utf8(cast(kept_bytes as string))"), "�", "")))
    out = cut.withColumn("text", whole).withColumn("n_chars", F.length("text").cast("long"))
    return out.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a 10-word passage of the benchmark, each judged on its own text.

    A null or empty text holds none and stays; a null or repeated id takes no other row along, nor does an equal row;
    an empty table gives an empty one; further columns pass through.
    """
    keyed, key = _keyed(docs)
    found = find_contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return _without(keyed, key, stored(found.where("contaminated").select("doc_id")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens.

    A null or empty text is its end token alone; rows with null or repeated ids are packed each; further
    columns are ignored; an empty table gives no rows.
    """
    return pack_documents(docs)


STAGES = [("quality rules", quality), ("near-duplicates", near_dedup), ("repeated bytes", suffix_dedup), ("benchmark passages", decontaminate), ("packing", pack)]

#: SQL cannot express the perplexity model; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
