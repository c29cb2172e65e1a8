"""The corpus pipeline: stages over ``documents``, each on all that the one before kept.

Decisions are made per row and applied by a row number, which follows from a row's file and its place
there, so no stage copies its documents, and rows with a null id and rows that share an id are each judged by their
own text. Lists of numbers are written before they meet the documents, so that Spark knows their size when it
chooses how to join.

Null and empty texts pass the near-duplicate, decontamination and secrets stages (equal rows of an id once); what the classifier says of
an empty text decides. Texts of any length are taken whole. Of rows that tie, the first by row number stays. Extra
columns, whatever their names, come out unchanged from all stages but the last, which ignores them. An empty table passes
all stages empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmart.llm.ngram_join import ngram_classes
from starmart.llm.packing import pack
from starmart.llm.quality import score_quality
from starmart.llm.queries import tokenizer_path
from starmart.llm.secrets import dictionary_of, redact, scan_secrets
from starmart.llm.store import keep, table, with_row_numbers
from starmart.llm.tiling import contaminated

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near duplicates: shingles of five words, similarity of 0.8 or more.
WORDS, PERCENT = 5, 80
END_ID, CAPACITY = 0, 2048


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, and the name of its column, which no other has."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return with_row_numbers(docs, name), name


def _without(rows: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """The numbered rows whose number is not in ``dropped``, without it."""
    return rows.join(keep(dropped.select(row).distinct(), "dropped"), row, "left_anti").drop(row)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts."""
    rows, row = _numbered(docs)
    scored = score_quality(rows, table(spark, sf_dir, "labels"), row_column=row)
    return _without(rows, row, scored.filter("predicted = 0"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near copies; rows without an id come last.

    Texts without words have no near copies; of these, equal rows of an id are left once.
    """
    rows, row = _numbered(docs)
    classes = ngram_classes(rows, id_column=row, words=WORDS, percent=PERCENT, count_links=False)
    ids = rows.select(row, "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    wordless = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    named = keep(
        classes.join(ids, row).select(
            row, "doc_id",
            F.when(~wordless, F.col("component_id")).alias("component"),
            F.when(wordless, F.col("doc_id")).alias("own"),
            F.when(wordless, F.col("digest")).alias("digest"),
        ),
        "named",
    )
    stays = named.groupBy("component", "own", "digest").agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row))).getField(row).alias(row)
    )
    return _without(rows, row, named.join(stays, row, "left_anti"))


def free_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no test item."""
    rows, row = _numbered(docs)
    found = contaminated(rows, table(spark, sf_dir, "benchmark"), id_column=row)
    return _without(rows, row, found.select(F.col("doc_id").alias(row)))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and ``n_chars`` counted anew."""
    rows, row = _numbered(docs)
    found = keep(scan_secrets(rows, id_column=row, dictionary=dictionary_of(tokenizer_path())), "findings")
    clean = redact(rows, found, id_column=row).drop(row)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens: a row for each piece of a document, with its place."""
    return pack(docs, tokenizer_path(), END_ID, CAPACITY)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", free_of_benchmarks),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: SQL cannot express the classifier, the tiling or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
