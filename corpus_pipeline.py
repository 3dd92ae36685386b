"""A training corpus from documents: toxicity, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the
columns of documents (the mixture with the number of each copy besides). Between stages the rows are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martwright.llm import mixing, pieces, secrets, shingles, simhash, toxicity
from martwright.llm.common import leave_out, read, stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 by a network fitted on the labelled ones.

    Each row goes by its own text: repeated rows stay or go together. Null and empty texts score 0 and stay, and so does all
    where no row is labelled; rows with a null id have no label. Long texts are scored whole.
    """
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (fingerprints at most 4 bits apart), and then of each group linked by five-word shingles of Jaccard similarity 0.8 or more: the one with the smallest id.

    Null and empty texts are copies of each other. Of repeated rows one stays; rows with a null id all stay.
    """
    docs = docs.select(*COLUMNS)
    gone, again = simhash.copies(docs)
    docs = simhash.once(docs, "doc_id", "text", again)
    return leave_out(docs, "doc_id", gone.toDF("id").unionByName(shingles.copies(docs, gone=gone)))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; every stretch of text that a rule finds is replaced by [SECRET], and n_chars follows.

    Texts without a secret, null and empty ones among them, stay as they are, with their n_chars. Repeated rows each stay.
    """
    scanned = secrets.scan(docs.select(*COLUMNS))
    changed = F.size("spans") > 0
    marked = scanned.withColumn("_changed", changed)
    hidden = secrets.redact(marked).withColumn("n_chars", F.when(F.col("_changed"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return hidden.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources give equally many characters, in a global shuffle.

    A null source is one of its own. Rows of one id and source are repeated alike. Null and empty texts are drawn like
    others; a source without any text isn't in the mixture. copy numbers a document's copies, for the next stage.
    """
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS, "copy")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the pieces of the text and how many; a document repeated by the mixture is there as often, each time cut in its own way.

    Rows stay where the mixture has put them. A null text has null pieces and an empty one none, both n_tokens 0. Long texts
    are cut whole. Where rows bear no copy numbers, rows of one id and text are numbered here, which moves them.
    """
    if "copy" not in docs.columns:
        docs = docs.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("source")) - 1)
    numbered = docs.select("doc_id", "source", "text", "copy")
    encoded = pieces.encode(numbered, copy_col="copy")
    return encoded.select("doc_id", "source", "ids", F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).alias("n_tokens"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("pieces", tokens),
]
ORACLE_SQL = None  # networks and fingerprints aren't SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
