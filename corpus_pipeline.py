"""The corpus pipeline: toxic documents go, site boilerplate goes, one document of each near-duplicate group
stays, documents with benchmark passages go, and the rest is segmented into pieces.

``STAGES`` lists the stages; each works on all rows that the one before returned. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demescope.llm.decontaminate import decontaminated
from demescope.llm.jaccard_join import one_of_each_group
from demescope.llm.line_dedup import without_boilerplate
from demescope.llm.queries import PIECE_MODEL, table, tokenizer_file
from demescope.llm.sentence_pieces import encoded
from demescope.llm.toxicity import without_toxic
from demescope.session import cut_lineage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.5."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that over a hundredth of their source's pages have; n_chars follows the text."""
    clean = without_boilerplate(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group linked by 0.8 of five-word shingles."""
    return one_of_each_group(docs, words=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that don't cover most of a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids and scores of the best segmentations and the checks of ``encoded``."""
    return encoded(docs, tokenizer_file(PIECE_MODEL))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", segmentation),
]

# A network's scores and a lattice's best paths are beyond SQL. Tests plant rows for each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
