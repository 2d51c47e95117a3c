"""From raw documents to encoded training text, in five stages.

Each stage takes what the one before it kept, and all but the last return the columns of
documents. Between stages the rows are written to the folder that all executors share, so a lost
executor costs the tasks of one stage.

Cases, beyond those of the operators: an empty table goes through all stages and gives no rows; columns beside
doc_id, text and source are carried by all stages but the last, whatever their names; ``n_chars`` follows the
text where there is such a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, table
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.minhash_join import drop_near_duplicates
from tessera.llm.mixing import mix
from tessera.llm.nbest_pieces import default_model, encode_documents
from tessera.llm.quality_knn import fit, score_documents


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labelled rows of these, predicts as good.

    Cases: without labelled rows all stay; null and empty texts are judged as one text; equal texts stay or go
    together."""
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")), keep=True)


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many sites share; every document stays, if empty, and its n_chars follow.

    Cases: a null text stays null and has a null n_chars; equal texts lose the same lines; a null source is a
    site; a text of boilerplate alone becomes empty."""
    clean = dedup_lines(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the least doc_id.

    Cases: a null doc_id stays only where its class has no other; of equal texts without words one stays;
    repeated rows are one document."""
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Cases: a text without words is never taken; a null source comes last; repeated rows share their copies."""
    return mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document's best segmentation, and the scores of its best ones.

    Cases: a null or empty text has no ids, one segmentation and score 0; a document that was taken n times
    has n equal rows."""
    return encode_documents(docs, default_model(), ids=1, digests=True)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", remove_boilerplate),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

ORACLE_SQL = None  #: a fitted classifier, random rounding and a lattice search are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded documents of STAGES over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
