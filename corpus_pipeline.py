"""Corpus pipeline: language, quality, near-duplicates, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a frame; what it returns is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``. Rows with null or empty text leave in the first stage;
an empty table passes through all stages as an empty table. Null and repeated ids are no reason to leave: stages decide by
row. Of ties (rows alike in class and id) the smallest digest of the row stays. Very long texts pass whole, and
columns named like a stage's own keep their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphline.llm import language_id, mixing, quality, sentencepiece_codec, simhash
from glyphline.llm.common import fresh_dir, remove_dir

#: A prediction counts from this share of the evidence on; below, the language is taken as not known.
MIN_SCORE = 0.5


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with columns in0, in1, ..., so that no name of a stage's own meets one of them."""
    return docs.toDF(*[f"in{i}" for i in range(len(docs.columns))])


def named(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``numbered(docs)`` in ``df`` under their own names."""
    return df.select(*[F.col(f"in{i}").alias(c) for i, c in enumerate(docs.columns)])


def place(docs: DataFrame, col: str) -> str:
    return f"in{docs.columns.index(col)}"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is known; without letters or between languages they go."""
    found = language_id.identify(numbered(docs), language_id.learn(docs), place(docs, "text"))
    return named(found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE)), docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that no rule rejects."""
    return named(quality.judge(numbered(docs), place(docs, "text")).where("kept"), docs)


def keyed(docs: DataFrame) -> DataFrame:
    """``numbered(docs)`` with ``row_key``, a 256-bit digest of the whole row: rows have one key only if they are equal in all columns."""
    own, text = numbered(docs), place(docs, "text")
    rest = F.to_json(F.struct(*[F.col(c) for c in own.columns if c != text]))
    return own.withColumn("row_key", F.unhex(F.sha2(F.concat(F.coalesce(F.sha2(text, 256), F.lit("")), rest), 256)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class: that of the smallest doc_id, and among equal or only null ids that of the smallest digest.

    A doc_id doesn't make a document: rows of other texts that share it, or have none, stay unless their texts are alike.
    """
    rows = keyed(docs)
    heads = simhash.first_rows(rows, "row_key", place(docs, "doc_id"), place(docs, "text"))
    # equal rows meet by their key, where the heads are joined to them: whole texts move once
    return named(rows.dropDuplicates(["row_key"]).join(heads.hint("merge"), "row_key", "left_semi"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats every row as often as the mixture takes it; those it doesn't take go. Equal rows are repeated as often as all of them are taken."""
    rows = keyed(docs)
    mixed = mixing.mix(rows, id_col=place(docs, "doc_id"), text_col=place(docs, "text"), source_col=place(docs, "source"), keep=("row_key",))
    taken = mixed.where("copies > 0").groupBy("row_key").agg(F.sum("copies").cast("int").alias("copies"))
    rows = rows.join(taken, "row_key").dropDuplicates(["row_key"])
    return named(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))), docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row: their number and digests, and that of the text decoded from them."""
    return sentencepiece_codec.codec_report(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("simhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Code lengths and merges can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Only the last stage's table stays, since the result reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_dir(spark, before)
        before = path
    return docs
