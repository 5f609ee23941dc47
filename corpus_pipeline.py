"""The corpus pipeline: five operators over `documents`, each on all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run(spark, sf_dir) applies
them one after another, each result written to the shared checkpoint folder. There is no SQL for the whole (a learned
classifier comes first); tests compare each stage's rows with a plain version.

All stages but the last return the columns of documents (doc_id, text, lang, source, n_chars). The mix's row of a document
that it takes several times, or in part, is a row for each use. The order of training is position, use, doc_id: the mix's
rows are sorted so, and the first two of these columns come along to the end, as the last stage doesn't sort again.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempolog.llm import bpe, jaccard, mixing, secrets, toxicity
from tempolog.llm.session import checkpointed, release, settled

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under 0.7; labels are those of the documents table."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    release(spark)
    return toxicity.scored(docs.select(*COLUMNS), model, 0.7).filter("predicted = 0").select(*COLUMNS)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles at 0.8 or more, one: that with the least hash of id and text.

    Groups are of texts, not of ids: rows without doc_id are grouped like others, and different texts under one doc_id stay
    apart. Of rows that agree in doc_id and text one stays. Documents without words link with nothing and all stay.
    """
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    keyed = docs.select(*COLUMNS, key.alias("key"))
    groups = jaccard.jaccard_groups(keyed, 5, Fraction(8, 10), id_col="key")
    # by itself, so that the driver doesn't hold the plans, tasks and shuffles of the groups and of the texts at once
    kept = settled(groups.filter("n_shingles > 0 AND id = component_id").select(F.col("id").alias("key")).distinct())
    # two texts whose keys collide both stay
    one = keyed.join(kept, "key", "left_semi").groupBy("key", "doc_id", F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
    wordless = docs.filter(~F.coalesce(F.col("text").rlike(mixing.WORD), F.lit(False))).select(*COLUMNS)
    return one.select("doc_id", "row.*").select(*COLUMNS).union(wordless)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced."""
    return secrets.redacted(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every use of a document in the mix, in training order, with columns position and use.

    A use that the mix takes in part has the first words of the text, up to the number taken."""
    rows = mixing.training_order(mixing.curriculum(docs.select(*COLUMNS)), "text", "doc_id")
    size = F.when(F.col("words") < F.col("size"), F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return rows.select("doc_id", "text", "lang", "source", size.alias("n_chars"), "position", "use")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, position, use, ids and n_tokens of every row; the order of training is that of position, use, doc_id."""
    place = [c for c in ("position", "use") if c in docs.columns]
    rows = bpe.encode(docs.select("doc_id", "source", "text", *place))
    return rows.select("doc_id", "source", *place, "ids", F.size("ids").cast("bigint").alias("n_tokens"))


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard_join", remove_near_copies),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode_texts),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
