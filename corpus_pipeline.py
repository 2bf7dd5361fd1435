"""The corpus pipeline: language, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all
but the last return the columns of documents.

In every stage a null doc_id, lang, source or n_chars is a value like any other and n_chars
is set to the length of the text; further columns of any name are left out; an empty table
gives an empty table; texts are read whole, however long.  Stages state what becomes of null
and empty texts and of repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewright.llm import language, packing, secrets, simhash, substrings
from slatewright.llm.common import discard, documents, mark, need, release, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars by the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (null or empty text, or no letter in it) go; a missing lang
    is the predicted one, or stays missing where there is nothing to learn from.  Repeated
    rows stay, with equal langs; of tied languages the alphabetically first is predicted."""
    docs = need(docs, *COLUMNS)
    model = language.learn(spark, docs)
    found = language.identify(spark, docs, model=model)
    if not model.labels:
        return _documents(found.where(language.lettered("text")))
    return _documents(found.where(F.col("lang_pred") != language.UNKNOWN).withColumn("lang", F.coalesce("lang", "lang_pred")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, whole: the one of the
    smallest doc_id, of those the first row.  Null and empty texts are a group; repeated
    rows are one too."""
    return _documents(simhash.kept(spark, need(docs, *COLUMNS)))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that lie in a repeated window go; documents with no other words, null and empty
    texts among them, go too.  Of equal windows none stays, so rows that are repeated here
    lose their words from a window's length on."""
    trimmed = substrings.trim(spark, need(docs, *COLUMNS))
    return _documents(trimmed.where(F.length(F.trim("text")) > 0))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Findings are replaced by their kind in brackets; every document stays, null and empty
    texts as they are, repeated rows alike."""
    return _documents(secrets.redact(need(docs, *COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a sequence.  Null and empty texts are a piece
    of the end id alone; repeated rows are packed as often as they occur."""
    return packing.pack(spark, need(docs, *COLUMNS))


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: No stage but the third can be put in SQL; see the tests against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage has written for
    itself, and its input, go when it is done."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        since = mark()
        made = table(spark, stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, since, made)
        if k:
            discard(spark, docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
