"""A corpus through five stages: toxicity, line dedup, n-gram Jaccard join, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns
of documents, the last one the packed pieces. n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialgrid.llm import line_dedup, ngram_join, packing, pii, toxicity
from trialgrid.llm.common import materialize, read_table, release

#: Tables that the result of the stage before reads; that result is written by the time that the next stage has it.
_left: list[DataFrame] = []


def _tidy() -> list[DataFrame]:
    release(*_left)
    _left.clear()
    return _left


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go."""
    _tidy()
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.filter_clean(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; documents stay."""
    out = line_dedup.drop_recurring_lines(docs, left=_tidy()).drop("_n_lines", "_n_dropped")
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns])


def join_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents whose 5-word sets have a Jaccard similarity of 0.8 or more the one of the smallest id stays."""
    return ngram_join.keep_one(docs, n=5, percent=80, left=_tidy())


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become their kinds."""
    _tidy()
    out = pii.redact(docs)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences."""
    import public_tokenizers

    _tidy()
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_jaccard_join", join_near), ("pii", mask_personal), ("packing", pack)]

#: The first stage's score, and the tokens of the last, have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        done = materialize(stage(spark, docs, sf_dir), name)
        if i:
            release(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
