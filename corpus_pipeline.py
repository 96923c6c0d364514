"""From raw documents to packed training sequences: toxicity, line dedup, near-duplicate removal, benchmark
decontamination, packing. Each stage takes all that its predecessor kept, as (spark, docs, sf_dir), and returns a
DataFrame; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontaminate, jaccardjoin, linededup, packing, toxicity
from sluice.llm.common import given_up, table, written

#: No DuckDB SQL: the first stage is a trained model and the last a tokenizer.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labels, scores 0.5 or more go. Null and empty texts have no evidence and stay; rows with a
    null or repeated doc_id are judged one by one; without labels all stay; every other column stays as it is."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), threshold=0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points or more that five documents share stay only in the last of them. Every row stays, if with an empty text; a null
    text stays null; rows that share a doc_id count as one document and lose their own lines; a null doc_id is the smallest."""
    return _counted(linededup.drop_lines(docs, min_chars=40, min_docs=5))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles, the least doc_id stays. Rows with a null doc_id, and those
    without words, link with nothing and stay; rows that share a doc_id stand for their least text and stay or go together."""
    return jaccardjoin.one_of_each(docs, words=5, num=80, den=100)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that hold windows of benchmark items are cut out; documents of which they cover over half go. A null text stays null; items without
    text or words have no window; rows with a null or repeated doc_id are cut one by one; an empty benchmark changes nothing."""
    return _counted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, max_words=1, max_share=0.5))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens. A null or empty text is its end id alone; repeated rows are packed one by one; a null doc_id
    stays null; an empty table gives no pieces."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", remove_benchmark),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again as the next one's input, and goes when that one's result is written. The last
    reads the table before it, which stays."""
    docs = source = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not source:
            given_up(before)
    return STAGES[-1][1](spark, docs, sf_dir)
