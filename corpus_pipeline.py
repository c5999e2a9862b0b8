"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept; all but the last return the columns of
`documents`, extra ones too, whatever their names. Between stages the rows are written
and read again. No stage needs ids of its own for each row: null and repeated ids are
told apart by their rows. An empty table gives no rows in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factgraph.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from factgraph.llm.common import remove, scratch, stored, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Each row is judged by its own text: repeated rows and ids share nothing but what
    their texts share, so ties don't occur. Null and empty texts have one score and stay
    or go together; very long texts are read whole. Without a label outside the held-out
    fold nothing can be learned, and all rows stay. Extra columns are kept as they are.
    """
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def exact_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space one row stays, that with the smallest id, null ids last.

    Null texts count as empty. Of rows with the same id and text one stays; rows with
    the same id and other texts are other documents. Very long texts count whole. Extra
    columns are kept as they are, those of the row that stays.
    """
    return exact_dedup.kept_documents(docs)


def near_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8 or more) one row stays, that with the smallest id, null ids last.

    Groups are closed under links. Texts without words, null ones too, are in no group
    and stay. Repeated rows are copies of each other; rows with the same id and other
    texts are other documents. Very long texts count whole. Extra columns are kept as
    they are.
    """
    return near_dedup.kept_documents(docs, k=5, percent=80)


def leak_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, with up to 8 % edits, go.

    Each row is judged by its own text, so repeated rows stay or go together. Null and
    empty texts hold nothing and stay, null and empty items stand in nothing; an empty
    benchmark removes nothing. Very long texts are searched whole. Extra columns are kept
    as they are.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens with their ids, as training reads them.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary,
    little-endian 32-bit): a sequence is its pieces in the order of offset; each but the
    last is full. A null or empty text is its end id alone. Repeated rows are packed each on its own; null ids
    stay null. Extra columns are left out.
    """
    return packing.training_rows(packing.pack(docs, packing.public_bpe(), 2048, 1))


STAGES = [
    ("quality_classifier", quality_filter),
    ("exact_dedup", exact_filter),
    ("near_dedup", near_filter),
    ("decontamination", leak_filter),
    ("packing", pack),
]

#: SQL can't express the classifier, the sketches or the tokenizer; tests/llm compares
#: the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`.

    What a stage leaves in the shared folder is removed as soon as its result is stored,
    and that as soon as the next one is. Only the token table stays, as the rows are read
    from there; `factgraph.llm.common.drop_scratch` removes it.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs, path = stored(stage(spark, docs, sf_dir), name)
            made.discard(path)
        if last:
            remove(spark, last)
        last = path
    out = STAGES[-1][1](spark, docs, sf_dir)  # all tokens are stored by now
    remove(spark, last)
    return out
