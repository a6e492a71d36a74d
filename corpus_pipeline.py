"""The corpus pipeline: each stage takes what its predecessor kept and returns a DataFrame.

All stages take nulls in any column, columns of any name beside doc_id and text,
texts of any length (read whole) and empty tables (which give empty ones).
"""

from __future__ import annotations

from tidemark.llm.common import table
from tidemark.llm.jaccard import text_classes
from tidemark.llm.mixing import repeat_to_targets
from tidemark.llm.packing import pack_documents
from tidemark.llm.registry import tokenizer_file
from tidemark.llm.secrets import mask_secrets
from tidemark.llm.simhash import keep_first
from tidemark.llm.toxicity import drop_toxic

#: Toxic documents have gone, so two domains are left to balance.
TARGETS = {"low": 0.1, "high": 0.9, "toxic": 0.0}


def toxicity(spark, docs, sf_dir):
    """Documents whose expected severity is rejected go; a null text is judged as an empty one, repeated rows alike."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles stays: the
    smallest doc_id, of ties one row; texts without words, null ones too, are one group. Links are looked for by
    SimHashes with Golay keys and, as two bits reach few of them, by min-hash bands; all are verified."""
    return keep_first(docs, text_classes)


def secrets(spark, docs, sf_dir):
    """Found secrets are masked in the text; every document stays, a null text as it is."""
    return mask_secrets(docs)


def mixing(spark, docs, sf_dir):
    """Rows are repeated until the domains have their target shares of tokens; every document stays, equal rows equally often."""
    return repeat_to_targets(docs, table(spark, sf_dir, "labels"), TARGETS)


def packing(spark, docs, sf_dir):
    """Token pieces with their sequence and offset; a null text is one separator."""
    return pack_documents(docs, tokenizer_file())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the trained classifiers nor the tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written as Parquet and read again."""
    from tidemark.llm.common import stage

    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
