"""Documents through five operators: quality, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table. All but the last return the
columns of documents; each works on all rows its predecessor kept.
"""

from pulsewatch.llm import decontaminate, jaccard, pieces, quality, secrets
from pulsewatch.llm.common import read
from pulsewatch.session import run_dir


def quality_stage(spark, docs, sf_dir):
    """Documents that the classifier keeps: of quality, and not toxic.

    Null and empty texts are judged by their metadata; without labels all rows stay.
    """
    return quality.reject(docs, read(spark, sf_dir, "labels"))


def near_duplicate_stage(spark, docs, sf_dir):
    """One document, the smallest doc_id's, of each group that shingles of five words link at 0.8.

    Documents without words link with nothing and stay.
    """
    return jaccard.keep_one(docs, width=5, num=80, den=100)


def decontamination_stage(spark, docs, sf_dir):
    """Documents in which no benchmark item is found; null and empty texts stay."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def secret_stage(spark, docs, sf_dir):
    """All documents, found secrets replaced by a mark; n_chars counts the new text where it changed."""
    return secrets.redact_documents(docs)


def encoding_stage(spark, docs, sf_dir):
    """doc_id, ids, n_ids and round_trip of every document."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: No SQL trains a classifier or encodes pieces; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over the documents, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = run_dir(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
