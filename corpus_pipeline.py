"""A training-data pipeline over documents: toxicity, near duplicates, decontamination, personal data, mixing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with
the columns of documents. run() applies them one after another, each stage's rows written as Parquet and read again.

Rows: any column may be null, and other columns are kept, whatever their names. Documents of null, empty or blank texts
pass every stage but the last, which takes none of them. Repeated rows are one document from the second stage on; rows
of one id and other texts, or of null ids, are judged by their texts. Very long texts are read whole. An empty table
gives no rows.
"""

from annalist.llm.blocks import materialize
from annalist.llm.decontaminate import remove_contaminated
from annalist.llm.jaccard import keep_one
from annalist.llm.mixing import take_mix
from annalist.llm.pii import redact
from annalist.llm.toxicity import reject_toxic


def toxicity(spark, docs, sf_dir):
    """Documents that the clause grammar scores as toxic go."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of linked documents stays; sets of five-word shingles link at similarity 0.8."""
    return keep_one(docs, width=5, similarity=(80, 100))


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark window go."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark, docs, sf_dir):
    """Personal data is replaced by its kind in brackets; every document stays."""
    return redact(docs)


def mixing(spark, docs, sf_dir):
    """The documents that the mix takes, with their repeats."""
    return take_mix(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("mixing", mixing)]

#: The stages learn a classifier, bootstrap patterns and fit a knapsack: SQL can't express them (tests/llm compares them to brute force).
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
