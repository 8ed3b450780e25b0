"""A training-corpus pipeline over `documents`: harmless, identified, deduplicated, uncontaminated, encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet to the shared folder
and read again as the next stage's docs. All but the last return the columns of documents.

Handling of special cases, by stage: toxicity keeps null and empty texts and rows without a key; language ID drops
texts without a letter, null ones among them; the Jaccard join keeps documents without words and rows without a key, and
of rows with one doc_id the least; decontamination keeps null texts and rows without a key; encoding gives null texts no
ids. Extra columns of any name go through all stages but the text, ids, n_tokens and decoded of the last. An empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmark.llm.common import read_table, stored
from leafmark.llm.decontamination import keep_uncontaminated
from leafmark.llm.jaccard_join import keep_one_of_each_group
from leafmark.llm.language_id import keep_identified
from leafmark.llm.sentencepiece_codec import encode_stage
from leafmark.llm.toxicity import keep_harmless

STAGES = [
    ("toxicity", keep_harmless),
    ("language ID", keep_identified),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", keep_uncontaminated),
    ("SentencePiece encoding and decoding", encode_stage),
]
ORACLE_SQL = None  # trained models and a tokenizer are no SQL; tests hold each operator against brute force, libraries or held-out rows


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return docs
