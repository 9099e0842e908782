"""The corpus pipeline over ``documents``: language ID, line dedup, near duplicates, decontamination, encoding.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but the last return the columns
of ``documents``."""

from __future__ import annotations

from shelfwise.llm.jaccard import keep_one_of_each
from shelfwise.llm.langid import keep_identified
from shelfwise.llm.pieces import encode_stage
from shelfwise.llm.session import materialize
from shelfwise.llm.templates import drop_template_lines
from shelfwise.llm.winnowing import drop_contaminated

STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", drop_template_lines),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_stage),
]

#: Language ID and piece encoding have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
