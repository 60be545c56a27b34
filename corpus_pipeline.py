"""The corpus pipeline: from the table of documents to token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from shutterlake import scratch
from shutterlake.llm import decontaminate, mixing, quality, simhash, token_files
from shutterlake.llm.op07_tokens import tokenizer_path
from shutterlake.llm.text import table


def quality_rules(spark, docs, sf_dir):
    """Failing lines go; documents that are rejected go."""
    return quality.clean(docs)


def simhash_near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays: 0.8 or more of their 5-word shingles in common."""
    return simhash.kept_similar(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mixing_sources(spark, docs, sf_dir):
    """Each document with the words that the mix takes of it."""
    return mixing.mixed(docs)


def token_output(spark, docs, sf_dir):
    """Token files of the mix, read back: a row per document."""
    return token_files.round_trip(docs, tokenizer_path(), kept=400_000)  # the stages before leave less memory


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing_sources),
    ("token_output", token_output),
]

#: SQL has no form for the hashed draws of the mix and the tokenizer's merges.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
