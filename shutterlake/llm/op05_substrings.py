"""Query op5_substring_dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.llm.substrings import remove_repeats
from shutterlake.llm.text import table


def op5_substring_dedup(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
