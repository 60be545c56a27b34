"""Query op10_simhash_near_dedup."""

from __future__ import annotations

from shutterlake.llm.simhash import near_duplicates
from shutterlake.llm.text import table


def op10_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
