"""Query op2_mixing_sources."""

from __future__ import annotations

from shutterlake.llm.mixing import taken
from shutterlake.llm.text import table


def op2_mixing_sources(spark, sf_dir):
    return taken(table(spark, sf_dir, "documents"))
