"""Query op9_personal_data."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.llm.pii import personal_data, told
from shutterlake.llm.text import table


def op9_personal_data(spark, sf_dir):
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
