"""Query op4_language_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.llm.language import fit, predict
from shutterlake.llm.text import table


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit(docs.where(fold != 2), F.xxhash64("doc_id"))
    return predict(docs, model, keep={"held_out": F.coalesce(fold == 2, F.lit(False))})
