"""Query op7_token_files."""

from __future__ import annotations

from shutterlake.llm.text import table
from shutterlake.llm.token_files import round_trip


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_token_files(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())
