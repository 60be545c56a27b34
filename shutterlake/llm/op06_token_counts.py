"""Query op6_token_counts."""

from __future__ import annotations

from shutterlake.llm.text import table
from shutterlake.llm.token_counts import token_counts


def op6_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
