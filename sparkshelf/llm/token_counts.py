"""Token counts (operator 10): rank-synchronous merging of batched pre-tokens (see ``bpe``).

A null text is empty and has no tokens.  Repeated rows and null ids stay as they
are; other columns, whatever their names, are not read.  A very long text is counted
whole, a very long pre-token by itself.  An empty table gives no rows.  A special string inside a text counts as the
library counts it by default: as its one token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkshelf.llm.bpe import bpe
from sparkshelf.llm.ragged import Texts, map_slices

LIMIT = 512


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every row."""

    def work(part: pa.RecordBatch):
        texts = Texts(part.column("text"))
        tokens = bpe(vocabulary(tokenizer)).count(texts)
        return {"doc_id": part.column("doc_id"), "n_bytes": np.diff(texts.bounds), "n_tokens": tokens.astype(np.int64), "over_limit": tokens > limit}

    return map_slices(docs.selectExpr(f"CAST(`{id_col}` AS long) doc_id", f"`{text_col}` text"), "text", work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
