"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.bpe import word_bpe
from rillmark.llm.common import Words, ragged, table, text_slices, tidy

LIMIT = 2048


def text_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of all texts of a slice, and where each text's begin (with the end as last)."""
    words = Words(texts, lower=False)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    number, chunks = words.distinct()
    ids, at = word_bpe(path).encode(chunks)
    size = np.diff(at)[number]
    return ids[ragged(at[number], size)], np.concatenate([[0], np.cumsum(size)])[words.first]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row's whole text; null and empty texts have no bytes and no tokens.

    White space ends a pre-token, so each distinct run without ASCII white space of a slice is split and merged
    once, by rank-synchronous merging, and counted wherever it stands. Rows of equal or null id are counted each; texts
    are whole, however long; an empty table gives an empty one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            words = Words(texts, lower=False)
            total = np.zeros(len(words) + 1, np.int64)
            if len(words):
                number, chunks = words.distinct()
                _, at = word_bpe(path).encode(chunks)
                np.cumsum(np.diff(at)[number], out=total[1:])
            count = np.diff(total[words.first])
            yield pa.RecordBatch.from_arrays([rows.column(0), pc.binary_length(texts).cast("int64"), pa.array(count), pa.array(count > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op4(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")
