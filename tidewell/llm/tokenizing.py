"""Encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.bpe import TOKENIZERS, VOCABULARY, CorpusEncoder

#: Characters of text that are encoded at once; more text shares one replay of the merges, at the cost of memory.
CHUNK_CHARS = 12_000_000


def chunks(batches: Iterator[pa.RecordBatch], column: int, chars: int = CHUNK_CHARS) -> Iterator[pa.Table]:
    """Record batches joined until their texts reach ``chars`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= chars:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def encode_corpus(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``ids``, the token ids of each document, without special tokens.

    A text that looks like a special token is ordinary text. Null and empty texts give the empty
    list, an empty table no rows; repeated rows are encoded each; a null id stays null. Other columns
    are pruned. Whole texts are encoded, however long; a word of any length costs n log n.

    Every task encodes its own rows and nothing is shuffled. The corpus that one replay of the
    merges covers is a chunk of ``CHUNK_CHARS``, whose distinct words are replayed together; a task
    carries known words from chunk to chunk. A replay over the distinct words of the whole corpus
    would have to send every occurrence of every word through a shuffle to bring the ids back.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CorpusEncoder(f"{tokenizers}/{vocabulary}")
        for chunk in chunks(batches, 1):
            chunk = chunk.combine_chunks()
            found = encoder.words(chunk.column(1).to_pylist())
            for at in range(0, len(found), 10_000):
                ids, offsets = encoder.gather_all(found[at : at + 10_000])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                keys = chunk.column(0).slice(at, len(lists)).combine_chunks()
                yield pa.RecordBatch.from_arrays([keys, lists], names=["doc_id", "ids"])

    columns = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].cast("string").alias("text"))
    return columns.mapInArrow(encode, "doc_id bigint, ids array<int>")
