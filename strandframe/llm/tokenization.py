"""Encoding of a corpus with a public byte-level BPE tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.pretokenizer import ByteBpe

#: Characters that are scanned at once; bounds the arrays of a worker.
CHUNK_CHARS = 1 << 20
_loaded: dict[str, ByteBpe] = {}


def default_rank_file() -> str:
    """Rank file of byte_bpe_50k among the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenizer(rank_file: str) -> ByteBpe:
    """The vocabulary, read once per process."""
    if rank_file not in _loaded:
        _loaded[rank_file] = ByteBpe(rank_file)
    return _loaded[rank_file]


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    chunk, size = [], 0
    for text in texts:
        chunk.append(text)
        size += len(text)
        if size >= CHUNK_CHARS:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _encoded(column: pa.ChunkedArray | pa.Array, rank_file: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [tokenizer(rank_file).encode(chunk) for chunk in _chunks([text or "" for text in column.to_pylist()])]
    if not parts:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    return np.concatenate([ids for ids, _ in parts]), np.concatenate([counts for _, counts in parts])


def encode_texts(documents: DataFrame, id_column: str, text_column: str, rank_file: str | None = None, offsets: bool = False) -> DataFrame:
    """``id_column`` and ``ids`` (array<int>) of each row, without special tokens.

    Empty and null texts give an empty list; each row gives one row, repeated ids
    included.  The strings of special tokens are ordinary text.  With
    ``offsets``, ``starts`` (array<int>) gives the byte at which each token begins
    in the UTF-8 text.  Other columns are dropped before the text leaves the JVM.
    """
    path = rank_file or default_rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = _encoded(batch.column(1), path)
            bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))]
            if offsets:
                widths = tokenizer(path).widths(ids).astype(np.int64)
                upto = np.concatenate([[0], np.cumsum(widths)])
                begin = (upto[:-1] - np.repeat(upto[bounds[:-1]], counts)).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(begin)))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "starts"][: len(columns)])

    kind = dict(documents.dtypes)[id_column]
    schema = f"id {kind}, ids array<int>" + (", starts array<int>" if offsets else "")
    chosen = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return chosen.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def decode_ids(encoded: DataFrame, id_column: str, ids_column: str = "ids", rank_file: str | None = None) -> DataFrame:
    """``id_column`` and ``text`` of each row's ids; null ids give null."""
    path = rank_file or default_rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bpe = tokenizer(path)
            texts = [None if ids is None else bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = dict(encoded.dtypes)[id_column]
    return encoded.select(F.col(id_column).alias("id"), ids_column).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_column)


def count_tokens(documents: DataFrame, text_column: str, keep: list[str], rank_file: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` (bigint) of each row; 0 for empty and null texts."""
    path = rank_file or default_rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, counts = _encoded(batch.column(len(keep)), path)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    types = dict(documents.dtypes)
    schema = ", ".join([*(f"`{name}` {types[name]}" for name in keep), "n_tokens bigint"])
    return documents.select(*keep, F.col(text_column).cast("string").alias("_text")).mapInArrow(run, schema)
