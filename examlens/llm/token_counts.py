"""Token counts of whole texts, by resynchronising overlapping chunks of huge ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from .common import batches_by_size, byte_lengths, map_batches
from .tokenizing import PieceCounts, load

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256


def _word_starts(encoding, shift: int) -> dict[int, int]:
    """Position in the text -> index of the token, for tokens that begin a pre-token."""
    starts: dict[int, int] = {}
    last = -1
    for index, (word, span) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word is None or word != last:
            starts.setdefault(span[0] + shift, index)
        last = word
    return starts


def encode_in_chunks(
    tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> Iterator[list[int]]:
    """The ids of a text, chunk by chunk; together they are the ids of the whole text.

    The pre-tokens of a chunk that starts at a true boundary are those of the text up
    to a margin before its end: the split pattern looks one character past a match, a
    special string at most its own length. A second chunk may start out of phase; where
    it has a boundary in common with the true ones of the first, both read on alike.
    So what stands before a common boundary is taken from the first chunk, what stands
    after it from the second. Without a common boundary the overlap doubles, at last up
    to the whole first chunk, and then the first chunk itself grows.
    """
    special = max((len(x.content) for x in tokenizer.get_added_tokens_decoder().values()), default=0)
    margin = special + 2
    start, size = 0, max(chunk, 2 * margin)
    while start + size < len(text):
        end = start + size
        left = tokenizer.encode(text[start:end], add_special_tokens=False)
        true = {p: i for p, i in _word_starts(left, start).items() if start < p <= end - margin}
        splice, width = None, max(overlap, 2 * margin)
        while splice is None and true and width // 2 < size:
            begin = max(start + 1, end - width)
            right = tokenizer.encode(text[begin : end + width], add_special_tokens=False)
            common = true.keys() & _word_starts(right, begin).keys()
            splice = max(common, default=None)
            width *= 2
        if splice is None:
            size *= 2
            continue
        yield left.ids[: true[splice]]
        start, size = splice, max(chunk, 2 * margin)
    yield tokenizer.encode(text[start:], add_special_tokens=False).ids


def token_counts(
    docs: DataFrame,
    tokenizer_file: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """One row per row of `docs`: the id, `n_bytes` (UTF-8) and `n_tokens` of the whole text.

    The counts are those of the tokenizers library for the .json file, without begin or
    end tokens. No shuffle: texts of up to `chunk` characters are encoded at once, each
    different piece once a process; longer ones in overlapping chunks, so memory follows
    the chunk and not the text. A null text counts as empty, a null id stays null,
    repeated rows are counted each, an empty table gives none; other columns are not
    read.
    """
    kind = docs.schema[id_column].dataType
    schema = StructType(
        [StructField(id_column, kind), StructField("n_bytes", LongType()), StructField("n_tokens", LongType())]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, tokenizer = PieceCounts(tokenizer_file), load(tokenizer_file)
        for batch in batches_by_size(batches, text_column):
            texts = batch.column(text_column)
            huge = np.flatnonzero(np.asarray(pc.fill_null(pc.utf8_length(texts), 0)) > chunk)
            short = texts
            if len(huge):
                mask = np.zeros(len(texts), dtype=bool)
                mask[huge] = True
                short = pc.if_else(pa.array(mask), pa.scalar("", texts.type), texts)
            counts = counter(short)
            for row in huge:
                parts = encode_in_chunks(tokenizer, texts[int(row)].as_py(), chunk, overlap)
                counts[row] = sum(len(ids) for ids in parts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_column), pa.array(byte_lengths(texts)), pa.array(counts)], names=schema.names
            )

    return map_batches(docs.select(id_column, text_column), count, schema)
