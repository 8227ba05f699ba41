"""Packing without padding: each document is cut into pieces whose lengths are powers of two.

A document of n ids has n // longest pieces of the longest length and one piece for each binary digit
of the rest, so a piece is a whole sequence, no sequence crosses documents, and none is padded.
Sequences of one length form a bucket and are batched together.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import SLICE_BYTES, byte_lengths, kept, lean, sliced, view
from codesieve.llm.pieces import Encoded, PieceEncoder

#: Pieces of text whose ids a worker remembers, in each of two generations.
REMEMBERED = 400_000


class Tokens:
    """Ids of a `tokenizers` file, as its plain call gives them: a special token's string in a text is that token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = tuple(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.chunks = PieceEncoder(self.encode_alone, self.encode_pieces, most=REMEMBERED, special=special)
        # A byte-level token has one character for each byte.
        self.sizes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())])

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_alone(self, texts: list[str]) -> Encoded:
        found = [np.array(x, np.uint32) for x in self.ids(texts)]
        counts = np.array(list(map(len, found)), np.int64)
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.cumsum(counts) - counts, counts

    def encode_pieces(self, pieces: list[str], together: int = 3000) -> Encoded:
        """Ids of pieces: many in a row, as their borders cut tokens anyway, and told apart by the tokens' sizes.

        A line break stands before a piece that doesn't begin with white space itself. Pieces whose first or last character may be other white space are encoded alone.
        """
        ends = np.array([x[-1].isalnum() or "!" <= x[-1] <= "~" for x in pieces])
        bare = np.array([x[0] not in " \t\n\r" for x in pieces])
        alone = ~ends | bare & ~np.array([x[0].isalnum() or "!" <= x[0] <= "~" for x in pieces])
        at, counts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        lone = np.flatnonzero(alone)
        ids, at[lone], counts[lone] = self.encode_alone([pieces[i] for i in lone.tolist()])
        out, total, rest = [ids], len(ids), np.flatnonzero(~alone)
        for run in (rest[k : k + together] for k in range(0, len(rest), together)):  # one after the other: the library's answer takes many times the ids' bytes
            texts = ["\n" + pieces[i] if b else pieces[i] for i, b in zip(run.tolist(), bare[run].tolist(), strict=True)]
            ids = np.array(self.ids(["".join(texts)])[0], np.uint32)
            last = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(byte_lengths(pa.array(texts, pa.large_string())))) + 1
            first = np.concatenate([[0], last[:-1]]) + bare[run]
            at[run], counts[run] = total + first, last - first
            out.append(ids)
            total += len(ids)
        return np.concatenate(out), at, counts


_tokens: dict[str, Tokens] = kept("packing")


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def decompose(counts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents with so many ids: the document, start and length of each piece, longest pieces first."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece is a power of two")
    bits = 1 << np.arange(longest.bit_length() - 1)[::-1]
    repeats = np.concatenate([(counts // longest)[:, None], (counts[:, None] & bits) > 0], axis=1).astype(np.int64)
    lengths = np.repeat(np.tile(np.concatenate([[longest], bits]), len(counts)), repeats.ravel())
    docs = np.repeat(np.arange(len(counts)), repeats.sum(axis=1))
    before = np.cumsum(lengths) - lengths
    begins = np.cumsum(counts) - counts
    return docs, before - begins[docs], lengths


def pack(docs: DataFrame, tokenizer_path: str, longest: int = 2048, end_id: int = 1, keep: bool = True, slice_bytes: int = SLICE_BYTES, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, bucket (log2 of length), sequence_id, offset; with keep, the ids.

    Every piece is its own sequence, at offset 0. A null or empty text is the end id alone. Repeated
    rows are separate documents. sequence_id is unique and not dense. slice_bytes, remembered: bytes of text encoded at a time, and pieces of text whose ids
    a worker remembers; fewer take less memory and more time.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids array<int>" * keep
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens(tokenizer_path).chunks
        encoder.most = remembered
        for batch in batches:
            for part in sliced(batch, most=slice_bytes):
                found, starts = encoder.encode(part.column("text"))
                counts = np.diff(starts) + 1
                ids = np.insert(found, starts[1:], end_id).astype("<u4")
                of, start, length = decompose(counts, longest)
                begins = np.cumsum(length) - length
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * begins).tolist(), (4 * (begins + length)).tolist(), strict=True)]
                columns = [pa.array(part.column("doc_id")).take(pa.array(of)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(counts[of]), pa.array(np.log2(length).astype(np.int32))]
                if keep:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([begins, begins[-1:] + length[-1:]]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    pieces = view(docs).mapInArrow(lean(run, "packing"), schema)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def save_buckets(sequences: DataFrame, path: str) -> None:
    """Write sequences by length, one folder for each power of two, so a batch has one length and no padding."""
    sequences.write.partitionBy("bucket").parquet(path)
