"""Token ids of many texts at once: each distinct chunk between single spaces is encoded once.

A space between two characters that aren't white space always starts a new match of the byte-level
BPE pattern, so a text's ids are those of its chunks one after the other. Texts in which a chunk is
empty or begins or ends with white space, or that have a special token's string, are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from codesieve.llm.common import flat, ranges, text_bytes

#: Bytes that are white space by themselves, those of Python's str.isspace.
WHITE = np.array([i < 128 and chr(i).isspace() for i in range(256)])


def spaced(chunks: pa.Array, texts: list[str]) -> np.ndarray:
    """Whether each chunk is empty or begins or ends with white space."""
    data, starts = text_bytes(chunks)
    if not len(data):
        return np.ones(len(texts), bool)
    edges = [data[np.minimum(starts[:-1], len(data) - 1)], data[np.maximum(starts[1:] - 1, 0)]]
    odd = (starts[1:] == starts[:-1]) | WHITE[edges[0]] | WHITE[edges[1]]
    for i in np.flatnonzero(~odd & ((edges[0] > 127) | (edges[1] > 127))).tolist():
        odd[i] = texts[i][0].isspace() or texts[i][-1].isspace()
    return odd


class ChunkEncoder:
    """encode_many: ids, as little-endian 32-bit bytes, of each of a list of texts, independent of each other; encode_chunks: the same for chunks without white space at either end but for one space before. most: chunks remembered, in two generations. special: strings for which a text is encoded whole."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], most: int = 200_000, encode_chunks: Callable[[list[str]], list[bytes]] | None = None, special: tuple[str, ...] = ()):
        self.encode_many, self.most, self.encode_chunks, self.special = encode_many, most, encode_chunks or encode_many, special
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def known(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, from memory or encoded now."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = [young.get(x) or old.get(x) for x in chunks]
        if missing := [i for i, x in enumerate(out) if x is None]:
            for i, ids in zip(missing, self.encode_chunks([chunks[i] for i in missing]), strict=True):
                out[i] = ids
        young.update(zip(chunks, out, strict=True))
        return out

    def encode(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of the rows one after the other, and where each row's ids start and the last end."""
        texts = flat(column)
        n = len(texts)
        lists = pc.split_pattern(texts, " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(int(starts[0]), int(starts[-1] - starts[0])).dictionary_encode()
        starts = starts - starts[0]
        chunks, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        odd = spaced(coded.dictionary, chunks)
        rows = np.repeat(np.arange(n), np.diff(starts))
        whole = np.zeros(n, bool)
        whole[rows[odd[codes]]] = True
        for x in self.special:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        # A text's first chunk has no space before it: it is looked up under a name of its own, after the others.
        first = np.zeros(len(codes), bool)
        first[starts[:-1][np.diff(starts) > 0]] = True
        use = ~whole[rows]
        later, heads = np.unique(codes[use & ~first]), np.unique(codes[use & first])
        place = np.full((2, len(chunks)), -1, np.int64)
        place[0, later], place[1, heads] = np.arange(len(later)), len(later) + np.arange(len(heads))
        singles = np.flatnonzero(whole)
        found = self.known([" " + chunks[i] for i in later] + [chunks[i] for i in heads])
        found += self.encode_many([texts[int(i)].as_py() for i in singles]) if len(singles) else []
        lengths = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        pool, at = np.frombuffer(b"".join(found), "<u4"), np.concatenate([[0], np.cumsum(lengths)])
        pieces, of = np.concatenate([place[first[use].astype(np.int64), codes[use]], len(later) + len(heads) + np.arange(len(singles))]), np.concatenate([rows[use], singles])
        order = np.argsort(of, kind="stable")
        pieces, of = pieces[order], of[order]
        del lists, coded, chunks, codes, odd, rows, first, use, place, found, order  # the largest arrays come last
        ids = pool[ranges(at[pieces], lengths[pieces])]
        counts = np.bincount(of, lengths[pieces], n).astype(np.int64) if len(of) else np.zeros(n, np.int64)
        return ids, np.concatenate([[0], np.cumsum(counts)])
