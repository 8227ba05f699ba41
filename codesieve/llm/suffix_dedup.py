"""Exact substring dedup: bytes of repeated 50-byte strings, found by suffix sorting in shards.

A string of `length` bytes has one minimizer: its least k-gram by hash, leftmost of equals. Strings in a
row with one minimizer form a segment; equal strings have equal minimizers, so shards by minimizer
hold all occurrences of what they hold. Segments whose minimizer stands in one document only
can't repeat and go nowhere. Each shard sorts the suffixes of its distinct segments by external
induced sorting; neighbours with a common prefix of `length` bytes are occurrences of one string,
and its smallest document keeps it.

Copies of a whole text are one text here, and equal segments of a block are sent once with their
smallest document, so a passage that many documents share costs a shard one segment for each block. A shard answers
with one bit for each string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import dealt, lean, mix, partitions, ranges, spare, text_bytes, text_size, view
from codesieve.llm.induced_sort import suffix_array

#: Bytes of a string that counts as repeated, and of the k-grams among which minimizers are chosen.
LENGTH, GRAM = 50, 24
#: Blocks of texts and shards of segments for each shuffle partition, at least; bytes of text of a block, as many shards as there are such blocks; and bytes that a block works on at a time.
BLOCKS, SHARDS, BLOCK_BYTES, SLICE = 2, 2, 8 << 20, 1 << 20
#: The place of documents without an id: after all others, none of them before another.
NO_ID = np.iinfo(np.int64).max


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each place that has so many: sums of words of up to eight bytes, each times a factor of its own, then mixed."""
    n, wide = len(data) - size + 1, min(size, 8)
    if n < 1:
        return np.zeros(0, np.uint64)
    if wide == 8:
        word = np.empty(len(data) - 7, np.uint64)
        for k in range(8):
            own = data[k : k + (len(data) - k) // 8 * 8].view("<u8") if len(data) - k >= 8 else np.zeros(0, np.uint64)
            word[k::8] = own
    else:
        word = np.zeros(n, np.uint64)
        for k in range(wide):
            word = word << np.uint64(8) | data[k : k + n]
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i, at in enumerate([*range(0, size - wide, wide), size - wide]):
            out += word[at : at + n] * (mix(np.array([i + 1], np.uint64))[0] | np.uint64(1))
    return mix(out)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value (by its upper 32 bits) of each window, the leftmost of equals."""
    low = values & np.uint64(0xFFFFFFFF00000000) | np.arange(len(values), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def segments(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of rows of bytes: each segment's row, place of its first string, number of strings, minimizer hash, and the minimizer's place in it."""
    empty = np.zeros(0, np.int64)
    if len(data) < length or not (np.diff(starts) >= length).any():
        return empty, empty, empty, np.zeros(0, np.uint64), empty
    hashes = gram_hashes(data, gram)
    least = window_minima(hashes, length - gram + 1)
    # A segment begins where a row with strings does, or the minimizer changes; it ends there or after its row's last string.
    rows = np.flatnonzero(np.diff(starts) >= length)
    fresh = np.append(True, least[1:] != least[:-1])
    fresh[starts[rows]] = True
    first = np.flatnonzero(fresh)
    row = np.searchsorted(starts, first, side="right") - 1
    last = starts[row + 1] - length
    inside = first <= last
    count = np.minimum(np.append(first[1:], len(least)), last + 1) - first
    row, first, count = row[inside], first[inside], count[inside]
    return row, first, count, hashes[least[first]], least[first] - first


def firsts(nodes: np.ndarray, rest: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of each text, a row with its smallest id, in order of texts."""
    order = np.lexsort((ids, rest, nodes))
    a, b = nodes[order], rest[order]
    return order[np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(order)]]


class Block:
    """The distinct texts of a block by number, with their smallest doc_id, and their segments."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        nodes, rest, ids = (np.asarray(table.column(c)) for c in ("node", "rest", "doc"))
        first = firsts(nodes, rest, ids)
        self.nodes, self.rest, self.docs = nodes[first], rest[first], ids[first]
        self.data, self.starts = text_bytes(table.column("text").take(pa.array(first)))
        found, begin = [], 0
        while begin < len(first):
            end = max(begin + 1, int(np.searchsorted(self.starts, self.starts[begin] + SLICE, side="right")) - 1)
            row, place, count, value, within = segments(self.data[self.starts[begin] : self.starts[end]], self.starts[begin : end + 1] - self.starts[begin], length, gram)
            found.append((row + begin, place + self.starts[begin], count, value, within))
            begin = end
        self.row, self.place, self.count, self.value, self.within = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(5))
        self.value = self.value.astype(np.uint64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct minimizers (their upper 48 bits) in order, and whether several documents of the block have each."""
        value = self.value >> np.uint64(16)
        order = np.argsort(value)
        value, row = value[order], self.row[order]
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1])[: len(value)])
        if not len(first):
            return value, np.zeros(0, bool)
        docs = self.docs[row]
        return value[first], np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)

    def candidates(self, repeated: np.ndarray, length: int) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Segments whose minimizer repeats (in order, as anchors has them): their numbers; the distinct byte strings among them, each one's smallest document, minimizer and its place, and each segment's string number."""
        value = self.value >> np.uint64(16)
        at = np.minimum(np.searchsorted(repeated, value), max(len(repeated) - 1, 0))
        chosen = np.flatnonzero(repeated[at] == value) if len(repeated) else np.zeros(0, np.int64)
        raw, number = self.data.tobytes(), {}
        ends = self.place[chosen] + self.count[chosen] + length - 1
        own = np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip(self.place[chosen].tolist(), ends.tolist(), strict=True)), np.int64, len(chosen))
        docs, values = np.full(len(number), NO_ID, np.int64), np.zeros(len(number), np.uint64)
        np.minimum.at(docs, own, self.docs[self.row[chosen]])
        values[own] = self.value[chosen]
        within = np.zeros(len(number), np.uint8)
        within[own] = self.within[chosen]  # below 64
        return chosen, list(number), docs, values, within, own


def pack48(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def shard_of(values: np.ndarray, parts: int) -> np.ndarray:
    return (mix(values + np.uint64(7)) % np.uint64(parts)).astype(np.int64)


def may_share(pieces: list[bytes], values: np.ndarray, within: np.ndarray, length: int, gram: int, step: int = 4) -> np.ndarray:
    """The distinct pieces that may share a string with another one: those that agree with one in the minimizer and in all but `step` - 1 of the bytes that a string has besides, some before it and the rest behind it.

    A piece whose minimizer no other piece has needs no sorting: equal pieces are one here.
    """
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    rest = length - gram
    # A string with at least `a` and fewer than a + step bytes before its minimizer has so many behind it at least.
    sides = [(a, max(0, rest - a - step + 1)) for a in range(0, rest + 1, step)]
    doubtful, several = set(), np.flatnonzero(counts[inverse] > 1).tolist()
    for a, b in sides:  # one after the other, so that only one side's strings are held
        seen: dict[tuple, int] = {}
        for i in several:
            piece, at = pieces[i], int(within[i])
            if a <= at and at + gram + b <= len(piece):
                other = seen.setdefault((int(values[i]), piece[at - a : at + gram + b]), i)
                if other != i:
                    doubtful.add(other)
                    doubtful.add(i)
    return np.array(sorted(doubtful), np.int64)


def later_strings(pieces: list[bytes], docs: np.ndarray, length: int) -> np.ndarray:
    """For each piece, a bit for each string in it that a piece of a smaller document has too."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    n = len(pieces)
    if not n:
        return np.zeros(0, np.uint64)
    # Each piece ends in a symbol of its own, the last one in 0.
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.empty(int((lengths + 1).sum()), np.int64)
    text[starts + lengths] = n - 1 - np.arange(n)
    text[ranges(starts, lengths)] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + n
    order, common = suffix_array(text, n, length)
    group = np.flatnonzero(np.append(True, common[1:] < length))
    piece = np.searchsorted(starts, order, side="right") - 1
    least = np.repeat(np.minimum.reduceat(docs[piece], group), np.diff(np.append(group, len(order))))
    offset = order - starts[piece]
    hit = np.flatnonzero((docs[piece] > least) & (offset + length <= lengths[piece]))
    masks = np.zeros(n, np.uint64)
    np.bitwise_or.at(masks, piece[hit], np.uint64(1) << offset[hit].astype(np.uint64))
    return masks


def blob(x: np.ndarray) -> bytes:
    return x.tobytes()


def texts(docs: DataFrame, blocks: int) -> DataFrame:
    """Distinct texts of each batch with their smallest doc_id, dealt to blocks by the text itself."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc_id").fill_null(NO_ID))
            column = batch.column("text")
            digests = [hashlib.sha256(x.encode()).hexdigest() for x in column.to_pylist()]
            nodes, rest = (np.array([int(x[a : a + 15], 16) for x in digests], np.int64) for a in (0, 15))
            if len(nodes):
                first = firsts(nodes, rest, ids)
                yield pa.RecordBatch.from_arrays([pa.array((nodes[first] % blocks).astype(np.int32)), pa.array(nodes[first]), pa.array(rest[first]), pa.array(ids[first]), column.take(pa.array(first))], ["block", "node", "rest", "doc", "text"])

    return view(docs).mapInArrow(lean(distinct), "block int, node long, rest long, doc long, text string")


def numbers(text: F.Column) -> tuple[F.Column, F.Column]:
    """The two numbers of a text: 120 bits of its SHA-256, as `texts` has them."""
    return tuple(F.conv(F.substring(F.sha2(text.cast("binary"), 256), a, 15), 16, 10).cast("long") for a in (1, 16))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: bool = True) -> DataFrame:
    """Per distinct text: node and rest (its numbers), doc (its smallest doc_id), and for that document n_bytes, n_removed, n_spans and kept_sha256.

    A byte goes if a `length`-byte string over it also starts in a document with a smaller doc_id; strings
    are those of the input. With keep, `kept` has the remaining bytes, in which a character may be cut, `kept_text` the
    whole characters, and `spans` the removed runs as (start, end). Strings of a text without doc_id are after all others.
    """
    spark = docs.sparkSession
    size = -(-text_size(view(docs)) // BLOCK_BYTES)
    n_blocks, shards, parts = (max(least * partitions(spark), size) for least in (BLOCKS, SHARDS, 1))
    if length - gram >= 64 or not 0 < gram <= length:
        raise ValueError("a gram is shorter than a string, by less than 64")
    blocks = texts(docs, n_blocks)

    def send_anchors(table: pa.Table) -> pa.Table:
        value, several = Block(table, length, gram).anchors()
        rows = dealt((mix(value) % np.uint64(parts)).astype(np.int64))
        return pa.table({"part": pa.array([p for p, _ in rows], pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * len(rows), pa.int32()), "anchors": pa.array([pack48(value[x]) for _, x in rows], pa.binary()), "several": pa.array([blob(np.packbits(several[x])) for _, x in rows], pa.binary())})

    def find_repeated(table: pa.Table) -> pa.Table:
        lists = [unpack48(x) for x in table.column("anchors").to_pylist()]
        lengths = [len(x) for x in lists]
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("several").to_pylist(), lengths, strict=True)])
        _, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        repeated = (counts > 1) | (np.bincount(inverse, several, len(counts)) > 0)
        flags = np.split(repeated[inverse], np.cumsum(lengths)[:-1])
        return pa.table({"block": table.column("block"), "repeated": pa.array([pack48(x[f]) for x, f in zip(lists, flags, strict=True)], pa.binary())})

    anchors = blocks.groupBy("block").applyInArrow(lean(send_anchors), "part int, block int, anchors binary, several binary")
    repeated = anchors.groupBy("part").applyInArrow(lean(find_repeated), "block int, repeated binary")

    def send_segments(table: pa.Table, found: pa.Table) -> pa.Table:
        own, value = Block(table, length, gram), np.sort(unpack48(b"".join(found.column("repeated").to_pylist())))
        _, pieces, least, values, within, _ = own.candidates(value, length)
        shard = shard_of(values, shards)
        rows = dealt(shard)
        block = table.column("block")[0].as_py() if table.num_rows else 0
        return pa.table({
            "shard": pa.array([s for s, _ in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()), "repeated": pa.array([pack48(value) if i == block % len(rows) else b"" for i in range(len(rows))], pa.binary()),
            "bytes": pa.array([b"".join([pieces[i] for i in x]) for _, x in rows], pa.binary()), "lengths": pa.array([blob(np.array([len(pieces[i]) for i in x], "<u2")) for _, x in rows], pa.binary()), "docs": pa.array([blob(least[x].astype("<i8")) for _, x in rows], pa.binary()),
            "values": pa.array([blob(values[x]) for _, x in rows], pa.binary()), "within": pa.array([blob(within[x]) for _, x in rows], pa.binary()),
        })

    def sort_shard(table: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        own, ids = [], []
        for raw, lengths, docs_ in zip(table.column("bytes").to_pylist(), table.column("lengths").to_pylist(), table.column("docs").to_pylist(), strict=True):
            ends = np.cumsum(np.frombuffer(lengths, "<u2").astype(np.int64)).tolist()
            own.append(np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip([0, *ends[:-1]], ends, strict=True)), np.int64, len(ends)))
            ids.append(np.frombuffer(docs_, "<i8"))
        least = np.full(len(number), NO_ID, np.int64)
        np.minimum.at(least, np.concatenate(own), np.concatenate(ids))
        pieces, every = list(number), np.concatenate(own)
        values, within = np.zeros(len(pieces), np.uint64), np.zeros(len(pieces), np.int64)
        values[every] = np.concatenate([np.frombuffer(x, "<u8") for x in table.column("values").to_pylist()])
        within[every] = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("within").to_pylist()])
        doubtful = may_share(pieces, values, within, length, gram)
        masks = np.zeros(len(pieces), np.uint64)
        masks[doubtful] = later_strings([pieces[i] for i in doubtful], least[doubtful], length)
        # A block's piece that another block has in a smaller document is removed whole.
        whole = np.array([(1 << (len(x) - length + 1)) - 1 for x in pieces], np.uint64)
        answers = [np.where(i > least[o], whole[o], masks[o]) for o, i in zip(own, ids, strict=True)]
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "repeated": table.column("repeated"), "masks": pa.array([blob(x.astype("<u8")) for x in answers], pa.binary())})

    sent = blocks.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(lean(send_segments), "shard int, block int, repeated binary, bytes binary, lengths binary, docs binary, values binary, within binary")
    # A shard's bytes are few for the work that it is: they are dealt to all partitions, which Spark would else join by size.
    answers = sent.repartition(partitions(spark), "shard").groupBy("shard").applyInArrow(lean(sort_shard), "block int, shard int, repeated binary, masks binary")
    schema = "node long, rest long, doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, kept_text string, spans array<struct<start: long, end: long>>" * keep

    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        own = Block(table, length, gram)
        change = np.zeros(len(own.data) + 1, np.int64)
        if found.num_rows:
            found = found.sort_by("shard")
            chosen, pieces, least, values, _, string = own.candidates(unpack48(next(x for x in found.column("repeated").to_pylist() if x)), length)
            by = np.argsort(shard_of(values, shards), kind="stable")
            masks = np.zeros(len(pieces), np.uint64)
            masks[by] = np.concatenate([np.frombuffer(x, "<u8") for x in found.column("masks").to_pylist()])
            count = own.count[chosen]
            bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
            for k in range(int(count.max(initial=0))):
                # Another document of the block with a smaller id has the same segment, or the shard's answer says so.
                gone = (k < count) & ((own.docs[own.row[chosen]] > least[string]) | (masks[string] & bit[k] > 0))
                np.add.at(change, own.place[chosen][gone] + k, 1)
                np.add.at(change, own.place[chosen][gone] + k + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        rows: dict[str, list] = {x.split()[0]: [] for x in schema.split(", ") if not x.startswith("end")}
        for i in range(len(own.nodes)):
            a, b = own.starts[i], own.starts[i + 1]
            off = gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], off, [False]])))
            kept = own.data[a:b][~off].tobytes()
            values = [own.nodes[i], own.rest[i], own.docs[i], b - a, off.sum(), len(edges) // 2, hashlib.sha256(kept).hexdigest()] + ([kept, kept.decode("utf-8", "ignore"), [{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)]] if keep else [])
            for name, v in zip(rows, values, strict=True):
                rows[name].append(v)
        kinds = [pa.int64()] * 6 + [pa.string()] + [pa.binary(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))] * keep
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds, strict=True)})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lean(cut), schema)


def counts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs.

    A null or empty text, or one of fewer than `length` bytes, loses nothing. A copy of a whole text loses all
    of it if a smaller doc_id has that text. Rows with one doc_id are one document: they take nothing from each other. Null doc_ids
    come after all others.
    """
    found = dedup(docs, length, gram, keep=False)
    node, rest = numbers(F.col("text"))
    rows = view(docs).select("doc_id", node.alias("node"), rest.alias("rest"))
    # A copy with a larger id than the one that was judged loses everything, if it has a string at all.
    copy = F.coalesce("doc_id", F.lit(NO_ID)) > F.col("doc")
    gone = copy & (F.col("n_bytes") >= length)
    return rows.join(found.hint("merge"), ["node", "rest"]).select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(gone, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"), F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256")
    )


def rewrite(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with `text` less the repeated bytes and characters that lost some of theirs, without the rows that lost all; other columns as they are."""
    own_node, own_rest, own_doc, n_bytes, removed, left_text, node_id, rest_id = spare(docs.columns, "node", "rest", "doc", "bytes", "removed", "text", "own", "own_rest")
    node, rest = numbers(F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = dedup(docs, length, gram).select(F.col("node").alias(own_node), F.col("rest").alias(own_rest), F.col("doc").alias(own_doc), F.col("n_bytes").alias(n_bytes), F.col("n_removed").alias(removed), F.when(F.col("n_removed") > 0, F.col("kept_text")).alias(left_text))
    joined = docs.withColumns({node_id: node, rest_id: rest}).join(found.hint("merge"), (F.col(node_id) == F.col(own_node)) & (F.col(rest_id) == F.col(own_rest)))
    copy = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) > F.col(own_doc)) & (F.col(n_bytes) >= length)
    left = joined.where(~copy & ((F.col(removed) == 0) | (F.col(left_text) != "")))
    return left.select(*[F.when(F.col(removed) > 0, F.col(left_text)).otherwise(F.col("text")).alias("text") if c == "text" else docs[c] for c in docs.columns])
