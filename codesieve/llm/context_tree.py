"""Language-model scoring by context-tree weighting over bytes.

A text is its lower-cased words, each followed by one space, and an end symbol. Each symbol is eight
binary decisions; each decision has a context tree over the DEPTH bytes before it, across words, spaces before
the first one. A node holds how often the decision went either way in the training texts; its
Krichevsky-Trofimov estimate is mixed with its children's weighted estimates, half and half, over all
depths. The weights that the training counts give the depths make the prediction, so a text's
probability is a product of proper conditional ones. Where a context was never seen, its nearest seen
ancestor predicts alone.

Documents are dealt to blocks of about BLOCK_BYTES, compressed on the way. A block counts its distinct contexts
with their symbols, in order and as differences, and sends each to the shard that has the range of its last TOP bytes; a sample of the
texts draws these ranges, so that shards are alike. A shard adds them up and keeps its own distinct ones and where each block's
stand among them. Only the trees' levels above TOP, which 2 ** 24 nodes bound and ordinary text fills to a few per cent, come to the
driver and go to all shards. These then give each block its contexts and symbols back, each with its code length.
Whole words travel the same way, for the base score alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import Saved, dealt, hash_words, mix, partitions, ranges, row_sums, sliced, text_bytes, text_size, view, words

#: Bytes of context, at most WIDEST: a context and its symbol are one 64-bit number.
DEPTH = WIDEST = 7
#: Last bytes of a context that lie in one shard together; shorter contexts are the top of the trees.
TOP = 3
#: The end of a text as a word and as a symbol: a byte that UTF-8 never has.
END = b"\xff"
#: Bytes of text of a block.
BLOCK_BYTES = 6 << 20
#: Bytes of text, about, from which the shards' ranges are drawn.
SAMPLE_BYTES = 8 << 20
#: Code lengths travel in decimal digits times this.
SCALE = 1 << 14


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of equal weight, compressed."""
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if len(x) else b"")


def unpacked(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(pa.decompress(x[8:], 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).reshape(-1).view("<u8")


def rising(x: np.ndarray) -> bytes:
    """An ascending list by its differences."""
    return packed(np.diff(x.astype(np.uint64), prepend=np.uint64(0)))


def unrising(x: bytes) -> np.ndarray:
    return np.cumsum(unpacked(x), dtype=np.uint64)


def stream(spaced: pa.Array, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of rows of words: WIDEST spaces, each word with a space, the end. With how many symbols each row has.

    spaced: each word with its space; first of all the end with the WIDEST spaces before the next row.
    """
    tokens = np.insert(codes, starts[1:], 0)
    data, begins = text_bytes(spaced.take(pa.array(tokens)))
    ends = begins[starts[1:] + np.arange(1, len(starts))] - WIDEST
    return np.concatenate([np.full(WIDEST, 32, np.uint8), data]), np.diff(ends, prepend=-WIDEST) - WIDEST


def symbol_keys(flat: np.ndarray, symbols: np.ndarray, depth: int) -> np.ndarray:
    """Of each symbol of a stream: its context, latest byte first, then the symbol, as one number."""
    eight = np.empty(len(flat) - WIDEST, np.uint64)
    for k in range(min(8, len(eight))):
        eight[k::8] = flat[k : k + (len(flat) - k) // 8 * 8].view("<u8")
    own = np.ones(len(eight), bool)
    own[ranges(np.cumsum(symbols + WIDEST) - WIDEST, np.full(len(symbols), WIDEST))] = False
    eight = eight[own]
    context = eight << np.uint64(8)
    if depth < WIDEST:
        context = context >> np.uint64(8 * (8 - depth)) << np.uint64(8)
    return context | eight >> np.uint64(56)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each stands there; the array is sorted in place."""
    keys.sort()
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[at], np.diff(np.append(at, len(keys)))


def merged(lists: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of lists, in order, and the sums of their weights."""
    if not lists:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.concatenate(lists)
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    weight = np.concatenate(weights)[by]
    return keys[at], np.add.reduceat(weight, at) if len(at) else np.zeros(0, np.int64)


class Lookup:
    """Places of values among distinct ones, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.shift, self.mask = keys, np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        place, todo = self.home(keys), np.arange(len(keys))
        while len(todo):
            at = place[todo]
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            todo = todo[self.slots[at] != todo]
            place[todo] = (place[todo] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys ^ keys >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each value, all of which are there."""
        place = self.home(keys)
        out = self.slots[place]
        todo = np.flatnonzero(self.keys[out] != keys)
        while len(todo):
            place[todo] = (place[todo] + 1) & self.mask
            out[todo] = self.slots[place[todo]]
            todo = todo[self.keys[out[todo]] != keys[todo]]
        return out


#: Logarithms of the gamma function at n + 1/2 and at n + 1, for numbers n below the tables' length.
TABLE = 1 << 12
LOG_HALF, LOG_WHOLE = (np.array([math.lgamma(n + x) for n in range(TABLE)]) for x in (0.5, 1.0))


def log_gamma(x: np.ndarray, shift: float, known: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function at x + shift, for whole numbers x: from the table, beyond by Stirling's series."""
    if not len(x) or x.max() < TABLE:
        return known[x.astype(np.int64)]
    out = known[np.minimum(x, TABLE - 1).astype(np.int64)]
    big = np.flatnonzero(x >= TABLE)
    y = x[big] + shift
    out[big] = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a sequence with such counts."""
    return log_gamma(zeros, 0.5, LOG_HALF) + log_gamma(ones, 0.5, LOG_HALF) - log_gamma(zeros + ones, 1.0, LOG_WHOLE) - np.log(np.pi)


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each one's place among them; x is in order by pieces, which a merging sort uses."""
    by = np.argsort(x, kind="stable")
    own = x[by]
    fresh = np.append(True, own[1:] != own[:-1])[: len(own)]
    inverse = np.empty(len(x), np.int64)
    inverse[by] = np.cumsum(fresh) - 1
    return own[fresh], inverse


class Level:
    """The nodes of one depth: their keys (context, decision), counts, and weighted probability."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        self.estimate = log_kt(zeros, ones)
        self.weighted = self.estimate if below is None else np.logaddexp(self.estimate, below) - np.log(2)
        #: Posterior share of the node's own estimate.
        self.share = np.exp(self.estimate - np.log(2) - self.weighted) if below is not None else np.ones(len(keys))
        self.seen = zeros + ones > 0

    def predict(self) -> np.ndarray:
        return (self.ones + 0.5) / (self.zeros + self.ones + 1)

    def mixed(self, at: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """P(1) at these nodes from the prediction one level down, NaN where no training text went there."""
        own = np.where(self.seen[at], self.predict()[at], np.nan)
        return np.where(np.isnan(deeper), own, self.share[at] * own + (1 - self.share[at]) * deeper)


class Subtrees:
    """Nodes from the deepest up to depth `top` of the trees of one of a symbol's eight decisions, for all contexts that a set of symbol keys, distinct and in order, has."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int, decision: int):
        symbol = keys & np.uint64(255)
        node = keys >> np.uint64(8) << np.uint64(8) | (np.uint64(1 << decision) | symbol >> np.uint64(8 - decision))
        self.bit = (symbol >> np.uint64(7 - decision) & np.uint64(1)).astype(bool)
        # Keys are in order, so a decision's equal ones stand together.
        fresh = np.append(True, node[1:] != node[:-1])[: len(node)]
        at = np.flatnonzero(fresh)
        self.place = (np.cumsum(fresh) - 1).astype(np.int32)
        ones, every = (np.add.reduceat(x, at) if len(at) else np.zeros(0) for x in (np.where(self.bit, counts, 0.0), counts.astype(float)))
        level = Level(node[at], every - ones, ones, None)
        self.levels, self.up = [level], []
        for _ in range(depth - top):
            parents, inverse = grouped(shortened(level.keys))
            gather = [np.bincount(inverse, x, len(parents)) for x in (level.zeros, level.ones, level.weighted)]
            level = Level(parents, *gather)
            self.levels.append(level)
            self.up.append(inverse)

    def predictions(self) -> tuple[np.ndarray, np.ndarray]:
        """P(1) of each deepest node as the levels up to the top one mix it, NaN where none of them was seen, and the place of its top node."""
        first = self.levels[0]
        chance, at = np.where(first.seen, first.predict(), np.nan), np.arange(len(first.keys))
        for level, up in zip(self.levels[1:], self.up, strict=True):
            at = up[at]
            chance = level.mixed(at, chance)
        return chance, at


class Top:
    """The levels above the shards: nodes of depth TOP - 1, given, up to the roots."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, depth: int = TOP):
        self.levels = [Level(keys, zeros, ones, below)]
        for _ in range(depth - 1):
            level = self.levels[-1]
            parents, inverse = np.unique(shortened(level.keys), return_inverse=True)
            self.levels.append(Level(parents, *(np.bincount(inverse, x, len(parents)) for x in (level.zeros, level.ones, level.weighted))))

    def mixing(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For nodes of depth TOP - 1: P(1) is the first plus the second times the prediction below, or the third where nothing below was seen."""
        base, slope, alone = np.zeros(len(keys)), np.ones(len(keys)), np.full(len(keys), np.nan)
        for level in self.levels:
            if len(level.keys):
                at = np.minimum(np.searchsorted(level.keys, keys), len(level.keys) - 1)
                known = np.flatnonzero((level.keys[at] == keys) & level.seen[at])
                at = at[known]
                own, share = level.predict()[at], level.share[at]
                base[known] = share * own + (1 - share) * base[known]
                slope[known] *= 1 - share
                alone[known] = np.where(np.isnan(alone[known]), own, share * own + (1 - share) * alone[known])
            keys = shortened(keys)
        return base, slope, np.where(np.isnan(alone), 0.5, alone)


def shortened(keys: np.ndarray) -> np.ndarray:
    """Of nodes (context, decision): those with the context's earliest byte left out."""
    return (keys >> np.uint64(16)) << np.uint64(8) | keys & np.uint64(255)


def symbol_costs(keys: np.ndarray, counts: np.ndarray, top: Top, depth: int) -> np.ndarray:
    """log10 probability of each symbol in its context; keys are distinct and in order."""
    out = np.zeros(len(keys))
    for k in range(8):
        trees = Subtrees(keys, counts, depth, TOP, k)
        chance, at = trees.predictions()
        base, slope, alone = (x[at] for x in top.mixing(shortened(trees.levels[-1].keys)))
        chance = np.where(np.isnan(chance), alone, base + slope * chance)[trees.place]
        out += np.log10(np.where(trees.bit, chance, 1 - chance))
    return out


def top_rows(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """What the top levels need of a shard's trees: nodes of depth TOP - 1, counts either way, and weighted estimates, of the nodes below them."""
    found = []
    for k in range(8):
        level = Subtrees(keys, counts, depth, TOP, k).levels[-1]
        node, inverse = np.unique(shortened(level.keys), return_inverse=True)
        found.append((node, *(np.bincount(inverse, x, len(node)) for x in (level.zeros, level.ones, level.weighted))))
    node, *sums = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.argsort(node)
    return node[by], *(x[by] for x in sums)


def last_bytes(keys: np.ndarray, depth: int) -> np.ndarray:
    """The last TOP bytes of each key's context, the latest first."""
    return keys >> np.uint64(8 * (depth - TOP + 1))


def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by block, compressed, so that texts travel in little space."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        for part in sliced(batch, most=BLOCK_BYTES):
            block = np.asarray(part.column("block"))
            order = np.argsort(block, kind="stable")
            cuts = np.append(np.flatnonzero(np.append(True, block[order][1:] != block[order][:-1])), len(order))
            rows, found = part.select(["doc_id", "text", "held_out"]), []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                    writer.write_batch(rows.take(pa.array(order[a:b])))
                found.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(block[order[cuts[:-1]]], pa.int32()), pa.array(found, pa.binary())], ["block", "rows"])


class Block:
    """A block's rows (doc_id, text, held_out), distinct words (the end first) and, in slices, symbols.

    cuts: where the ranges of last bytes of the shards begin, but for the first one.
    """

    def __init__(self, rows: pa.Table, depth: int, cuts: np.ndarray):
        self.rows, shards = rows.combine_chunks(), len(cuts) + 1
        self.depth, self.cuts, self.train = depth, cuts, ~np.asarray(self.rows.column("held_out")).astype(bool)
        dictionary, codes, self.starts = words(self.rows.column("text"))
        # In order, so the words are the same whichever way the rows came.
        by = pc.sort_indices(dictionary).to_numpy()
        back = np.empty_like(by)
        back[by] = np.arange(len(by))
        self.words = pa.concat_arrays([pa.array([END], pa.large_binary()), dictionary.take(pa.array(by)).cast(pa.large_binary())])
        self.codes = back[codes].astype(np.int64) + 1
        self.word_shard = (hash_words(self.words) % np.uint64(shards)).astype(np.int64)
        pa.default_memory_pool().release_unused()

    def slices(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Rows, their symbols' keys, and how many each row has, a few MB of text at a time."""
        spaced = pa.concat_arrays([pa.array([END + b" " * WIDEST], pa.large_binary()), pc.binary_join_element_wise(self.words[1:], *(pa.scalar(x, pa.large_binary()) for x in (b" ", b"")))])
        size = np.concatenate([[0], np.cumsum(byte_sizes(spaced)[self.codes])])[self.starts]
        begin = 0
        while begin < len(self.starts) - 1:
            end = max(begin + 1, int(np.searchsorted(size, size[begin] + (BLOCK_BYTES >> 2), side="right")) - 1)
            a, b = self.starts[begin], self.starts[end]
            flat, symbols = stream(spaced, self.codes[a:b], self.starts[begin : end + 1] - a)
            yield slice(begin, end), symbol_keys(flat, symbols, self.depth), symbols
            begin = end

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct symbol keys in order, training counts, and shards, which are in order too."""
        size = row_sums(byte_sizes(self.words)[self.codes] + 1, self.starts) + 1
        both = [np.empty(int(size[x].sum()), np.uint64) for x in (self.train, ~self.train)]
        at = [0, 0]
        for rows, keys, symbols in self.slices():
            for i, chosen in enumerate((self.train[rows], ~self.train[rows])):
                own = keys[np.repeat(chosen, symbols)]
                both[i][at[i] : at[i] + len(own)] = own
                at[i] += len(own)
        held, _ = counted(both.pop())
        keys, counts = counted(both.pop())
        place = np.searchsorted(keys, held)
        new = keys[np.minimum(place, len(keys) - 1)] != held if len(keys) else np.ones(len(held), bool)
        keys, counts = np.insert(keys, place[new], held[new]), np.insert(counts, place[new], 0)
        return keys, counts, np.searchsorted(self.cuts, last_bytes(keys, self.depth), side="right")

    def word_counts(self) -> np.ndarray:
        counts = np.bincount(self.codes, np.repeat(self.train, np.diff(self.starts)), len(self.words)).astype(np.int64)
        counts[0] = self.train.sum()
        return counts


def opened(table: pa.Table) -> pa.Table:
    """The rows of payloads."""
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in table.column("rows").to_pylist()])


def range_cuts(own: DataFrame, size: int, shards: int, depth: int) -> np.ndarray:
    """Where the ranges of last bytes begin, so that the distinct contexts of a sample of the texts fall evenly on them; at most so many shards."""
    modulus = max(1, size // SAMPLE_BYTES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                keys, _, _ = Block(pa.table(part), depth, np.zeros(0, np.uint64)).keys()
                last, n = counted(last_bytes(keys, depth))
                yield pa.RecordBatch.from_arrays([pa.array(last.astype(np.int64)), pa.array(n)], ["last", "n"])

    sample = own.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(modulus)) == 0).select("doc_id", "text", "held_out")
    found = sample.mapInArrow(count, "last long, n long").groupBy("last").agg(F.sum("n").alias("n")).orderBy("last").toPandas()  # no more than the sample has contexts
    if not len(found):
        return np.zeros(0, np.uint64)
    share = np.cumsum(found.n.to_numpy()) / found.n.sum()
    return np.unique(found["last"].to_numpy()[np.searchsorted(share, np.arange(1, shards) / shards)]).astype(np.uint64)


def byte_sizes(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.binary_length(column)).astype(np.int64)


def score(docs: DataFrame, held_out: Column, depth: int = DEPTH) -> DataFrame:
    """Each document's tokens and log10 probabilities: by unigrams with one added to each count, and by the context trees.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes (symbols), bits_per_byte, one row
    for each row of docs. The documents with held_out false are the training texts. A null or empty text is
    the end alone. A null doc_id is a document like others. Without training texts every bit costs one bit.
    """
    if not TOP <= depth <= WIDEST:
        raise ValueError(f"contexts have {TOP} to {WIDEST} bytes")
    spark = docs.sparkSession
    saved = Saved(spark)
    own = view(docs).select("doc_id", "text", held_out.alias("held_out"))
    size = text_size(own)
    n_blocks = max(partitions(spark), -(-size // BLOCK_BYTES))
    cuts = spark.sparkContext.broadcast(range_cuts(own, size, n_blocks, depth))
    blocks = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")).mapInArrow(payloads, "block int, rows binary")

    def count_block(table: pa.Table) -> pa.Table:
        block = Block(opened(table), depth, cuts.value)
        keys, counts, shard = block.keys()
        every = np.unique(np.concatenate([shard, block.word_shard]))
        runs = [slice(a, b) for a, b in zip(np.searchsorted(shard, every), np.searchsorted(shard, every, side="right"), strict=True)]
        by_shard, none = dict(dealt(block.word_shard)), np.zeros(0, np.int64)
        chosen = [by_shard.get(int(s), none) for s in every]
        totals = block.word_counts()
        return pa.table({
            "shard": pa.array(every, pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * len(every), pa.int32()),
            "keys": pa.array([rising(keys[x]) for x in runs], pa.binary()), "counts": pa.array([packed(counts[x]) for x in runs], pa.binary()),
            "words": pa.array([b" ".join(block.words.take(pa.array(x)).to_pylist()) for x in chosen], pa.binary()), "totals": pa.array([packed(totals[x]) for x in chosen], pa.binary()),
        })

    messages = blocks.groupBy("block").applyInArrow(count_block, "shard int, block int, keys binary, counts binary, words binary, totals binary")
    state = "shard int, keys binary, counts binary, totals binary, blocks array<int>, places array<binary>, word_places array<binary>, n long, v long, top array<struct<node: long, zeros: double, ones: double, weighted: double>>"

    def merge_shard(table: pa.Table) -> pa.Table:
        lists = [unrising(x) for x in table.column("keys").to_pylist()]
        keys, counts = merged(lists, [unpacked(x).astype(np.int64) for x in table.column("counts").to_pylist()])
        texts = [x.split(b" ") if x else [] for x in table.column("words").to_pylist()]
        number: dict[bytes, int] = {}
        coded = [np.fromiter((number.setdefault(w, len(number)) for w in x), np.int64, len(x)) for x in texts]
        totals = np.bincount(np.concatenate(coded), np.concatenate([unpacked(x).astype(np.int64) for x in table.column("totals").to_pylist()]), len(number)).astype(np.int64)
        top = pa.StructArray.from_arrays([pa.array(x.astype(kind)) for x, kind in zip(top_rows(keys, counts, depth), (np.int64, float, float, float), strict=True)], ["node", "zeros", "ones", "weighted"])
        lists_of = lambda kind, values: pa.array([values], pa.list_(kind))
        return pa.table({
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "keys": pa.array([rising(keys)], pa.binary()), "counts": pa.array([packed(counts)], pa.binary()), "totals": pa.array([packed(totals)], pa.binary()),
            "blocks": lists_of(pa.int32(), table.column("block").to_pylist()), "places": lists_of(pa.binary(), [rising(np.searchsorted(keys, x)) for x in lists]), "word_places": lists_of(pa.binary(), [packed(x) for x in coded]),
            "n": pa.array([int(totals.sum())], pa.int64()), "v": pa.array([int((totals > 0).sum())], pa.int64()), "top": pa.ListArray.from_arrays(pa.array([0, len(top)], pa.int32()), top),
        })

    # One row for each shard.
    shard_rows = saved.save(messages.groupBy("shard").applyInArrow(merge_shard, state), "shards")
    total = shard_rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    # Contexts of two bytes with 255 decisions each: 2 ** 24 at most, and only those that texts have.
    rows = shard_rows.select(F.inline("top")).groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted")).orderBy("node").toPandas()
    top = spark.sparkContext.broadcast(Top(rows.node.to_numpy().astype(np.uint64), *(rows[c].to_numpy().astype(float) for c in ("zeros", "ones", "weighted"))))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                keys, totals = unrising(row["keys"]), unpacked(row["totals"])
                costs = np.round(-symbol_costs(keys, unpacked(row["counts"]).astype(np.int64), top.value, depth) * SCALE).astype(np.uint64)
                places = [unrising(x).astype(np.int64) for x in row["places"]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["blocks"], pa.int32()), pa.array([row["shard"]] * len(places), pa.int32()), pa.array([rising(keys[x]) for x in places], pa.binary()),
                    pa.array([packed(costs[x]) for x in places], pa.binary()), pa.array([packed(totals[unpacked(x).astype(np.int64)]) for x in row["word_places"]], pa.binary()),
                ], ["block", "shard", "keys", "costs", "totals"])

    answers = shard_rows.select("shard", "keys", "counts", "totals", "blocks", "places", "word_places").mapInArrow(answer, "block int, shard int, keys binary, costs binary, totals binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"

    def block_scores(table: pa.Table, found: pa.Table) -> pa.Table:
        block, found = Block(opened(table), depth, cuts.value), found.sort_by("shard")
        keys = np.concatenate([unrising(x) for x in found.column("keys").to_pylist()])
        cost = np.concatenate([unpacked(x).astype(np.float32) for x in found.column("costs").to_pylist()])
        counts = np.zeros(len(block.words), np.int64)
        counts[np.argsort(block.word_shard, kind="stable")] = np.concatenate([unpacked(x) for x in found.column("totals").to_pylist()])
        lookup, result, n_bytes = Lookup(keys), [], []
        for _, own_keys, symbols in block.slices():
            result.append(row_sums(cost[lookup.find(own_keys)].astype(float), np.concatenate([[0], np.cumsum(symbols)])) / -SCALE)
            n_bytes.append(symbols)
        result, n_bytes = np.concatenate(result), np.concatenate(n_bytes).astype(np.int64)
        base = np.log10((counts + 1) / (total.n + total.v + 1))
        codes, starts = block.codes, block.starts
        values = [block.rows.column("doc_id"), block.rows.column("held_out"), pa.array(np.diff(starts) + 1), pa.array(row_sums((counts > 0).astype(np.int64)[codes], starts) + int(counts[0] > 0)), pa.array(np.full(len(starts) - 1, total.n, np.int64)), pa.array(row_sums(base[codes], starts) + base[0]), pa.array(result), pa.array(n_bytes), pa.array(-result * np.log2(10) / n_bytes)]
        return pa.table(dict(zip([x.split()[0] for x in schema.split(", ")], values, strict=True)))

    # The rows are small beside the shards' state, which goes once they are saved.
    return saved.last(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(block_scores, schema), "scores")
