"""Document fingerprints from prefix polynomial hashes.

S[i] = sum of code[j] * B**j for j < i, modulo two primes, is computed for all prefixes of a text at
once. Two differences of such sums, shifted to one power, decide whether any two spans are equal, so
binary search finds the longest common extension of two places. A fingerprint keeps the hashes of
prefixes and suffixes at multiples of a power of two: from two fingerprints alone, binary search
finds how far the texts agree from the front and from the back. It also keeps the hashes of pieces cut
at places that the text around them chooses, so that what two texts share between edits has the same
pieces wherever it stands; their number grows with the length.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.llm.common import partitions, text_size, view

#: Bytes of text of a part, if parts aren't more than the shuffle partitions.
PART_BYTES = 32 << 20
#: Two primes below 2 ** 31 and a base for each.
PRIMES = np.array([2147483647, 2147483629], np.uint64)
BASES = (911382323, 972663749)
#: A fingerprint has hashes at fewer than twice this many places, from either end.
PLACES = 16
#: Code points whose hash chooses cuts, and the longest piece.
GRAM, LONGEST = 8, 255
#: A cut has the least hash of so many places on either side: in all texts, and in those of at most SHORT code points as well.
REACH, SHORT_REACH, SHORT = 16, 4, 2048


class Powers:
    """Powers of the two bases, made to the longest text that was asked for."""

    def __init__(self):
        self.table = np.ones((2, 1), np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while self.table.shape[1] <= n:
            have = self.table.shape[1]
            step = np.array([[pow(b, have, int(p))] for b, p in zip(BASES, PRIMES, strict=True)], np.uint64)
            self.table = np.concatenate([self.table, self.table * step % PRIMES[:, None]], axis=1)
        return self.table


powers = Powers()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefixes:
    """Prefix sums of one text: rows are the two moduli, column i is the text's first i code points."""

    def __init__(self, codes: np.ndarray, sums: np.ndarray | None = None):
        self.n = len(codes)
        if sums is None:
            terms = (codes.astype(np.uint64) + np.uint64(1)) * powers.upto(self.n)[:, : self.n] % PRIMES[:, None]
            sums = np.zeros((2, self.n + 1), np.uint64)
            # Terms are below 2 ** 31, so the plain sum of 2 ** 33 of them fits.
            sums[:, 1:] = np.cumsum(terms, axis=1) % PRIMES[:, None]
        self.sums = sums
        self.made: str | None = None

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Sums of spans, still times base ** start."""
        return (self.sums[:, end] + PRIMES[:, None] - self.sums[:, start]) % PRIMES[:, None]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each span, comparable between any places and texts: the sums divided by base ** start."""
        start, end = np.atleast_1d(start), np.atleast_1d(end)
        return self.raw(start, end) * inverse_powers(start) % PRIMES[:, None]

    def equal(self, start: int, other: Prefixes, other_start: int, length: int) -> bool:
        """Whether the spans of a length at two places are equal (by both hashes); false where one runs over its end."""
        if min(start, other_start, length) < 0 or start + length > self.n or other_start + length > other.n:
            return False
        table = powers.upto(max(start, other_start))
        a = self.raw(np.array([start]), np.array([start + length])) * table[:, [other_start]] % PRIMES[:, None]
        b = other.raw(np.array([other_start]), np.array([other_start + length])) * table[:, [start]] % PRIMES[:, None]
        return bool((a == b).all())

    def extension(self, start: int, other: Prefixes, other_start: int) -> int:
        """Length of the longest common extension of two places, by binary search."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(start, other, other_start, middle) else (low, middle - 1)
        return low

    def followed_by(self, keep: int, other: Prefixes, most: int) -> Prefixes:
        """Prefixes of this text's first `keep` code points and then the other's first `most`, without hashing again."""
        most = min(most, other.n)
        shift = powers.upto(keep)[:, [keep]]
        joined = (self.sums[:, [keep]] + other.sums[:, 1 : most + 1] * shift) % PRIMES[:, None]
        return Prefixes(np.empty(keep + most, np.uint8), np.concatenate([self.sums[:, : keep + 1], joined], axis=1))

    def cuts(self, reach: int) -> np.ndarray:
        """Where pieces start, and the end: at 0, before each run of GRAM whose hash is the least of `reach` ones on either side, and LONGEST after a start at most."""
        n = self.n - GRAM + 1
        inner = np.zeros(0, np.int64)
        if n > 0:
            prime = PRIMES[0]
            h = (self.sums[0, GRAM:] + prime - self.sums[0, :n]) % prime * inverses.upto(self.n)[0, :n] % prime
            # least[i] is the least of the `reach` hashes from place i - reach on; a power of two, so doubling finds it.
            least = np.concatenate([np.full(reach, prime), h, np.full(reach, prime)])
            step = 1
            while step < reach:
                least = np.minimum(least[:-step], least[step:])
                step *= 2
            inner = np.flatnonzero((h < least[:n]) & (h < least[reach + 1 : reach + 1 + n]))
        edges = np.unique(np.concatenate([[0], inner, [self.n]])).astype(np.int64)
        counts = -(-np.diff(edges) // LONGEST)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.append(np.repeat(edges[:-1], counts) + within * LONGEST, self.n)

    def pieces(self, reach: int) -> str:
        """32-bit hash and length of each piece, 10 hexadecimal digits each."""
        cuts = self.cuts(reach)
        start, end = cuts[:-1], cuts[1:]
        out = np.empty((len(start), 5), np.uint8)
        out[:, :4] = short_hashes(self.spans(start, end)).view(np.uint8).reshape(-1, 4)
        out[:, 4] = end - start
        return out.tobytes().hex()

    def fingerprint(self) -> str:
        """Length, hash of the whole, 32-bit hashes of prefixes and suffixes at multiples of the grid, and pieces at each reach, all hexadecimal."""
        if self.made is None:
            grid = grid_of(self.n)
            places = np.arange(grid, self.n + 1, grid)
            whole = self.spans(np.array([0]), np.array([self.n]))[:, 0]
            front = self.sums[:, places]
            back = self.spans(self.n - places, np.full(len(places), self.n))
            short = [short_hashes(x).tobytes().hex() for x in (front, back)]
            pieces = [self.pieces(REACH), self.pieces(SHORT_REACH) if self.n <= SHORT else ""]
            self.made = f"{self.n:x}-{int(whole[0]):08x}{int(whole[1]):08x}-{'-'.join(short + pieces)}"
        return self.made


def short_hashes(x: np.ndarray) -> np.ndarray:
    return ((x[0] << np.uint64(16) ^ x[1]) & np.uint64(0xFFFFFFFF)).astype(">u4")


def grid_of(n: int) -> int:
    """The power of two at whose multiples a text of n code points has PLACES to twice as many places; 1 for shorter ones."""
    return 1 << max(0, (n // PLACES).bit_length() - 1)


class Inverses(Powers):
    def upto(self, n: int) -> np.ndarray:
        while self.table.shape[1] <= n:
            have = self.table.shape[1]
            step = np.array([[pow(b, -have, int(p))] for b, p in zip(BASES, PRIMES, strict=True)], np.uint64)
            self.table = np.concatenate([self.table, self.table * step % PRIMES[:, None]], axis=1)
        return self.table


inverses = Inverses()


def inverse_powers(at: np.ndarray) -> np.ndarray:
    return inverses.upto(int(at.max(initial=0)))[:, at]


def agreement(a: list[str], b: list[str]) -> int:
    """How many first entries of two lists are equal, by binary search: hashes of prefixes stay unequal once they are."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[middle - 1] == b[middle - 1] else (low, middle - 1)
    return low


def shared(one: str, two: str, low: int, high: int) -> int:
    """Code points from low to high of the first text whose pieces the second has too, each piece as often as the second has it."""
    left = Counter(two[i : i + 10] for i in range(0, len(two), 10))
    at = same = 0
    for i in range(0, len(one), 10):
        piece = one[i : i + 10]
        end = at + int(piece[8:], 16)
        if left[piece] > 0:
            left[piece] -= 1
            same += max(0, min(end, high) - max(at, low))
        at = end
    return same


def likeness(one: str, two: str) -> float:
    """Share of the longer text that the other has too, as far as their fingerprints tell: what agrees from the front and from the back, and equal pieces between.

    1 for equal texts; 0 when an empty text is held against another.
    """
    if one == two:
        return 1.0
    one, two = sorted((one, two), key=lambda x: (-int(x.split("-", 1)[0], 16), x))
    (n, _, *own), (m, _, *other) = one.split("-"), two.split("-")
    n, m = int(n, 16), int(m, 16)
    grid = max(grid_of(n), grid_of(m))
    ends = []
    for x, y in zip(own[:2], other[:2], strict=True):
        x, y = ([s[8 * i : 8 * i + 8] for i in range(grid // grid_of(k) - 1, len(s) // 8, grid // grid_of(k))] for s, k in ((x, n), (y, m)))
        ends.append(agreement(x, y) * grid)
    between = max(shared(x, y, ends[0], n - ends[1]) for x, y in zip(own[2:], other[2:], strict=True))
    return min(sum(ends) + between, m) / n


def text_place(text: Column) -> Column:
    """The first six bytes as a number, which sorts as texts do."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("long")


def next_in_order(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, text and `part`, dealt so that each part has a range of doc_ids and no document's neighbour is far.

    The ranges come from quantiles of doc_id. Nulls come last in descending order. A doc_id (or null) that fills several parts'
    share of the rows is dealt by ranges of its texts, in whose order its rows follow each other.
    """
    parts = parts or max(partitions(docs.sparkSession), -(-text_size(docs) // PART_BYTES))
    if parts < 2:
        return docs.withColumn("part", F.lit(0))
    shares, error = [i / parts for i in range(1, parts)], 0.2 / parts
    drawn = [int(x) for x in docs.where("doc_id is not null").approxQuantile("doc_id", shares, error)]
    counts = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    # How many parts' worth of rows an id has that several quantiles fall on.
    hot: dict[int | None, int] = {x: n for x, n in Counter(drawn).items() if n > 1}
    if (counts.n - counts.known) * parts > counts.n:
        hot[None] = -(-(counts.n - counts.known) * parts // counts.n)
    # Parts count from the largest doc_id down; a cut belongs to the part below it.
    own, place = F.col("doc_id"), text_place(F.col("text"))
    cuts = sorted(set(drawn))
    number = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x >= own)) if cuts else F.lit(0)
    number = F.when(own.isNull(), F.lit(len(cuts) + 1)).otherwise(number)
    for x, n in hot.items():
        rows = docs.where(own.isNull() if x is None else own == x).select(place.alias("place"))
        found = sorted({int(p) for p in rows.approxQuantile("place", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
        if found:
            within = F.size(F.filter(F.array(*map(F.lit, found)), lambda p: p <= place))
            behind = F.lit(False) if x is None else own.isNull() | (own < x)
            number = number + F.when(own.isNull() if x is None else own.eqNullSafe(x), within).when(behind, F.lit(len(found))).otherwise(F.lit(0))
    return docs.withColumn("part", number)


def describe(text: str, own: Prefixes, following: str, nxt: Prefixes) -> tuple[int, str, str, str, float, float]:
    n = own.n
    tail = n // 2
    edited = text[: n - tail] + following[:tail]
    changed = own.followed_by(n - tail, nxt, tail)
    a, b, c = own.fingerprint(), changed.fingerprint(), nxt.fingerprint()
    return n, hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like they and the next document's are.

    The next document is the one that follows in descending doc_id, after the last the first; rows of one
    doc_id follow each other by text, and null doc_ids come last. The edited text has the last
    floor(n / 2) code points replaced by as many first ones of the next text, or all it has. A null text is empty; a sole
    document is its own next.
    """
    own = next_in_order(view(docs))
    # The first row of each part is the next document of the last row of the part before: one row for each part goes there too, behind its rows.
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc()]
    tops = own.groupBy("part").agg(F.max("doc_id").alias("top"))
    heads = own.join(F.broadcast(tops), "part").where(F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("part").agg(F.min("text").alias("text"))
    by_part = Window.orderBy("part")  # one row for each part
    before = tops.select("part", F.coalesce(F.lag("part").over(by_part), F.max("part").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    guests = heads.join(F.broadcast(before), "part").select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("to").alias("part"), F.lit(True).alias("guest"))
    dealt = own.withColumn("guest", F.lit(False)).unionByName(guests).repartition(partitions(docs.sparkSession), "part").sortWithinPartitions("part", "guest", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text, guest in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("guest").to_pylist(), strict=True):
                prefixes = Prefixes(code_points(text))
                if waiting:
                    rows.append((waiting[0], *describe(waiting[1], waiting[2], text, prefixes)))
                waiting = None if guest else (doc_id, text, prefixes)
                if len(rows) >= 2000:
                    yield table(rows)
                    rows = []
        if rows:
            yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return dealt.mapInArrow(run, SCHEMA)
