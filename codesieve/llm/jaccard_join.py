"""Near duplicates by an exact Jaccard join of word shingles: universe-partition pigeonhole.

Sets are banded by size, so that similar sets lie in one band or in neighbouring ones. In a band, the
universe of shingles is partitioned by hash into segments, more of them than similar sets can differ
in. Two similar sets therefore agree on some segment: a set is found by the hash of a segment's
subset, and where a segment may differ by one shingle, by its subset less one shingle (the
one-deletion neighbourhood). Which segments a set asks for, and which of them with deletions, is
allotted by cost: empty and small subsets, which many sets share, are given up first for as many
units as the pigeonhole bound leaves spare. What agrees on a segment is verified exactly.

Members of a signature's group are held against one hub first. Where a group then lies in one
component, no more is to be learnt from it. The members of the others, and those alone, are held
against further hubs, one for each of their rarest shingles, in which similar sets must meet; those that
may still be similar to a set of another component, by their sizes and the shingles that they alone have, are paired and verified.
None of the tables joined has a bound on its size, so all are joined by sorting and none is broadcast.
So a group of many near copies isn't expanded into its pairs, and no link between different texts is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import Saved, dealt, hash_words, lean, mix, partitions, sliced, spare, view, words
from codesieve.llm.components import components

#: Shingles that a set may have; bands go so far, whatever the texts are.
MOST = 1 << 40
#: Rounds in which sets are held against the hubs of their shingles, before those that are left are paired.
HUBS = 2
#: Shingles of the sets whose signatures meet in a part, if parts aren't the shuffle partitions.
PART_SHINGLES = 1 << 20
#: The bit of second numbers.
SECOND = 1 << 60
#: Roles of a set in a signature's group: it is found there, it asks there.
FOUND, ASKS = 1, 2


@dataclass(frozen=True)
class Bands:
    """Sizes from starts[j] up to starts[j + 1] form band j; similar sets lie in one band or in neighbouring ones.

    percent: the least similarity. segments[j], doubles[j]: segments of a band, and how many of the first of them
    are indexed with one-deletion neighbourhoods.
    """

    percent: int
    starts: np.ndarray
    segments: np.ndarray
    doubles: np.ndarray

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A bound, growing with the sizes, on the shingles in which similar sets can differ."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def needs(self, n: np.ndarray, band: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Units that a set of size n must ask for: among its own band's sets as large or larger, or the band below's."""
        partner = np.where(own, np.minimum(n * 100 // self.percent, self.starts[band + 1] - 1), self.starts[band + 1] - 1)
        return self.apart(n, partner) + 1


def bands(percent: int, largest: int) -> Bands:
    starts = [1]
    while len(starts) < 3 or starts[-3] <= largest:
        starts.append(starts[-1] * 100 // percent + 1)
    starts = np.array(starts, np.int64)
    empty = Bands(percent, starts, np.zeros(0, np.int64), np.zeros(0, np.int64))
    top = starts[1:] - 1
    most = empty.apart(top, top * 100 // percent) + 1
    return Bands(percent, starts, most, most // 16 + (most > 3))


def shingles(column: pa.Array | pa.ChunkedArray, width: int) -> list[np.ndarray]:
    """The set of 64-bit hashes of each row's shingles, sorted: runs of `width` words; a shorter sequence is one; none without words."""
    dictionary, codes, starts = words(column)
    hashes = hash_words(dictionary)[codes] if len(codes) else np.zeros(0, np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            own, size = hashes[a:b], min(width, b - a)
            total = np.full(b - a - size + 1 if size else 0, size, np.uint64)
            for k in range(size):
                total = mix(total + own[k : k + len(total)] + np.uint64(0x9E3779B97F4A7C15))
            out.append(np.unique(total))
    return out


def numbers_of(text: str) -> tuple[int, int]:
    """Two numbers of a text: the first and the next 60 bits of its SHA-256."""
    digest = hashlib.sha256(text.encode()).hexdigest()
    return int(digest[:15], 16), int(digest[15:30], 16)


def nodes_of(texts: list[str], twice: frozenset[int]) -> np.ndarray:
    """The number of each text: its first one, or the second one above 60 bits where several texts have the first (twice)."""
    found = (numbers_of(x) for x in texts)
    return np.array([SECOND | b if a in twice else a for a, b in found], np.int64)


def node_column(text: Column, twice: frozenset[int]) -> Column:
    """nodes_of as an expression."""
    a, b = (F.conv(F.substring(F.sha2(text.cast("binary"), 256), at, 15), 16, 10).cast("long") for at in (1, 16))
    return F.when(a.isin(*twice), b.bitwiseOR(F.lit(SECOND))).otherwise(a) if twice else a


def signatures(sets: list[np.ndarray], plan: Bands, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature, set number and role of every segment subset that non-empty sets are found by or ask for, in their own band or the one below."""
    n = np.array([len(x) for x in sets], np.int64)
    band = np.searchsorted(plan.starts, n, side="right") - 1
    if not own:
        band = band - 1
    use = np.flatnonzero((n > 0) & (band >= 0) & (own | (n * plan.percent <= 100 * (plan.starts[np.maximum(band, 0) + 1] - 1))))
    if not len(use):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    n, band = n[use], band[use]
    m, doubles, need = plan.segments[band], plan.doubles[band], plan.needs(n, band, np.full(len(n), own))
    tokens = np.concatenate([sets[i] for i in use])
    of = np.repeat(np.arange(len(use)), n)
    base = np.cumsum(m) - m
    spread = mix(tokens ^ np.uint64(0x5851F42D4C957F2D))
    segment = (spread % m[of].astype(np.uint64)).astype(np.int64)
    place = base[of] + segment
    total = int(m.sum())
    sums = np.zeros(total, np.uint64)
    value = mix(tokens + np.uint64(0x2545F4914F6CDD1D))
    np.add.at(sums, place, value)
    counts = np.bincount(place, minlength=total)
    owner = np.repeat(np.arange(len(use)), m)
    number = np.arange(total) - base[owner]
    with np.errstate(over="ignore"):
        salt = mix(band[owner].astype(np.uint64) * np.uint64(1 << 32) + number.astype(np.uint64) + np.uint64(1))
    twice = number < doubles[owner]
    # Units that can be asked for: one for each segment, a second one for doubled ones. The spare ones go, costliest first.
    unit = np.concatenate([np.arange(total), np.flatnonzero(twice)])
    second = np.arange(len(unit)) >= total
    cost = np.where(counts[unit] == 0, 0, np.where(second, 1, 1 + counts[unit]))
    order = np.lexsort((unit, cost, owner[unit]))
    per = np.bincount(owner[unit], minlength=len(use))
    rank = np.arange(len(unit)) - np.repeat(np.cumsum(per) - per, per)
    keep = order[rank >= (per - need)[owner[unit[order]]]]
    units = np.bincount(unit[keep], minlength=total)
    asks = np.where(units > 0, ASKS, 0).astype(np.uint8)

    def key(kind: int, which: np.ndarray, content: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(content + salt[which] * np.uint64(2 * kind + 1))

    exact = np.arange(total) if own else np.flatnonzero(asks)
    out = [(key(1, exact, sums[exact]), owner[exact], asks[exact] | (FOUND if own else 0))]
    lessened = np.flatnonzero(units == 2)
    out.append((key(2, lessened, sums[lessened]), owner[lessened], np.full(len(lessened), ASKS, np.uint8)))
    with np.errstate(over="ignore"):
        if len(deleted := np.flatnonzero(units[place] == 2)):
            out.append((key(1, place[deleted], sums[place[deleted]] - value[deleted]), of[deleted], np.full(len(deleted), ASKS, np.uint8)))
        if own and len(deleted := np.flatnonzero(twice[place])):
            out.append((key(2, place[deleted], sums[place[deleted]] - value[deleted]), of[deleted], np.full(len(deleted), FOUND, np.uint8)))
    sig, who, role = (np.concatenate(x) for x in zip(*out, strict=True))
    return sig, use[who], role.astype(np.uint8)


def grouped(sig: np.ndarray, node: np.ndarray, role: np.ndarray) -> list[np.ndarray]:
    """The distinct member lists (of two nodes and more, sorted) of signatures where one asks and another is found."""
    order = np.lexsort((node, sig))
    sig, node, role = sig[order], node[order], role[order]
    fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
    role = np.bitwise_or.reduceat(role, np.flatnonzero(fresh))
    sig, node = sig[fresh], node[fresh]
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    sizes = np.diff(np.append(starts, len(sig)))
    ask, found = (np.add.reduceat((role & r > 0).astype(np.int64), starts) for r in (ASKS, FOUND))
    some = np.flatnonzero((sizes > 1) & (ask > 0) & (found > 0))
    lists = {}
    for i in some:
        members = node[starts[i] : starts[i] + sizes[i]]
        lists[members.tobytes()] = members
    return list(lists.values())


def prefixes(left: DataFrame, percent: int) -> DataFrame:
    """A row for each of the rarest shingles (token) of each set of left (node, set): n, s, room, and its place `at` in the set's order, rarest first.

    A set of n shingles has at least percent * n / 100 in common with a similar one, so the n - ceil(percent * n / 100) + 1
    shingles that the fewest sets have include a common one; where so many are a set's own, it is similar to none. A set
    has `s` shingles that another one has too and `u` of its own, so it shares at most s with any: two sets are similar only
    if each one's `room`, 100 * s - percent * u, is percent * n of the other or more.
    """
    tokens = left.select("node", F.size("set").cast("long").alias("n"), F.explode("set").alias("token"))
    spread = tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    shared = tokens.join(spread.hint("merge"), "token").groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("f", "token"))).alias("ts"))
    shared = shared.withColumn("s", F.size("ts").cast("long")).withColumn("room", 100 * F.col("s") - percent * (F.col("n") - F.col("s")))
    budget = F.col("s") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    return shared.where(budget > 0).select("node", "n", "s", "room", F.posexplode(F.slice("ts", F.lit(1), budget.cast("int"))).alias("at", "t")).select("node", "n", "s", "room", "at", F.col("t.token").alias("token"))


def live(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of prefixes, with component, at which a set of another component may be similar; `main` is the component that most sets at the shingle have.

    At each shingle that component is held against the others, and these against each other: a place is given up where none of
    them has the room, or so little to ask for. So near copies that differ by words of their own are told apart by
    their counts, set by set, however many share a shingle, and shingles of one component join nothing.
    """
    counts = rows.groupBy("token", "component").agg(F.count("*").alias("k"), F.min("n").alias("n"), F.max("room").alias("room"))
    main = counts.groupBy("token").agg(F.max(F.struct("k", "component")).alias("main"))
    split = counts.join(main.hint("merge"), "token").withColumn("is_main", F.col("component") == F.col("main.component"))
    bounds = split.groupBy("token").agg(F.first("main.component").alias("main"), *[f(F.when(F.col("is_main") == side, F.col(c))).alias(f"{c}_{name}") for side, name in ((True, "main"), (False, "other")) for f, c in ((F.min, "n"), (F.max, "room"))])

    def meets(name: str) -> Column:
        return F.coalesce((F.col(f"n_{name}") * percent <= F.col("room")) & (F.col(f"room_{name}") >= F.col("n") * percent), F.lit(False))

    return rows.join(bounds.hint("merge"), "token").where(meets("other") | ((F.col("component") != F.col("main")) & meets("main"))).select("node", "component", "n", "s", "room", "at", "token", "main")


def may_link(one: str, two: str, percent: int) -> Column:
    """Whether two sets of different components may be similar and this may be the first shingle that they share.

    As many shingles must stand from there on, in either's order, as they need in common.
    """
    a, b = (lambda c: F.col(f"{one}.{c}")), (lambda c: F.col(f"{two}.{c}"))
    common = F.ceil(percent * (a("n") + b("n")) / (100 + percent))
    return (a("component") != b("component")) & (a("room") >= b("n") * percent) & (b("room") >= a("n") * percent) & (a("s") - a("at") >= common) & (b("s") - b("at") >= common)


def hub_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each live set and, at each of its shingles, the set of the main component with most room: of near copies, the one nearest to them all."""
    best = rows.where("component = main").groupBy("token").agg(F.max(F.struct("room", "node", "component", "n", "s", "at")).alias("hub")).select("token", "hub.*")
    one, two = rows.alias("one"), best.alias("two")
    pair = F.sort_array(F.array("one.node", "two.node"))
    return one.join(two.hint("merge"), "token").where(may_link("one", "two", percent)).select(pair[0].alias("a"), pair[1].alias("b")).distinct()


def rare_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of live sets of different components, among them all similar ones."""
    one, two = rows.alias("one"), rows.alias("two")
    return one.join(two.hint("merge"), "token").where((F.col("one.node") < F.col("two.node")) & may_link("one", "two", percent)).select(F.col("one.node").alias("a"), F.col("two.node").alias("b")).distinct()


def join(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, Saved, frozenset[int]]:
    """(doc_id, node, n_shingles) of every row, and (node, component) of the distinct texts that have links; with the tables they read, and the first numbers that several texts have.

    Two texts link when 100 * common >= percent * united over their sets of `width`-word shingles (lower-case
    A-Z, words [^\\x20\\x09-\\x0D]+); a shorter text is one shingle, and one without words links with nothing.
    """
    spark = docs.sparkSession
    saved, own = Saved(spark), view(docs)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                found = shingles(part.column("text"), width)
                numbers = [numbers_of(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([x[i] for x in numbers], pa.int64()) for i in (0, 1)), pa.array([len(x) for x in found], pa.int64())], ["doc_id", "first", "second", "n_shingles"])

    rows = saved.save(own.mapInArrow(lean(sizes), "doc_id long, first long, second long, n_shingles long"), "sizes")
    # Different texts with one first number: about 400 among 3 * 10 ** 10 texts.
    twice = frozenset(r.first_ for r in rows.groupBy(F.col("first").alias("first_")).agg(F.min("second").alias("low"), F.max("second").alias("high")).where("low <> high").collect())
    node = F.when(F.col("first").isin(*twice), F.col("second").bitwiseOR(F.lit(SECOND))).otherwise(F.col("first")) if twice else F.col("first")
    rows = rows.select("doc_id", node.alias("node"), "n_shingles")
    plan = bands(percent, MOST)
    parts = max(partitions(spark), -(-(rows.agg(F.sum("n_shingles")).first()[0] or 0) // PART_SHINGLES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                nodes = nodes_of(part.column("text").to_pylist(), twice)
                nodes, first = np.unique(nodes, return_index=True)
                sets = shingles(part.column("text").take(pa.array(first)), width)
                sig, who, role = (np.concatenate(x) for x in zip(*(signatures(sets, plan, o) for o in (True, False)), strict=True))
                node, rows_of = nodes[who], dealt((sig % np.uint64(parts)).astype(np.int64))
                blobs = [pa.array([x[at].tobytes() for _, at in rows_of], pa.binary()) for x in (sig, node, role)]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows_of], pa.int32()), *blobs], ["part", "sig", "node", "role"])

    def meet(table: pa.Table) -> pa.Table:
        columns = [np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()]) for name, kind in (("sig", "<u8"), ("node", "<i8"), ("role", "u1"))]
        lists = grouped(*columns)
        keys = [int.from_bytes(hashlib.sha256(x.tobytes()).digest()[:8], "little", signed=True) for x in lists]
        lengths = [len(x) for x in lists]
        return pa.table({"gid": pa.array(np.repeat(np.array(keys, np.int64), lengths)), "hub": pa.array(np.repeat(np.array([x[0] for x in lists], np.int64), lengths)), "node": pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))})

    # One row for each member of each distinct group of texts that share a segment.
    members = saved.save(own.mapInArrow(lean(send), "part int, sig binary, node binary, role binary").groupBy("part").applyInArrow(lean(meet), "gid long, hub long, node long").distinct(), "members")
    numbered = own.select(node_column(F.col("text"), twice).alias("node"), "text")
    needed = members.select("node").distinct()

    def make_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([x.view(np.int64) for x in shingles(part.column("text"), width)], pa.list_(pa.int64()))], ["node", "set"])

    sets = saved.save(numbered.join(needed.hint("merge"), "node", "left_semi").dropDuplicates(["node"]).mapInArrow(lean(make_sets), "node long, set array<long>"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        """common and united of each pair (a, b)."""
        near = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")).hint("merge"), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")).hint("merge"), "b")
        sized = near.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("common"), (F.size("x") + F.size("y")).cast("long").alias("both"))
        return sized.select("a", "b", "common", (F.col("both") - F.col("common")).alias("united"))

    linked = 100 * F.col("common") >= percent * F.col("united")
    links = saved.save(verified(members.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()).where(linked).select("a", "b"), "spokes")
    found = saved.save(components(links, saved), "components")
    # Members of one group in different components may still be linked; a group of two has been verified.
    placed = members.join(found.hint("merge"), "node", "left").select("gid", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high and n > 2").select("gid")
    left = saved.save(members.join(mixed.hint("merge"), "gid", "left_semi").select("node").distinct().join(sets.hint("merge"), "node"), "left")
    saved.drop(members)
    places = saved.save(prefixes(left, percent), "places")
    saved.drop(left)
    for step in range(HUBS + 1):
        rows_ = places.join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        own = saved.save(live(rows_, percent), "live")
        more = saved.save(verified(rare_pairs(own, percent) if step == HUBS else hub_pairs(own, percent)).where(linked).select("a", "b"), "more")
        saved.drop(own)
        if not more.isEmpty():
            # Later rounds need the components alone, as a link between two of them.
            links = found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
            again = saved.save(components(links, saved), "components")
            saved.drop(found, more)
            found = again
    saved.drop(places, sets)
    return rows, found, saved, twice


def labelled(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, frozenset[int]]:
    """doc_id, node, n_shingles, component_id and stays (one document of each class does) of each row of docs; and what `nodes_of` needs."""
    rows, found, saved, twice = join(docs, width, percent)
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(found.hint("merge"), "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    chosen = nodes.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("doc_id"), F.col("node"))).alias("chosen"))
    labels = nodes.join(chosen.hint("merge"), "component").select("node", "chosen")
    some = F.col("n_shingles") > 0
    stays = ~some | (F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col("node") == F.col("chosen.node")))
    return saved.last(rows.join(labels.hint("merge"), "node", "left").select("doc_id", "node", "n_shingles", F.when(some, F.col("chosen.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), stays.alias("stays")), "labels"), twice


def classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links reach, its own included) of each row of docs.

    Equal texts with words are linked. Rows without words are alone. A null text has no words. A null doc_id takes part in links;
    its component_id is null only if no document with an id is reached. Repeated rows have the same class.
    """
    return labelled(docs, width, percent)[0].select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all columns, that have the smallest doc_id of their class; of rows that share id and text, one stays.

    Rows without words all stay. A class without ids keeps one row.
    """
    own_id, own_node, size, number, once = spare(docs.columns, "id", "node", "n", "own", "once")
    labels, twice = labelled(docs, width, percent)
    rows = labels.where("stays").select(F.col("doc_id").alias(own_id), F.col("node").alias(own_node), F.col("n_shingles").alias(size)).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = docs.withColumn(number, node_column(text, twice))
    kept = kept.join(rows.hint("merge"), (F.col(number) == F.col(own_node)) & docs["doc_id"].cast("long").eqNullSafe(F.col(own_id)))
    return kept.withColumn(once, F.when(F.col(size) == 0, F.monotonically_increasing_id()).otherwise(F.lit(-1))).dropDuplicates([own_node, own_id, once]).select(*[docs[c] for c in docs.columns])
