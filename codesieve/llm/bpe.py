"""Byte-level BPE by a finite-state transducer, and streaming decoding by an incremental UTF-8 machine.

The merges, given as ranks, are compiled into a transducer that reads a pre-token byte by byte and
says, for each byte, which token ends there if the pre-token ended there. A state is what later
tokens depend on: the bytes since the first place where a token that isn't complete may have
begun, and the token that ends at each such place. A token is final once every such place is
reached through it, which the longest token bounds. States and moves are made when a text first
needs them (lazy determinisation) and forgotten together beyond a number of states; the moves lie in one
table, so all distinct pre-tokens of a batch step through it together.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from codesieve.llm.chunks import ChunkEncoder
from codesieve.llm.common import ranges, sliced, view

#: States that a transducer keeps, pre-tokens that step together, and the bytes that one of them may have.
MOST_STATES, STEP, TOGETHER = 200_000, 1 << 16, 48
#: Ids that are decoded at a time.
PORTION = 8192

def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: base64, space, id on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}


class Moves:
    """Next states by (state, byte), in a table with open addressing."""

    FACTOR = 0x9E3779B97F4A7C15

    def __init__(self, bits: int = 12):
        self.keys, self.next, self.shift, self.used = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), 64 - bits, 0

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The next states of keys (256 * state + byte), -1 where there is no move yet."""
        mask = len(self.keys) - 1
        with np.errstate(over="ignore"):
            place = (wanted.astype(np.uint64) * np.uint64(self.FACTOR) >> np.uint64(self.shift)).astype(np.int64)
        held = self.keys[place]
        out = np.where(held == wanted, self.next[place], np.int32(-1))
        todo = np.flatnonzero((held != wanted) & (held >= 0))
        while len(todo):
            place[todo] = (place[todo] + 1) & mask
            held = self.keys[place[todo]]
            hit = held == wanted[todo]
            out[todo[hit]] = self.next[place[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out

    def get(self, key: int) -> int:
        place, mask = (key * self.FACTOR & (1 << 64) - 1) >> self.shift, len(self.keys) - 1
        while (held := int(self.keys[place])) >= 0:
            if held == key:
                return int(self.next[place])
            place = (place + 1) & mask
        return -1

    def add(self, key: int, state: int) -> None:
        """A move that isn't there yet."""
        if 2 * self.used >= len(self.keys):
            self.grow()
        place, mask = (key * self.FACTOR & (1 << 64) - 1) >> self.shift, len(self.keys) - 1
        while self.keys[place] >= 0:
            place = (place + 1) & mask
        self.keys[place], self.next[place] = key, state
        self.used += 1

    def grow(self) -> None:
        full = self.keys >= 0
        keys, states = self.keys[full], self.next[full]
        self.__init__(66 - self.shift)
        mask, todo = len(self.keys) - 1, np.arange(len(keys))
        with np.errstate(over="ignore"):
            place = (keys.astype(np.uint64) * np.uint64(self.FACTOR) >> np.uint64(self.shift)).astype(np.int64)
        while len(todo):
            free = todo[self.keys[place[todo]] < 0]
            self.keys[place[free]] = keys[free]
            won = free[self.keys[place[free]] == keys[free]]
            self.next[place[won]] = states[won]
            todo = todo[self.keys[place[todo]] != keys[todo]]
            place[todo] = (place[todo] + 1) & mask
        self.used = len(keys)


class Transducer:
    """The transducer of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.ranks, self.most_states = ranks, most_states
        self.spell = {v: k for k, v in ranks.items()}
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(self.spell)] = [len(x) for x in self.spell.values()]
        self.inner = {t[:k] for t in ranks for k in range(1, len(t))}
        self.pairs: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.forget()

    def forget(self) -> None:
        """Start again with the first state only."""
        first = (b"", (None,))
        self.number: dict[tuple[bytes, tuple], int] = {first: 0}
        #: Of each state: bytes since the first open place, and for each open place how many bytes ago it is and the token that ends there.
        self.states: list[tuple[bytes, tuple[int, ...], tuple]] = [(b"", (0,), (None,))]
        self.moves = Moves()
        self.token = np.zeros(1024, np.int32)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge is the last step of spelling a token; none for a byte or a token that no merges reach."""
        if (known := self.parts.get(token, 0)) == 0:
            text = self.spell[token]
            parts = [self.ranks[text[i : i + 1]] for i in range(len(text))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(self.spell[a] + self.spell[b], 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == 1 << 60:
                    break
                parts[at : at + 2] = [rank]
            known = self.parts[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return known

    def fits(self, before: int | None, token: int) -> bool:
        """Whether the merges leave the token as it is, alone or behind the one before.

        Merges go by rank, so the two sides of the border are unfolded from the later merge to the
        earlier one; a merge across the border that comes before the one just unfolded spoils it.
        """
        if before is None:
            return len(self.spell[token]) == 1 or self.halves(token) is not None
        key = before << 32 | token
        if (known := self.pairs.get(key)) is None:
            known, spell, ranks = True, self.spell, self.ranks
            left, right, before_left, before_right = before, token, 1 << 60, 1 << 60
            while True:
                across = ranks.get(spell[left] + spell[right])
                # At a tie of ranks the leftmost merge is first, so the left side's own merge wins it and the right side's loses.
                if across is not None and across < before_left and across <= before_right:
                    known = False
                    break
                a, b = self.halves(left), self.halves(right)
                if a is None and b is None:
                    break
                if b is None or (a is not None and left > right):
                    before_left, left = left, a[1]
                else:
                    before_right, right = right, b[0]
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def move(self, state: int, byte: int) -> int:
        """The next state; its token is the one that ends with this byte.

        Only at an open place can that token begin, and only there can later ones begin, besides at the new end.
        """
        pending, back, before = self.states[state]
        pending = pending + bytes([byte])
        end, spell, entry = len(pending), self.ranks, None
        for k, last in zip(back, before, strict=True):
            token = spell.get(pending[end - 1 - k :])
            if token is not None and self.fits(last, token):
                entry = token
                break
        if entry is None:
            raise ValueError("the ranks aren't those of byte-pair merges")
        inner = self.inner
        live = [(k + 1, last) for k, last in zip(back, before, strict=True) if pending[end - 1 - k :] in inner]
        live.append((0, entry))
        back, before = (tuple(x) for x in zip(*live, strict=True))
        pending = pending[end - back[0] :]
        key = (pending, before)
        if (nxt := self.number.get(key)) is None:
            nxt = self.number[key] = len(self.states)
            self.states.append((pending, back, before))
            if nxt == len(self.token):
                self.token = np.concatenate([self.token, np.zeros_like(self.token)])
            self.token[nxt] = entry
        self.moves.add(256 * state + byte, nxt)
        return nxt

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token; a pre-token that is itself a token is that token. Tokens leave as soon as they are final."""
        if (known := self.ranks.get(piece)) is not None:
            return [known]
        if len(self.states) > self.most_states:
            self.forget()
        state, ids, ends, look = 0, [], [0], 256
        for byte in piece:
            nxt = self.moves.get(256 * state + byte)
            state = nxt if nxt >= 0 else self.move(state, byte)
            ends.append(int(self.token[state]))
            if len(ends) > look:
                final = self.final(ends, self.states[state][1])
                ids += self.walk(ends, final)
                ends = [0, *ends[final + 1 :]]
                look = 2 * len(ends) + 256
                if len(self.states) > self.most_states:
                    pending = self.states[state]
                    self.forget()
                    state = self.number[pending[0], pending[2]] = len(self.states)
                    self.states.append(pending)
                    self.token[state] = ends[-1]
        return ids + self.walk(ends, len(ends) - 1)

    def final(self, ends: list[int], back: tuple[int, ...]) -> int:
        """The last place that all ways to an open place pass through."""
        paths = []
        for k in back:
            place = len(ends) - 1 - k
            path = {place}
            while place > 0:
                place -= int(self.sizes[ends[place]])
                path.add(place)
            paths.append(path)
        return max(set.intersection(*paths))

    def walk(self, ends: list[int], place: int) -> list[int]:
        """Tokens up to a place, from those that end at each place."""
        out = []
        while place > 0:
            out.append(ends[place])
            place -= int(self.sizes[ends[place]])
        return out[::-1]

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-tokens one after the other, and how many each has. Those of up to TOGETHER bytes step together, longer ones alone."""
        n = len(pieces)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = np.fromiter((self.ranks.get(x, -1) for x in pieces), np.int64, n)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        counts = np.ones(n, np.int64)
        long = {int(i): self.encode(pieces[i]) for i in np.flatnonzero((known < 0) & (lengths > TOGETHER))}
        counts[list(long)] = [len(x) for x in long.values()]
        # Longest first, so those that still have a byte at a place are the first ones.
        short = np.flatnonzero((known < 0) & (lengths <= TOGETHER))
        short = short[np.argsort(-lengths[short], kind="stable")]
        found = []
        for begin in range(0, len(short), STEP):
            some = short[begin : begin + STEP]
            tokens = self.step([pieces[i] for i in some], lengths[some])
            place, row = lengths[some].copy(), np.arange(len(some))
            taken = []
            while len(row):
                ids = tokens[place[row] - 1, row]
                taken.append((row, ids))
                place[row] -= self.sizes[ids]
                row = row[place[row] > 0]
            number = np.bincount(np.concatenate([x[0] for x in taken]), minlength=len(some))
            counts[some] = number
            found.append((some, number, taken))
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        out[starts[known >= 0]] = known[known >= 0]
        for i, ids in long.items():
            out[starts[i] : starts[i] + len(ids)] = ids
        for some, number, taken in found:
            for k, (row, ids) in enumerate(taken):
                out[starts[some[row]] + number[row] - 1 - k] = ids
        return out, counts

    def step(self, pieces: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """The token that ends at each place (row) of each piece (column); the longest pieces come first."""
        if len(self.states) > self.most_states:
            self.forget()
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        starts = np.cumsum(lengths) - lengths
        tokens = np.zeros((int(lengths.max(initial=0)), len(pieces)), np.int32)
        state = np.zeros(len(pieces), np.int64)
        for at in range(len(tokens)):
            alive = int(np.searchsorted(-lengths, -at, side="left"))
            byte = raw[starts[:alive] + at]
            wanted = state[:alive] * 256 + byte
            nxt = self.moves.find(wanted)
            if len(missing := np.flatnonzero(nxt < 0)):
                pairs, inverse = np.unique(wanted[missing], return_inverse=True)
                nxt[missing] = np.array([self.move(x >> 8, x & 255) for x in pairs.tolist()], np.int32)[inverse]
            state = nxt.astype(np.int64)
            tokens[at, :alive] = self.token[state]
        return tokens


class Utf8Machine:
    """Text from bytes that arrive in any portions; what can't be UTF-8 becomes U+FFFD, an unfinished character waits."""

    def __init__(self):
        self.code = self.need = 0
        self.low, self.high = 0x80, 0xBF

    def feed(self, data: bytes, last: bool = False) -> str:
        """The characters that this portion completes. The machine's states tell where whole characters lie; a run of them that is well-formed is read at once."""
        out, at = [], 0
        while at < len(data):
            if self.need == 0 and (whole := self.whole(data, at)) > at:
                try:
                    out.append(data[at:whole].decode())
                    at = whole
                    continue
                except UnicodeDecodeError as error:
                    whole = at + error.start
                    out.append(data[at:whole].decode())
                    at = whole
            out.append(self.read(data[at]))
            at += 1
        if last and self.need:
            out.append("\ufffd")
            self.need = 0
        return "".join(out)

    @staticmethod
    def whole(data: bytes, start: int) -> int:
        """Where the last character that has not ended in the data begins."""
        end = len(data)
        for back in range(1, min(3, end - start) + 1):
            byte = data[end - back]
            if byte >= 0xC0:
                return end - back if back < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4) else end
            if byte < 0x80:
                break
        return end

    def read(self, byte: int) -> str:
        """One byte's move."""
        out = ""
        if self.need:
            if self.low <= byte <= self.high:
                self.code, self.need, self.low, self.high = self.code << 6 | byte & 63, self.need - 1, 0x80, 0xBF
                return "" if self.need else chr(self.code)
            out = "\ufffd"
            self.need, self.low, self.high = 0, 0x80, 0xBF
        if byte < 0x80:
            return out + chr(byte)
        if 0xC2 <= byte <= 0xDF:
            self.code, self.need = byte & 31, 1
        elif 0xE0 <= byte <= 0xEF:
            self.code, self.need = byte & 15, 2
            self.low, self.high = 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
        elif 0xF0 <= byte <= 0xF4:
            self.code, self.need = byte & 7, 3
            self.low, self.high = 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
        else:
            out += "\ufffd"
        return out


class Codec:
    """Texts to ids and back with one vocabulary and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_chunks: int = 200_000):
        self.machine, self.split = Transducer(ranks), regex.compile(pattern).findall
        self.chunks = ChunkEncoder(self.encode_many, most_chunks)
        self.spelling = np.array([self.machine.spell.get(i, b"") for i in range(max(ranks.values()) + 1)], object)
        self.decimal = np.array([str(i) for i in range(len(self.spelling))], object)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes; each distinct pre-token is encoded once."""
        number: dict[str, int] = {}
        pieces = [[number.setdefault(x, len(number)) for x in self.split(text)] for text in texts]
        ids, counts = self.machine.encode_all([x.encode() for x in number])
        per = np.fromiter(map(len, pieces), np.int64, len(pieces))
        used = np.fromiter((i for x in pieces for i in x), np.int64, int(per.sum()))
        starts = np.cumsum(counts) - counts
        out = ids[ranges(starts[used], counts[used])].astype("<u4").tobytes()
        ends = (4 * np.concatenate([[0], np.cumsum(counts[used])])[np.concatenate([[0], np.cumsum(per)])]).tolist()
        return [out[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], "<u4").tolist()

    def decode_bytes(self, ids: np.ndarray | list[int]) -> bytes:
        return b"".join(self.spelling[np.asarray(ids, np.int64)].tolist())

    def stream(self, ids: Iterator[int]) -> Iterator[str]:
        """The text in portions as ids arrive; characters that are cut between ids come whole."""
        machine = Utf8Machine()
        while portion := list(itertools.islice(ids, PORTION)):
            if text := machine.feed(self.decode_bytes(portion)):
                yield text
        if text := machine.feed(b"", last=True):
            yield text


#: Codecs of this Python worker by (rank file, pattern): built once, used by every task that follows.
_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the bytes decoded from them; with keep, the ids and decoded text too.

    One row for each row of docs. A null or empty text has no ids and decodes to nothing.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            for part in sliced(batch):
                ids, starts = own.chunks.encode(part.column("text"))
                spans = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
                listed = [hashlib.sha256(",".join(own.decimal[ids[a:b]].tolist()).encode()).hexdigest() for a, b in spans]
                back = ["".join(own.stream(iter(ids[a:b]))) for a, b in spans]
                columns = [part.column("doc_id"), pa.array(np.diff(starts)), pa.array(listed), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back])]
                if keep:
                    columns += [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return view(docs).mapInArrow(run, schema)
