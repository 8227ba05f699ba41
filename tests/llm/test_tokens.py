"""Packing, byte-level BPE and telephony media against the libraries, the definitions and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as tokenizer_files
import pytest
import tiktoken
from tokenizers import Tokenizer

from codesieve.llm import bpe, packing, telephony

random.seed(7)
MULTI = tokenizer_files.path("byte_bpe_multi_50k.tiktoken")
JSON = tokenizer_files.path("byte_bpe_50k.json")
LETTERS = "ab eé\n\t'sth1 9.,!-_ 日𝔘́ "
TEXTS = ["", " ", "  a  b ", "a\n\nb \n c", "don't we'll  ", "aaaa" * 500, "é" * 300, "½ ² Ⅷ a½b", "日本語テキスト", "<|endoftext|> hi", "😀😀 x😀", "-" * 500, " " * 300 + "a", "\x00\x1c \x85 z", "word " * 5000]
TEXTS += ["".join(random.choice(LETTERS) for _ in range(random.randint(0, 60))) for _ in range(300)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(900, None, 1), (None, "no id", None), (3, "another row of 3", 2), (3, "another row of 3", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3).cache()


def as_set(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_transducer_equals_merges():
    ranks = bpe.read_ranks(MULTI)
    library = tiktoken.Encoding("x", pat_str=tokenizer_files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Codec(ranks, tokenizer_files.PATTERN, most_chunks=50)
    ids, starts = own.chunks.encode(pa.array(TEXTS))
    for i, t in enumerate(TEXTS):
        assert ids[starts[i] : starts[i + 1]].tolist() == library.encode_ordinary(t) == own.encode(t), t[:50]
        assert own.decode_bytes(library.encode_ordinary(t)).decode() == t == "".join(own.stream(iter(own.encode(t))))
    pieces = [t.encode() for t in TEXTS if t]
    ids, counts = own.machine.encode_all(pieces)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library._encode_single_piece(x) for x in pieces]
    spelled = list(ranks)
    own.machine.most_states = 300  # forgetting changes nothing
    for _ in range(2000):
        piece = b"".join(random.choice(spelled) for _ in range(random.randint(1, 4)))
        assert own.machine.encode(piece) == library._encode_single_piece(piece)


def test_utf8_machine_equals_the_codec():
    for _ in range(500):
        data = bytes(random.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF, 0xC0]) for _ in range(random.randint(0, 12)))
        machine = bpe.Utf8Machine()
        assert "".join(machine.feed(data[i : i + 1]) for i in range(len(data))) + machine.feed(b"", True) == data.decode(errors="replace")
        whole, cut = bpe.Utf8Machine(), random.randint(0, len(data))
        assert whole.feed(data[:cut]) + whole.feed(data[cut:], True) == data.decode(errors="replace")


def test_bpe_rows(docs):
    ranks = bpe.read_ranks(MULTI)
    library = tiktoken.Encoding("x", pat_str=tokenizer_files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(docs, MULTI, tokenizer_files.PATTERN)
    assert got.count() == docs.count()
    for r, text in [(r, {d.doc_id: d.text for d in docs.collect() if d.doc_id != 3}.get(r.doc_id)) for r in got.collect() if r.doc_id != 3]:
        ids = library.encode_ordinary(text or "")
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, text or "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode(docs.limit(0), MULTI, tokenizer_files.PATTERN).count() == 0


def test_texts_cut_into_pieces_equal_the_library():
    library, own = Tokenizer.from_file(JSON), packing.Tokens(JSON)
    own.chunks.most = 400  # forgetting changes nothing
    odd = [*"abzZ059 \t\n\r\x0b\x0c\x1c\x1f\x00\x7f.,'_-$<|>#é日½²٣Ⅷ𝔘😀", *"\x85\xa0\u1680\u180e\u2002\u200b\u2028\u202f\u205f\u3000\ufeff\u0301", "'s", "'LL", "'re", "n't", "  ", "\n\n", " a", "…", "” ", "<|endoftext|>"]
    plain = odd[:-1]
    texts = [*TEXTS, None, "", "a" * 300 + " " + "é" * 200, "<|endoftext|>", " <|endoftext|> x'll"]
    texts += ["".join(random.choices(odd if i % 9 == 0 else plain, k=random.randint(0, 14))) for i in range(6000)]
    for k in range(0, len(texts), 500):
        part = texts[k : k + 500]
        ids, starts = own.chunks.encode(pa.array(part, pa.string()))
        assert len(starts) == len(part) + 1 and starts[-1] == len(ids)
        for i, t in enumerate(part):
            assert ids[starts[i] : starts[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)
    for none in ([], ["", None]):
        ids, starts = own.chunks.encode(pa.array(none, pa.string()))
        assert (len(ids), starts.tolist()) == (0, [0] * (len(none) + 1))


def test_words_joined_by_marks_are_encoded_once():
    own, seen = packing.Tokens(JSON), []
    plain = own.ids
    own.ids = lambda texts: seen.extend(texts) or plain(texts)
    names = ["".join(random.choices("abcdefghij", k=8)) for _ in range(40)]
    texts = [f"{a}.{b},{a}{end}\n{b}" for a in names for b in names for end in (".", "!")]
    ids, starts = own.chunks.encode(pa.array(texts))
    assert sum(map(len, seen)) < 5_000 < sum(map(len, texts)) / 20  # each of 40 words once for each sort of piece, not once for each pair
    assert ids[starts[7] : starts[8]].tolist() == plain(texts[7:8])[0]


def test_decomposition():
    counts = np.array([0, 1, 5, 4100, 2048, 2047])
    of, start, length = packing.decompose(counts, 2048)
    for d, n in enumerate(counts):
        own = [(int(s), int(k)) for o, s, k in zip(of, start, length, strict=True) if o == d]
        assert [s for s, _ in own] == np.cumsum([0, *(k for _, k in own)])[:-1].tolist() and sum(k for _, k in own) == n
        assert all(k & (k - 1) == 0 for _, k in own) and len({k for _, k in own if k < 2048}) == len([k for _, k in own if k < 2048])
    with pytest.raises(ValueError):
        packing.decompose(counts, 100)


def test_packing_rows(docs):
    library = Tokenizer.from_file(JSON)
    rows = packing.pack(docs, JSON, longest=64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length == 1 << r.bucket <= 64 and len(r.ids) == r.length for r in rows)
    assert sorted({r.doc_id for r in rows}, key=repr) == sorted({r.doc_id for r in docs.collect()}, key=repr)
    for d in docs.collect():
        if d.doc_id != 3:
            ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 1]
            own = sorted((r for r in rows if r.doc_id == d.doc_id), key=lambda r: r.start)
            assert [i for r in own for i in r.ids] == ids and all(r.doc_tokens == len(ids) for r in own)
            assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    assert packing.pack(docs.limit(0), JSON).count() == 0


def test_buckets_have_one_length(docs, spark, tmp_path):
    packing.save_buckets(packing.pack(docs, JSON, longest=64), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("length <> 1 << bucket").count() == 0


def ima_by_sample(block):
    """The decoder as the recommendation has it, one sample at a time."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(max(block[2], 0), 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.IMA_STEPS[index])
            change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
            value = min(max(value + (-change if code & 8 else change), -32768), 32767)
            index = min(max(index + int(telephony.IMA_INDEX[code & 7]), 0), 88)
            out.append(value)
    return out


def test_codecs():
    # Ends and middles of the two laws.
    assert telephony.mulaw_table()[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.alaw_table()[[0x2A, 0xAA, 0x55, 0xD5]].tolist() == [-32256, 32256, -8, 8]
    blocks = np.frombuffer(random.randbytes(5 * 192), np.uint8).reshape(5, 192)
    assert telephony.decode_ima(blocks).tolist() == [ima_by_sample(bytes(b)) for b in blocks]
    for tag in (*telephony.CODECS, telephony.PCM):
        assert telephony.read_wave(telephony.wave(bytes(384), tag, 8000)) == (tag, 8000, bytes(384))
    with pytest.raises(ValueError):
        telephony.read_wave(b"RIFF")
    assert telephony.resample(np.array([0, 10, -4], np.int16), 8000, 16000).tolist() == [0, 5, 10, 3, -4, -4]


def mulaw_by_rule(byte):
    byte = ~byte & 255
    value = (((byte & 15) << 3) + 132 << (byte >> 4 & 7)) - 132
    return -value if byte & 128 else value


def alaw_by_rule(byte):
    byte ^= 0x55
    low, exponent = byte & 15, byte >> 4 & 7
    value = (low << 4) + 8 if not exponent else (low << 4) + 264 << exponent - 1
    return value if byte & 128 else -value


def feature_by_sample(media):
    """The features of a stored file, one sample at a time."""
    tag, rate, data = telephony.read_wave(media)
    if tag == telephony.IMA:
        pcm = [x for i in range(0, len(data), 192) for x in ima_by_sample(data[i : i + 192])]
    else:
        pcm = [(mulaw_by_rule if tag == telephony.CODECS[0] else alaw_by_rule)(b) for b in data]
    out = []
    for k in range(len(pcm) * 16000 // rate):
        left, part = divmod(k * rate, 16000)
        out.append((pcm[left] * (16000 - part) + pcm[min(left + 1, len(pcm) - 1)] * part) // 16000)
    n = len(out)
    return f"n={n};peak={max(map(abs, out))};mean={int(sum(map(abs, out)) / n)};rms={int((sum(x * x for x in out) / n) ** 0.5)};zero={sum((a < 0) != (b < 0) for a, b in zip(out, out[1:]))}"


def test_media_rows(docs):
    rows = telephony.store(docs).collect()
    assert len(rows) == docs.count()
    texts = {d.doc_id: d.text for d in docs.collect() if d.doc_id != 3}
    seen = {}
    for r in rows:
        if r.doc_id != 3:
            raw = (texts[r.doc_id] or "").encode()
            size = max(192, -(-len(raw) // 192) * 192)
            payload = raw.ljust(size, b" ")
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
            assert telephony.read_wave(r.media)[2] == payload and r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
            assert telephony.read_wave(r.pcm)[:2] == (telephony.PCM, 16000)
            assert seen.setdefault(raw, (r.media, r.feature)) == (r.media, r.feature)
            assert len(raw) > 2000 or r.feature == feature_by_sample(r.media)
    assert telephony.store(docs.limit(0)).count() == 0
