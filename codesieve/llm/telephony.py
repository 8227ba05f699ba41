"""Telephony audio columns: G.711 by lookup table, IMA ADPCM decoded across blocks, resampled PCM.

A column of bytes is stored as RIFF/WAVE media in one of three telephone codecs and read back from
the stored form. mu-law and A-law samples expand through 256-entry tables; IMA ADPCM blocks decode
with numpy, one step for the same sample of all blocks at once. The PCM is resampled to a second
rate and stored as 16-bit WAVE.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codesieve.llm.common import sliced, text_bytes, view

#: Bytes of an ADPCM block: a header of 4 and 188 of two samples each.
BLOCK = 192
#: WAVE format tags. Fixed values of the RIFF registry.
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
CODECS = (MULAW, ALAW, IMA)

#: Fixed values of the IMA ADPCM recommendation: step sizes and index changes.
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    """PCM value of each mu-law code, by the rule of G.711."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM value of each A-law code, by the rule of G.711."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    level, part = (code >> 4) & 7, code & 15
    size = np.where(level == 0, (part << 4) + 8, ((part << 4) + 264) << np.maximum(level - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples (n, 2 * (width - 4) + 1) of n mono blocks (n, width): the loop runs over samples, numpy over blocks.

    A header's step index beyond the table counts as the nearest entry.
    """
    n, width = blocks.shape
    value = (blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int32) << 8)).astype(np.int16).astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, len(IMA_STEPS) - 1)
    out = np.empty((2 * (width - 4) + 1, n), np.int16)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T).astype(np.int32)
    for k in range(2 * (width - 4)):
        code = (codes[k >> 1] >> (4 * (k & 1))) & 15
        step = IMA_STEPS[index]
        change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + IMA_INDEX[code & 7], 0, len(IMA_STEPS) - 1)
        out[k + 1] = value
    return out.T


def wave(data: bytes, tag: int, rate: int) -> bytes:
    """A mono WAVE file of the format; IMA data is a whole number of blocks."""
    align, bits, extra = (BLOCK, 4, struct.pack("<HH", 2, 2 * (BLOCK - 4) + 1)) if tag == IMA else (2, 16, b"") if tag == PCM else (1, 8, struct.pack("<H", 0))
    per_second = rate * BLOCK // (2 * (BLOCK - 4) + 1) if tag == IMA else rate * align
    form = struct.pack("<HHIIHH", tag, 1, rate, per_second, align, bits) + extra
    count = len(data) // BLOCK * (2 * (BLOCK - 4) + 1) if tag == IMA else len(data) // align
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, count) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[int, int, bytes]:
    """Format tag, sample rate and data of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            return tag, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data in the WAVE file")


def resample(pcm: np.ndarray, source: int, target: int) -> np.ndarray:
    """16-bit samples at the target rate by linear interpolation in integers; the ends hold their value."""
    if not len(pcm) or source == target:
        return pcm.astype(np.int16)
    at = np.arange(len(pcm) * target // source, dtype=np.int64) * source
    left, part = at // target, at % target
    low = pcm.astype(np.int64)
    high = np.concatenate([low[1:], low[-1:]])
    return ((low[left] * (target - part) + high[left] * part) // target).astype(np.int16)


def expand(payloads: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """PCM of each (format tag, data); all ADPCM blocks of the list are decoded together."""
    ima = [np.frombuffer(data, np.uint8).reshape(-1, BLOCK) for tag, data in payloads if tag == IMA]
    decoded = iter(np.split(decode_ima(np.concatenate(ima)), np.cumsum([len(x) for x in ima])[:-1])) if ima else iter(())
    return [next(decoded).ravel() if tag == IMA else TABLES[tag][np.frombuffer(data, np.uint8)] for tag, data in payloads]


def payload(text: bytes, unit: int = BLOCK) -> bytes:
    """The bytes filled up with spaces to a positive multiple of the unit."""
    return text + b" " * (-len(text) % unit or (unit if not text else 0))


def codec_of(data: bytes) -> int:
    """mu-law, A-law and ADPCM take turns by the number of blocks, so equal data has the same codec."""
    return CODECS[len(data) // BLOCK % len(CODECS)]


def features(pcm: np.ndarray) -> str:
    """Length, peak, mean magnitude, RMS and zero crossings of the samples, in integers."""
    x = pcm.astype(np.int64)
    rms = int(np.sqrt((x * x).mean())) if len(x) else 0
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};peak={int(np.abs(x).max(initial=0))};mean={int(np.abs(x).mean()) if len(x) else 0};rms={rms};zero={crossings}"


def store(docs: DataFrame, rate: int = 8000, target: int = 16000, keep: bool = True) -> DataFrame:
    """doc_id, the stored media, what was read back from it, and its resampled PCM with features.

    The rows are those of `docs`, repeated ones too. A null or empty text is one block of spaces. `keep` is
    whether the media and PCM files are returned themselves (media, pcm: binary) beside their digests.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec int, pcm_bytes long, pcm_crc32 long" + ", media binary, pcm binary" * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for part in sliced(batch):
                data, starts = text_bytes(part.column("text"))
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                media = [wave(p, codec_of(p), rate) for p in map(payload, texts)]
                back = [read_wave(m) for m in media]
                rows: dict[str, list] = {k: [] for k in names[1:]}
                for text, file, (tag, at, read), pcm in zip(texts, media, back, expand([(t, d) for t, _, d in back]), strict=True):
                    sound = resample(pcm, at, target)
                    stored = wave(sound.astype("<i2").tobytes(), PCM, target)
                    values = [len(text), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-16:]), len(file), hashlib.sha256(file).hexdigest(), features(sound), tag, len(stored), zlib.crc32(stored)] + [file, stored] * keep
                    for k, v in zip(names[1:], values, strict=True):
                        rows[k].append(v)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, pa.int32() if k == "codec" else pa.binary() if k in ("media", "pcm") else pa.string() if k in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for k, v in rows.items())], names)

    return view(docs).mapInArrow(run, schema)
