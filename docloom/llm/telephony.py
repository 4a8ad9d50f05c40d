"""Telephony audio: store bytes as mu-law, A-law or ADPCM sound files and expand them to resampled PCM.

Mu-law and A-law expand by tables of 256 values; ADPCM blocks, each with its own start value, are decoded with
one numpy step for each nibble over all blocks of a batch. A stored file is a RIFF container; what is read back
is the coded samples themselves, so that storing loses nothing. ``op8_telephony`` writes the files as a table in the
shared folder and reads it back; its result holds digests and features of every row with the resampled PCM beside
them, and so stores the sound where the result is written. Batches are cut by bytes; one text longer than that is a
batch by itself.

Rows are independent: a null text is empty and is stored as one unit of zeros, repeated rows give equal values, an
empty table an empty result, and further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from docloom.llm import textkernel as K
from docloom.llm.tables import table, written

UNIT = 64
RATE, TARGET_RATE = 8_000, 16_000
#: Bytes of texts or files of one batch.
BATCH_BYTES = 1 << 20
# Format numbers of the container, step sizes and index moves of IMA ADPCM.
FORMATS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
    544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)
NAMES = sorted(FORMATS)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype("<i2")


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, size = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(part > 0, (size + 0x100) << np.maximum(part - 1, 0), size)
    return np.where(code & 0x80, size, -size).astype("<i2")


EXPAND = {"mulaw": _mulaw_table(), "alaw": _alaw_table()}


def store(payload: bytes, codec: str) -> bytes:
    """A sound file whose coded samples are the payload (a positive multiple of UNIT bytes)."""
    if codec == "adpcm":
        blocks = np.zeros((len(payload) // UNIT, UNIT + 4), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data, samples = blocks.tobytes(), len(blocks) * (2 * UNIT + 1)
        form = struct.pack("<HHIIHHHH", FORMATS[codec], 1, RATE, RATE * (UNIT + 4) // (2 * UNIT + 1), UNIT + 4, 4, 2, 2 * UNIT + 1)
    else:
        data, samples = payload, len(payload)
        form = struct.pack("<HHIIHHH", FORMATS[codec], 1, RATE, RATE, 1, 8, 0)
    chunks = b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2) for name, x in ((b"fmt ", form), (b"fact", struct.pack("<I", samples)), (b"data", data)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read(media: bytes) -> tuple[str, np.ndarray]:
    """Codec and data bytes of a sound file, by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a sound file of this kind")
    at, form, data = 12, b"", None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form = media[at + 8 : at + 8 + size]
        elif name == b"data":
            data = np.frombuffer(media, np.uint8, size, at + 8)
        at += 8 + size + size % 2
    codec = {v: k for k, v in FORMATS.items()}.get(struct.unpack_from("<H", form)[0]) if len(form) > 1 else None
    if codec is None or data is None:
        raise ValueError("not a sound file of this kind")
    return codec, data


def decode_blocks(blocks: np.ndarray) -> np.ndarray:
    """PCM of ADPCM blocks (rows: start value, index, reserved, nibbles with the low one first), all blocks at once."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    nibbles = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.uint8)
    nibbles[0::2], nibbles[1::2] = blocks[:, 4:].T & 15, blocks[:, 4:].T >> 4
    out = np.empty((len(nibbles) + 1, len(blocks)), np.int16)
    out[0] = value
    for k, code in enumerate(nibbles, 1):
        step = STEPS[index]
        size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -size, size), -32768, 32767)
        index = np.clip(index + MOVES[code], 0, len(STEPS) - 1)
        out[k] = value
    return out.T


def resample(pcm: np.ndarray, rate: int = RATE, target: int = TARGET_RATE) -> np.ndarray:
    """Linear interpolation in whole numbers; the last sample is held."""
    at = np.arange(len(pcm) * target // rate, dtype=np.int64) * rate
    low, rest = at // target, at % target
    x = pcm.astype(np.int64)
    return ((x[low] * (target - rest) + x[np.minimum(low + 1, len(x) - 1)] * rest) // target).astype("<i2")


def payload_of(raw: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of ``UNIT``."""
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes as a sound file; its checksum picks the codec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in K.text_slices(batch.column(1), BATCH_BYTES):
                payloads = [payload_of(buf[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                media = [store(p, NAMES[zlib.crc32(p) % len(NAMES)]) for p in payloads]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def expand(files: list[bytes]) -> list[tuple[str, bytes, np.ndarray]]:
    """(codec, payload, PCM at RATE) of each file; the ADPCM blocks of all files are decoded together."""
    opened = [read(f) for f in files]
    blocks = [d.reshape(-1, UNIT + 4) for codec, d in opened if codec == "adpcm"]
    sound = decode_blocks(np.concatenate(blocks)) if blocks else None
    out, at = [], 0
    for codec, data in opened:
        if codec == "adpcm":
            own = data.reshape(-1, UNIT + 4)
            out.append((codec, own[:, 4:].tobytes(), sound[at : at + len(own)].reshape(-1)))
            at += len(own)
        else:
            out.append((codec, data.tobytes(), EXPAND[codec][data]))
    return out


def feature_of(codec: str, pcm: np.ndarray, wide: np.ndarray) -> str:
    x = pcm.astype(np.int64)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"{codec} samples={len(wide)} peak={int(np.abs(x).max())} energy={int((x * x).sum()) // len(x)} crossings={crossings} pcm={zlib.crc32(wide.tobytes()):08x}"


DECODED = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def _parts(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``BATCH_BYTES``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BATCH_BYTES, "right")))
        yield lo, hi
        lo = hi


def decode_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, digests of payload and file, feature, pcm) of files (doc_id, n_bytes, media); pcm has 16 bits a sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _parts(batch.column(2)):
                files = batch.column(2).slice(lo, hi - lo).to_pylist()
                rows = []
                for f, (codec, payload, pcm) in zip(files, expand(files), strict=True):
                    wide = resample(pcm)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(f), hashlib.sha256(f).hexdigest(), feature_of(codec, pcm, wide), wide.tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(lo, hi - lo) for k in (0, 1)] + [pa.array(x) for x in zip(*rows, strict=True)], ["doc_id", *DECODED, "pcm"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary")


def op8_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store, read back, decode and resample every whole text of ``documents``; the last column is the sound."""
    return decode_media(written(store_texts(table(spark, sf_dir, "documents", "doc_id", "text")), "media"))
