import hashlib
import zlib

import numpy as np

from docloom.llm import telephony as M


def one_by_one(block):
    """Plain decoding of one ADPCM block."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(M.STEPS[index])
            size = step >> 3
            size += step if code & 4 else 0
            size += step >> 1 if code & 2 else 0
            size += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - size if code & 8 else value + size))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(value)
    return out


def test_blocks():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (9, 68), dtype=np.uint8)
    assert M.decode_blocks(blocks).tolist() == [one_by_one(b.tobytes()) for b in blocks]


def test_tables():
    assert [int(M.EXPAND["mulaw"][c]) for c in (0x00, 0x80, 0x7F, 0xFF)] == [-32124, 32124, 0, 0]
    assert [int(M.EXPAND["alaw"][c]) for c in (0x2A, 0xAA, 0x55, 0xD5)] == [-32256, 32256, -8, 8]
    assert M.resample(np.array([0, 10, 20])).tolist() == [0, 5, 10, 15, 20, 20]


def test_round_trip(spark):
    texts = [None, "", "a", "a", "é漢🙂" * 30, "x" * 64, "x" * 65, "long " * 900_000, *(f"row {i}" * i for i in range(60))]
    df = spark.createDataFrame([(i, t, b"x", 1) for i, t in enumerate(texts)], "doc_id long, text string, media binary, feature int")
    got = {r.doc_id: r for r in M.decode_media(M.store_texts(df)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert len(r.pcm) == 2 * int(r.feature.split("samples=")[1].split()[0])
    assert {r.feature.split()[0] for r in got.values()} == {"mulaw", "alaw", "adpcm"}
    assert got[2][2:] == got[3][2:] and got[0][2:] == got[1][2:]
    assert M.decode_media(M.store_texts(df.limit(0))).count() == 0


def test_stored_tables(spark, tmp_path):
    spark.createDataFrame([(1, "é" * 100), (2, None), (3, "a b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = M.op8_telephony(spark, str(tmp_path)).collect()
    assert all(len(r.pcm) == 2 * int(r.feature.split("samples=")[1].split()[0]) and f"pcm={zlib.crc32(r.pcm):08x}" in r.feature for r in rows)
    assert sorted((r.doc_id, r.n_bytes, r.payload_bytes) for r in rows) == [(1, 200, 256), (2, 0, 64), (3, 5, 64)]
    media = M.store_texts(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert {r.doc_id: hashlib.sha256(bytes(r.media)).hexdigest() for r in media.collect()} == {r.doc_id: r.media_sha256 for r in rows}
