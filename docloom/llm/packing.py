"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A document is its token ids and one end id. Full pieces of ``SEQUENCE`` tokens are sequences by themselves; what is left
of each document, less than a sequence, is packed. A piece of L tokens costs L + L^2 / ``QUADRATIC``: one term for what a
model does for each token, one for attention within the piece. Descending by length, pieces go to the sequence of the
lowest cost that has room for them. The room of a batch of pieces is their number of tokens exactly: as many full
sequences as it fills, and the powers of two that make up the rest, which need no padding either. What fits nowhere whole
is cut, into the sequences with the most room. So every sequence is full and nothing is padded.

Left pieces are dealt out evenly, whatever their ids, so that each batch is a mixture of the corpus and costs agree
between batches; documents of full pieces send their checksums alone along. A task packs its rows in batches of
``BATCH_TOKENS`` tokens or ``BATCH_PIECES`` pieces, so its memory doesn't follow the number of rows. Sequence ids hold the
task's number and a counter. No count of all rows is needed and no row meets the driver.

Null text is empty: such a document is the end id. Repeated rows and ids are documents of their own, ids may be null, an
empty table gives an empty result, further columns are ignored. Texts above ``bpe.LONG_CHARS`` are encoded in pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe
from docloom.llm.tables import table

SEQUENCE, END_ID, QUADRATIC = 1024, 0, 4096
BATCH_TOKENS, BATCH_PIECES = 1 << 20, 1 << 14
TASK_BITS = 40
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def cost(tokens: np.ndarray, quadratic: int = QUADRATIC) -> np.ndarray:
    return tokens + tokens * tokens / quadratic


def rooms(tokens: int, size: int = SEQUENCE) -> np.ndarray:
    """Capacities of sequences that hold just so many tokens: full ones, then falling powers of two."""
    rest = tokens % size
    return np.array([size] * (tokens // size) + [1 << b for b in range(size.bit_length(), -1, -1) if rest >> b & 1], np.int64)


def balanced(lengths: np.ndarray, size: int = SEQUENCE, quadratic: int = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset there) of pieces of at most ``size`` tokens each."""
    room = rooms(int(lengths.sum()), size)
    full, spent = room.copy(), np.zeros(len(room))
    out: list[tuple[int, int, int, int, int]] = []
    left: list[int] = []

    def put(piece: int, start: int, length: int, at: int) -> None:
        out.append((piece, start, length, at, int(full[at] - room[at])))
        room[at] -= length
        spent[at] += length + length * length / quadratic

    for piece in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[piece])
        at = int(np.where(room >= length, spent, np.inf).argmin()) if len(room) else 0
        if room[at] >= length:
            put(piece, 0, length, at)
        else:
            left.append(piece)
    for piece in left:
        start, length = 0, int(lengths[piece])
        while start < length:
            fits = np.flatnonzero(room >= length - start)
            at = int(fits[spent[fits].argmin()]) if len(fits) else int(room.argmax())
            some = min(length - start, int(room[at]))
            put(piece, start, some, at)
            start += some
    return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def _rows_for(ids: list[np.ndarray], size: int) -> list[pa.Array]:
    """For each document: number of tokens, checksums of its full pieces, ids of the rest as bytes."""
    full = [[_crc(x[at : at + size]) for at in range(0, len(x) - size + 1, size)] for x in ids]
    rest = [np.ascontiguousarray(x[len(x) // size * size :], "<u4").tobytes() for x in ids]
    return [pa.array([len(x) for x in ids], pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.binary())]


def tails(docs: DataFrame, paths: tuple[str, str, str], size: int = SEQUENCE, long_chars: int = bpe.LONG_CHARS) -> DataFrame:
    """(doc_id, doc_tokens, full, rest) of each row (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    form = f"doc_id {kind}, doc_tokens long, full array<long>, rest binary"
    names = ["doc_id", "doc_tokens", "full", "rest"]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, end = bpe.vocabulary(*paths), np.array([END_ID], np.uint32)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [np.concatenate([v.encode(t), end]) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *_rows_for(ids, size)], names)

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.concatenate([np.frombuffer(batch.column("ids")[k].as_py(), "<u4"), end])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, 1), *_rows_for([ids], size)], names)

    is_long = F.char_length("text") > long_chars
    encoded = bpe.encode_documents(docs.filter(is_long), paths, long_chars=long_chars, with_ids=True).select("doc_id", "ids")
    return docs.filter(~is_long).mapInArrow(short, form).unionByName(encoded.mapInArrow(long, form))


def pack(rows: DataFrame, size: int = SEQUENCE, quadratic: int = QUADRATIC) -> DataFrame:
    """The pieces of ``tails``' rows with their sequences and places."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = [x.split()[0] for x in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << TASK_BITS
        held: list[tuple[pa.RecordBatch, int]] = []
        pieces: list[tuple[int, bytes, int]] = []  # (place in held, ids, tokens of the document)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            if not pieces:
                return
            ids = pa.concat_arrays([b.column("doc_id").slice(k, 1) for b, k in held])
            lengths = np.array([len(rest) // 4 for _, rest, _ in pieces], np.int64)
            placed = balanced(lengths, size, quadratic)
            filled = rooms(int(lengths.sum()), size)
            out = []
            for piece, start, length, at, offset in placed:
                _, rest, total = pieces[piece]
                crc = zlib.crc32(memoryview(rest)[4 * start : 4 * (start + length)])
                out.append((total - len(rest) // 4 + start, length, crc, total, next_id + at, offset, int(filled[at])))
            next_id += len(filled)
            own = ids.take(pa.array([pieces[p][0] for p, *_ in placed], pa.int64()))
            held.clear()
            pieces.clear()
            yield pa.RecordBatch.from_arrays([own, *(pa.array(x, pa.int64()) for x in zip(*out, strict=True))], ["doc_id", *names])

        tokens = 0
        for batch in batches:
            totals = batch.column("doc_tokens").to_pylist()
            for k, total in enumerate(totals):
                full, rest = batch.column("full")[k].as_py(), batch.column("rest")[k].as_py()
                if full:
                    n = len(full)
                    columns = [np.arange(n) * size, np.full(n, size), full, np.full(n, total), next_id + np.arange(n), np.zeros(n, np.int64), np.full(n, size)]
                    next_id += n
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.full(n, k))), *(pa.array(x, pa.int64()) for x in columns)], ["doc_id", *names])
                if rest:
                    pieces.append((len(held), rest, total))
                    held.append((batch, k))
                    tokens += len(rest) // 4
                if tokens >= BATCH_TOKENS or len(pieces) >= BATCH_PIECES:
                    yield from flush()
                    tokens = 0
        yield from flush()

    return rows.hint("rebalance").mapInArrow(run, f"doc_id {kind}, {PIECE}")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of every document."""
    return pack(tails(table(spark, sf_dir, "documents", "doc_id", "text"), bpe.public_paths()))
