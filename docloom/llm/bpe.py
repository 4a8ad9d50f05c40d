"""Byte-level BPE encoding and decoding by tree concatenation.

A text up to ``long_chars`` code points is encoded as it stands. A longer one is cut into pieces that
different tasks encode; the pieces' encodings are then joined pairwise, level by level. At a join only a
window is encoded again. It grows until both sides agree:

* between words: scanning from a word start in the left half that the cut can't move, the first boundary that
  the right half's own scan also has makes all later words the same, as the scan keeps no state;
* inside one word that spans the join: an encoding is valid exactly if each pair of neighbouring tokens is, so
  a window that begins with a token of the left half and ends with a token of the right half fixes the rest.

If the sides never agree, the window is the whole of both halves. Special tokens' strings split the text
first, as the vocabulary's library does. Null text is empty; repeated rows and ids stay as they are; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.tables import table

LONG_CHARS = 32_768
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Ranks and special tokens of a byte-level BPE file, with an encoder and a decoder table."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(json_path, encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.encoding = tiktoken.Encoding("docs", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.pattern = regex.compile(pattern)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*ranks.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for piece, number in [*ranks.items(), *((k.encode(), v) for k, v in self.special.items())]:
            pieces[number] = piece
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text that is short enough to be encoded at once."""
        return self.encoding.encode_to_numpy(text, allowed_special="all")

    def encode_plain(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def encode_word(self, word: bytes) -> np.ndarray:
        """Ids of bytes that are one word, or a part of one."""
        return np.array(self.encoding._encode_single_piece(word), np.uint32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        at = np.cumsum(lengths) - lengths
        return self.blob[np.arange(lengths.sum()) + np.repeat(self.places[ids] - at, lengths)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(json_path: str, ranks_path: str, pattern: str) -> Vocabulary:
    return Vocabulary(json_path, ranks_path, pattern)


class Node:
    """A piece of text with its ids and the starts of its last three words."""

    __slots__ = ("text", "ids", "last")

    def __init__(self, text: str, ids: np.ndarray, last: list[int]):
        self.text, self.ids, self.last = text, ids, last


def leaf(v: Vocabulary, text: str, ids: np.ndarray) -> Node:
    last: list[int] = []
    for m in v.pattern.finditer(text):
        last = [*last[-2:], m.start()]
    return Node(text, ids, last)


def _settled(v: Vocabulary, text: str, whole: bool) -> list[int]:
    """Word boundaries (ends) of a text's beginning that more text could not move."""
    ends = [m.end() for m in v.pattern.finditer(text)]
    return ends if whole else ends[:-2]


def _join_word(v: Vocabulary, left: bytes, left_ids: np.ndarray, right: bytes, right_ids: np.ndarray) -> np.ndarray:
    """Ids of one word from the ids of its two parts."""
    a, b = np.cumsum(v.lengths[left_ids]), np.cumsum(v.lengths[right_ids])
    back, ahead = 4, 4
    while True:
        i, j = max(0, len(left_ids) - back), min(len(right_ids), ahead)
        window = v.encode_word(left[(a[i - 1] if i else 0) :] + right[: (b[j - 1] if j else 0)])
        first = i == 0 or window[0] == left_ids[i]
        final = j == len(right_ids) or window[-1] == right_ids[j - 1]
        if first and final:
            return np.concatenate([left_ids[:i], window, right_ids[j:]])
        back, ahead = back * (1 if first else 2), ahead * (1 if final else 2)


def join(v: Vocabulary, a: Node, b: Node) -> Node:
    """The encoding of ``a.text + b.text`` from those of both."""
    if not a.text or not b.text:
        return b if not a.text else a
    begin, cut = (a.last[0] if len(a.last) == 3 else 0), len(a.text)
    tail, reach = a.text[begin:], 64
    while True:
        whole = reach >= len(b.text)
        ours = _settled(v, tail + b.text[:reach], whole)
        theirs = {0, *_settled(v, b.text[:reach], whole)}
        met = next((e for e in ours if begin + e >= cut and begin + e - cut in theirs), None)
        if met is not None or whole:
            break
        reach *= 2
    met = ours[-1] if met is None else met
    end = begin + met - cut  # in b
    a_ids, b_ids = np.cumsum(v.lengths[a.ids]), np.cumsum(v.lengths[b.ids])
    head_n = int(np.searchsorted(a_ids, len(a.text[:begin].encode()), "right")) if begin else 0
    tail_n = int(np.searchsorted(b_ids, len(b.text[:end].encode()), "right")) if end else 0
    parts, at = [a.ids[:head_n]], 0
    starts = []
    for stop in (e for e in ours if e <= met):
        low, high = begin + at, begin + stop
        word = a.text[low:high] + b.text[max(0, low - cut) : max(0, high - cut)]
        starts.append(low)
        one_left = low < cut and a.last[-1] == low
        if low < cut < high and one_left and high - cut == (v.pattern.match(b.text).end()):
            left, right = a.text[low:].encode(), b.text[: high - cut].encode()
            n = int(np.searchsorted(a_ids, a_ids[-1] - len(left), "right"))
            m = int(np.searchsorted(b_ids, len(right), "right"))
            parts.append(_join_word(v, left, a.ids[n:], right, b.ids[:m]))
        else:
            parts.append(v.encode_word(word.encode()))
        at = stop
    parts.append(b.ids[tail_n:])
    later = [cut + x for x in b.last if x >= end]
    return Node(a.text + b.text, np.concatenate(parts), [*starts, *later][-3:])


def encode_tree(v: Vocabulary, pieces: list[tuple[str, np.ndarray]]) -> np.ndarray:
    """Join neighbouring pieces of one unsplit text, level by level."""
    level = [leaf(v, t, ids) for t, ids in pieces]
    while len(level) > 1:
        level = [join(v, *level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0].ids if level else np.zeros(0, np.uint32)


def cut_text(v: Vocabulary, text: str, piece_chars: int) -> Iterator[tuple[int, bool, str]]:
    """(segment, special, piece): special strings stand alone, the rest is cut at fixed lengths."""
    for k, part in enumerate(v.splitter.split(text) if v.splitter else [text]):
        if k % 2:
            yield k, True, part
        else:
            for at in range(0, len(part), piece_chars):
                yield k, False, part[at : at + piece_chars]


def digests(v: Vocabulary, ids: np.ndarray) -> tuple[int, str, str]:
    ids = np.ascontiguousarray(ids, "<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(v.decode(ids).encode()).hexdigest()


def encode_documents(docs: DataFrame, paths: tuple[str, str, str], key: str = "doc_id", text: str = "text", long_chars: int = LONG_CHARS, piece_chars: int | None = None, with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids as little-endian unsigned 32-bit binary]) for each row.

    Long texts are encoded once for each distinct text; their pieces are dealt out by (text hash, piece), so
    that one long text does not hold up a task.
    """
    piece_chars = piece_chars or long_chars // 2
    kind = docs.schema[key].dataType
    docs = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    extra = ", ids binary" if with_ids else ""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(*paths)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows, ids_out = [], []
                for t in part.column(1).to_pylist():
                    ids = v.encode(t)
                    rows.append(digests(v, ids))
                    ids_out.append(np.ascontiguousarray(ids, "<u4").tobytes() if with_ids else None)
                n, a, b = zip(*rows, strict=True)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)] + ([pa.array(ids_out, pa.binary())] if with_ids else [])
                yield pa.RecordBatch.from_arrays(columns, ["k", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if with_ids else []))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(*paths)
        for batch in batches:
            for t in batch.column(0):
                t = t.as_py()
                name = hashlib.sha256(t.encode()).digest()
                rows = list(enumerate(cut_text(v, t, piece_chars)))
                for lo in range(0, len(rows), 64):
                    some = rows[lo : lo + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.binary()), pa.array([i for i, _ in some], pa.int64()), pa.array([x[0] for _, x in some], pa.int64()), pa.array([x[1] for _, x in some]), pa.array([x[2] for _, x in some])], ["name", "piece_no", "segment", "special", "piece"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(*paths)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                special, pieces = part.column("special").to_pylist(), part.column("piece").to_pylist()
                ids = [np.array([v.special[p]], "<u4") if s else v.encode_plain(p) for s, p in zip(special, pieces, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([np.ascontiguousarray(x, "<u4").tobytes() for x in ids], pa.binary())], [*part.schema.names, "piece_ids"])

    def tree(whole: pa.Table) -> pa.Table:
        v = vocabulary(*paths)
        rows = sorted(whole.to_pylist(), key=lambda r: r["piece_no"])
        out, k = [], 0
        while k < len(rows):
            same = k
            while same < len(rows) and rows[same]["segment"] == rows[k]["segment"]:
                same += 1
            out.append(encode_tree(v, [(r["piece"], np.frombuffer(r["piece_ids"], "<u4")) for r in rows[k:same]]) if not rows[k]["special"] else np.frombuffer(rows[k]["piece_ids"], "<u4"))
            k = same
        ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
        n, a, b = digests(v, ids)
        got = {"name": [rows[0]["name"]], "n_tokens": [n], "ids_sha256": [a], "decoded_sha256": [b]}
        return pa.table(got | ({"ids": [np.ascontiguousarray(ids, "<u4").tobytes()]} if with_ids else {}))

    is_long = F.char_length("t") > long_chars
    done = docs.filter(~is_long).mapInArrow(short, f"k {kind.simpleString()}, {RESULT}{extra}")
    long = docs.filter(is_long)
    pieces = long.select("t").mapInArrow(cut, "name binary, piece_no long, segment long, special boolean, piece string").dropDuplicates(["name", "piece_no"])
    encoded = pieces.mapInArrow(encode, "name binary, piece_no long, segment long, special boolean, piece string, piece_ids binary")
    trees = encoded.groupBy("name").applyInArrow(tree, f"name binary, {RESULT}{extra}")
    back = long.select("k", F.unhex(F.sha2("t", 256)).alias("name")).join(trees, "name").drop("name")
    return done.unionByName(back).withColumnRenamed("k", key)


def public_paths() -> tuple[str, str, str]:
    """Default place of the vocabulary files; a parameter everywhere else."""
    import public_tokenizers as files

    return files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``."""
    return encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_paths())
