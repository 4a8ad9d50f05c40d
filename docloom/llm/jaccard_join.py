"""Similarity join of documents by the Jaccard similarity of their word 5-gram sets, exact at 0.8.

Two sets of sizes s <= l with similarity 4/5 or more differ in at most H = (s + l) / 9 elements. The universe of
shingles is partitioned by a hash into segments, their number fixed by the band of sizes (s from 2^k to below
2^(k+1)). Of any segments whose weights add up to H + 1 one must agree: exactly (weight 1), or but for one element
(weight 2, found by one-deletion neighbourhoods, which all sets list for a few stated segments). So each set lists
all its segments, and the smaller set of a pair need only *ask* with some of them: the cheapest by the number of
sets with the same value nearby, with deletion neighbourhoods standing in for costly or empty segments. Sets
below 64 elements take each element as a segment by itself. A set that can't reach H + 1 (too many segments empty)
goes against all documents in blocks.

Sets with equal elements are one node from the start. Listed values meet in buckets, whose number follows the
data; a row there holds the values of one slice of documents for one bucket, so there are never more rows than values.
A value that more than ``PAIRS_UP_TO`` sets of a slice share is frequent everywhere: one of them stands in its bucket, all
of them are gathered in further buckets chosen by the slice, so that no bucket grows with a value's sets. Candidates are verified exactly on
their shingles: first one for each node, then for each node the nearest in another component, then all candidates
that still lie in two components, so that a large group of near copies never makes all its pairs.

Words are runs of non-white-space with A-Z lowered, compared by 64-bit hashes; sets by 128-bit ones. Null, empty
and blank texts have no shingles and link with nothing; rows with equal ids or texts stay rows of their own; null
ids never become a component's id while it has another. Further columns are ignored by ``join_documents`` and
kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import textkernel as K
from docloom.llm.components import grouped, held, merged
from docloom.llm.tables import boxed, checkpointed, table, unboxed

SIZE = 5
SMALL = 64
COSTLY = 8
PAIRS_UP_TO = 6
SLICE_BYTES, SLICE_TEXTS = 2 << 20, 16_000
LEAST_BITS = 6
BUCKET_BYTES = 32 << 20
#: A family's nodes meet in groups of two blocks of about so many bytes; rounds of nearest ones before all that is left.
GROUP_BYTES, ROUNDS = 8 << 20, 3
#: Sets that go against all documents are broadcast in blocks of about so many bytes.
BLOCK_BYTES = 8 << 20
#: So many rows of ids or pairs may be broadcast (32 MB at most); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
ASKS, GUEST = 1 << 14, 1 << 15
#: In a bucket the second flag says that more sets share the value than meet in pairs.
MANY = GUEST


def most_apart(s: np.ndarray) -> np.ndarray:
    """Largest size of the difference between a set of size s and a linked one that is not smaller."""
    return (s + 5 * s // 4) // 9


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within a text, and the bounds of the texts."""
    starts, ends, bounds = K.word_spans(buf, offsets)
    words = K.span_hashes(K.LOWER[buf], starts, ends)
    counts = np.diff(bounds)
    sets: list[np.ndarray] = []
    win = K.windows(words, SIZE)
    for n, at in zip(counts.tolist(), bounds.tolist(), strict=False):
        s = win[at : at + n - SIZE + 1] if n >= SIZE else K.windows(words[at : at + n], n) if n else words[:0]
        if n > SIZE:
            s = np.sort(s)
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        sets.append(s)
    return np.concatenate([words[:0], *sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def prints(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def histograms(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set the counts of its elements by hash class, held at 255: their distance is never above the sets' own.

    A set of s elements has about s / 2 classes or more, a power of two; folding neighbours gives fewer.
    """
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        bits = max(LEAST_BITS, (b - a).bit_length() - 1)
        out.append(np.minimum(np.bincount((sets[a:b] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes())
    return out


def folded(histogram: bytes, cells: int) -> np.ndarray:
    return np.frombuffer(histogram, np.uint8).astype(np.int16).reshape(cells, -1).sum(1, dtype=np.int16)


def _of_segments(sets, bounds, band, asking):
    """Values of one band's segments: (text, value, weight-2 row, asks) with asks by cost; and texts that can't ask enough."""
    size = np.diff(bounds)
    need = int(most_apart(np.array(2 * band - 1))) + 1
    segments = need + max(2, need // 8)
    stated = max(1, segments // 32)
    text = K.text_of(bounds)
    mixed = K.mix64(sets ^ np.uint64(0x5851F42D4C957F2D))
    seg = ((K.mix64(sets + np.uint64(band)) >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(text * (1 << 32) + seg, kind="stable")
    text, seg, mixed = text[order], seg[order], mixed[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (seg[1:] != seg[:-1])])) if len(text) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(text)))
    sums = np.add.reduceat(mixed, first) if len(first) else mixed[:0]
    place = K.mix64(seg.astype(np.uint64) + np.uint64(band << 32))
    value = K.mix64(sums + place[first])
    owner, own_seg = text[first], seg[first]
    in_stated = (seg < stated) & (np.repeat(counts, counts) > 1)
    deleted = K.mix64(np.repeat(sums, counts)[in_stated] - mixed[in_stated] + place[in_stated])
    deleted_owner = text[in_stated]
    rows_text, rows_value = np.concatenate([owner, deleted_owner]), np.concatenate([value, deleted])
    asks = np.zeros(len(rows_text), bool)
    if not asking:
        return rows_text, rows_value, asks, np.zeros(0, np.int64)
    order = np.argsort(value, kind="stable")
    runs = np.flatnonzero(np.concatenate([[True], value[order][1:] != value[order][:-1]])) if len(value) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(runs, len(value)))
    cost = np.empty(len(value), np.int64)
    cost[order] = np.repeat(lengths, lengths)
    wanted = most_apart(size) + 1
    doubled = (own_seg < stated) & (counts > 1)
    doubles = np.bincount(owner[doubled], minlength=len(size))
    there = np.bincount(owner, minlength=len(size))
    cheap = np.bincount(owner[cost <= COSTLY], minlength=len(size))
    use = (np.minimum(cheap, there) < wanted) & (doubles > 0)
    left = np.where(use, np.maximum(wanted - 2 * doubles, 0), wanted)
    forced = use[owner] & doubled
    rank_order = np.lexsort((value, cost, forced, owner))
    rank_first = np.searchsorted(owner[rank_order], np.arange(len(size)))
    rank = np.empty(len(owner), np.int64)
    rank[rank_order] = np.arange(len(owner)) - rank_first[owner[rank_order]]
    asks[: len(owner)] = forced | (rank < left[owner])
    asks[len(owner) :] = use[deleted_owner]
    return rows_text, rows_value, asks, np.flatnonzero(there + np.where(use, doubles, 0) < wanted)


def _of_elements(sets, bounds, asking):
    """Each element of a small set by itself; it asks with one more than the elements a link may lack."""
    size, text = np.diff(bounds), K.text_of(bounds)
    value = K.mix64(sets + np.uint64(1))
    asks = np.zeros(len(value), bool)
    if asking:
        _, where, counts = np.unique(value, return_inverse=True, return_counts=True)
        order = np.lexsort((value, counts[where], text))
        rank = np.empty(len(value), np.int64)
        rank[order] = np.arange(len(value)) - bounds[text[order]]
        asks = rank < (size - (8 * size + 8) // 9 + 1)[text]
    return text, value, asks


def signatures(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text with flags, value) of all listed values, and the texts that have to go against all documents."""
    size = np.diff(bounds)
    texts, values, flags, stuck = [], [], [], []

    def part(chosen):
        lengths = size[chosen]
        at = np.repeat(bounds[chosen] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        return sets[at], np.concatenate([[0], np.cumsum(lengths)])

    def put(chosen, text, value, asks, guest):
        texts.append(chosen[text])
        values.append(value)
        flags.append(asks * ASKS + guest * GUEST)

    for guest, chosen in ((0, np.flatnonzero((size > 0) & (size < SMALL))), (1, np.flatnonzero((size >= SMALL) & (4 * size <= 5 * (SMALL - 1))))):
        if len(chosen):
            put(chosen, *_of_elements(*part(chosen), not guest), guest)
    band = SMALL
    while len(size) and band <= size.max():
        for guest, chosen in ((0, np.flatnonzero((size >= band) & (size < 2 * band))), (1, np.flatnonzero((size >= 2 * band) & (4 * size <= 5 * (2 * band - 1))))):
            if len(chosen):
                text, value, asks, lacking = _of_segments(*part(chosen), band, not guest)
                put(chosen, text, value, asks, guest)
                stuck.append(chosen[lacking])
        band *= 2
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *texts]) + np.concatenate([none, *flags]), np.concatenate([none.astype(np.uint64), *values]), np.concatenate([none, *stuck])


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo in range(0, len(column), SLICE_TEXTS):
        for a, b, sets, bounds in K.text_slices(column.slice(lo, SLICE_TEXTS), SLICE_BYTES):
            yield lo + a, lo + b, *shingle_sets(sets, bounds)


def _fixed(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix of bytes."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node, histogram) of each row; node is null where there are no shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, sets, bounds in _slices(batch.column(1)):
                size = np.diff(bounds)
                node = pa.array([p if n else None for p, n in zip(prints(sets, bounds), size.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size), node, pa.array(histograms(sets, bounds), pa.binary())], ["doc_id", "n_shingles", "node", "histogram"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, node binary, histogram binary")


def frequent(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one slice's values: which rows belong to values that more than ``PAIRS_UP_TO`` sets share, and the first row of each such value."""
    order = np.lexsort((text & (ASKS - 1), value))
    value, text = value[order], text[order] & (ASKS - 1)
    new = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.zeros(0, bool)
    runs = np.flatnonzero(new)
    other = new | np.concatenate([[True], text[1:] != text[:-1]]) if len(value) else new
    sets = np.add.reduceat(other.astype(np.int64), runs) if len(runs) else runs
    many, stands = np.zeros(len(value), bool), np.zeros(len(value), bool)
    many[order] = np.repeat(sets > PAIRS_UP_TO, np.diff(np.append(runs, len(value))))
    stands[order[runs[sets > PAIRS_UP_TO]]] = True
    return many, stands


def listed(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, vals, texts, nodes, sizes): the values of one slice for one bucket; without texts, a set that goes against
    all. Buckets from ``buckets`` on gather the sets of values that are frequent in a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "vals", "texts", "nodes", "sizes"]
        task, slices = TaskContext.get().partitionId(), 0
        for batch in batches:
            for _, _, sets, bounds in _slices(batch.column(0)):
                node = np.frombuffer(b"".join(prints(sets, bounds)), "V16")
                _, once = np.unique(node, return_index=True)
                size = np.diff(bounds)
                once = once[size[once] > 0]
                at = np.repeat(bounds[once] - np.cumsum(size[once]) + size[once], size[once]) + np.arange(size[once].sum())
                sets, bounds, node, size = sets[at], np.concatenate([[0], np.cumsum(size[once])]), node[once], size[once]
                text, value, stuck = signatures(sets, bounds)
                many, stands = frequent(text, value)
                bucket = ((value >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                text = (text & ~MANY) | many * MANY
                apart, slices = buckets + (task * 7919 + slices) % buckets, slices + 1
                here = np.flatnonzero(~many | stands)
                text, value = np.concatenate([text[here], text[many]]), np.concatenate([value[here], value[many]])
                bucket = np.concatenate([bucket[here], np.full(int(many.sum()), apart)])
                order = np.argsort(bucket, kind="stable")
                text, value, bucket = text[order], value[order], bucket[order]
                names_of, cuts = np.unique(bucket, return_index=True)
                rows = []
                for b, lo, hi in zip(names_of.tolist(), cuts.tolist(), np.append(cuts[1:], len(bucket)).tolist(), strict=True):
                    t, v = text[lo:hi], value[lo:hi]
                    used, local = np.unique(t & (ASKS - 1), return_inverse=True)
                    rows.append((b, v.tobytes(), (local | (t & (ASKS | MANY))).astype(np.uint16).tobytes(), node[used].tobytes(), size[used].astype(np.int32).tobytes()))
                for k in stuck.tolist():
                    own = sets[bounds[k] : bounds[k + 1]]
                    asks = own[: len(own) - (8 * len(own) + 8) // 9 + 1]
                    rows.append((int(own[0] % np.uint64(buckets)), asks.tobytes(), None, node[k].tobytes(), np.int32(len(own)).tobytes()))
                for lo in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows[lo : lo + 64], strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], names)

    return docs.select("text").mapInArrow(run, "bucket int, vals binary, texts binary, nodes binary, sizes binary")


def _meetings(rows: pa.Table) -> pa.Table:
    """Of one bucket: distinct pairs (a, b) that meet in few; for a value (val) on which more meet those of its members (a)
    that are in this bucket, with their asks; and sets that go against all documents (a) with their elements (asks)."""
    stuck = rows.filter(rows.column("texts").is_null())
    out = [pa.table({"a": stuck.column("nodes"), "b": pa.nulls(len(stuck), pa.binary()), "val": pa.nulls(len(stuck), pa.int64()), "asks": stuck.column("vals")})]
    rows = rows.filter(rows.column("texts").is_valid())
    if not len(rows):
        return out[0]
    values, members, sizes, nodes, seen = [], [], [], [], 0
    for v, t, n, s in zip(*(rows.column(c).to_pylist() for c in ("vals", "texts", "nodes", "sizes")), strict=True):
        t = np.frombuffer(t, np.uint16).astype(np.int64)
        values.append(np.frombuffer(v, np.uint64))
        members.append(((t & (ASKS - 1)) + seen) << 2 | (t >> 14))
        nodes.append(np.frombuffer(n, "V16"))
        sizes.append(np.frombuffer(s, np.int32))
        seen += len(sizes[-1])
    value, member, node, size = np.concatenate(values), np.concatenate(members), np.concatenate(nodes), np.concatenate(sizes).astype(np.int64)
    node, same = np.unique(node, return_inverse=True)
    by_node = np.zeros(len(node), np.int64)
    by_node[same] = size
    text, asks, many = same[member >> 2], (member & 1) > 0, (member & 2) > 0
    order = np.lexsort((~asks, text, value))
    value, text, asks, many = value[order], text[order], asks[order], many[order]
    known = np.unique(value[many])
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])]) if len(value) else np.zeros(0, bool)
    value, text, asks = value[new], text[new], asks[new]
    runs = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(runs, len(value)))
    asked = np.add.reduceat(asks.astype(np.int64), runs) > 0 if len(runs) else np.zeros(0, bool)
    crowded = np.isin(value[runs], known, assume_unique=True)
    pairwise, crowded = asked & ~crowded & (lengths > 1) & (lengths <= PAIRS_UP_TO), crowded | (asked & (lengths > PAIRS_UP_TO))
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    few = runs[pairwise]
    length = lengths[pairwise]
    for i in range(PAIRS_UP_TO):
        for j in range(i + 1, PAIRS_UP_TO):
            at = few[length > j]
            a, b = at + i, at + j
            fits = (asks[a] | asks[b]) & (5 * np.minimum(by_node[text[a]], by_node[text[b]]) >= 4 * np.maximum(by_node[text[a]], by_node[text[b]]))
            lefts.append(text[a[fits]])
            rights.append(text[b[fits]])
    pairs = np.unique(np.concatenate(lefts) * len(node) + np.concatenate(rights))
    raw = node.view(np.uint8).reshape(-1, 16)
    out += [pa.table({"a": _fixed(raw[pairs // max(1, len(node))]), "b": _fixed(raw[pairs % max(1, len(node))]), "val": pa.nulls(len(pairs), pa.int64()), "asks": pa.nulls(len(pairs), pa.binary())})]
    for at, n in zip(runs[crowded].tolist(), lengths[crowded].tolist(), strict=True):
        out.append(pa.table({"a": pa.array([raw[text[at : at + n]].tobytes()], pa.binary()), "b": pa.nulls(1, pa.binary()), "val": pa.array([int(value[at].astype(np.int64))]), "asks": pa.array([asks[at : at + n].tobytes()], pa.binary())}))
    return pa.concat_tables(out)


def _against_all(docs: DataFrame, stuck: DataFrame) -> DataFrame | None:
    """Pairs of the sets that go against all documents, these in blocks of about ``BLOCK_BYTES`` of elements."""
    found = None
    ids = stuck.groupBy("node").agg(F.max(F.length("vals") + 64).alias("n")).withColumn("block", F.expr("cast(conv(hex(substring(node, 1, 4)), 16, 10) as long)"))
    blocks = math.ceil((ids.agg(F.sum("n")).first()[0] or 0) / BLOCK_BYTES)
    for k in range(blocks):
        rows = stuck.join(ids.filter(F.col("block") % blocks == k), "node", "left_semi").dropDuplicates(["node"]).select("node", "vals").collect()
        if not rows:
            continue
        lookup = np.concatenate([np.frombuffer(r.vals, np.uint64) for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r.vals) // 8 for r in rows])
        order = np.argsort(lookup, kind="stable")
        block = docs.sparkSession.sparkContext.broadcast((lookup[order], owner[order], [bytes(r.node) for r in rows]))

        def run(batches, block=block):
            for batch in batches:
                known, owner, nodes = block.value
                for _, _, sets, bounds in _slices(batch.column(0)):
                    low, high = np.searchsorted(known, sets, "left"), np.searchsorted(known, sets, "right")
                    hit = np.flatnonzero(high > low)
                    mine, text = prints(sets, bounds), K.text_of(bounds)
                    met = {(min(mine[text[h]], nodes[o]), max(mine[text[h]], nodes[o])) for h in hit.tolist() for o in owner[low[h] : high[h]].tolist()}
                    met = [p for p in met if p[0] != p[1]]
                    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in met], pa.binary()), pa.array([p[1] for p in met], pa.binary())], ["a", "b"])

        got = docs.select("text").mapInArrow(run, "a binary, b binary")
        found = got if found is None else found.unionByName(got)
    return found


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs of nodes (a table in the shared folder) whose sets reach the similarity, by their texts' shingles."""
    n = pairs.count()
    if not n:
        return pairs
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = checkpointed(classes.select("node", "text_key").join(F.broadcast(nodes) if 2 * n <= BROADCAST_IDS else nodes, "node"))
    some = docs.select(F.xxhash64("text").alias("text_key"), "text")
    keys = needed.select("text_key")
    some = some.join(F.broadcast(keys) if 2 * n <= BROADCAST_IDS else keys, "text_key", "left_semi").select("text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets, bounds in _slices(batch.column(0)):
                node, once = np.unique(np.frombuffer(b"".join(prints(sets, bounds)), "V16"), return_index=True)
                for lo in range(0, len(once), 256):
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in node[lo : lo + 256]], pa.binary()), pa.array([sets[bounds[k] : bounds[k + 1]].tobytes() for k in once[lo : lo + 256]], pa.binary())], ["node", "elements"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = []
            for x, y in zip(batch.column("elements").to_pylist(), batch.column("others").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                fits.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    sets = checkpointed(some.mapInArrow(shingled, "node binary, elements binary").dropDuplicates(["node"]))
    sides = sets.withColumnRenamed("node", "a")
    joined = (sides.join(F.broadcast(pairs), "a") if n <= BROADCAST_IDS else sides.join(pairs, "a")).join(sets.select(F.col("node").alias("b"), F.col("elements").alias("others")), "b")
    return checkpointed(joined.select("a", "b", "elements", "others").mapInArrow(compare, "a binary, b binary"))


def _apart(rows: pa.Table, nearest: bool) -> pa.Table:
    """Of one group: pairs of a node of side 1 and one of side 2 that meet on a value with which one of them asks, in two
    components, that sizes and histograms don't rule out. With ``nearest``, for each node only the nearest other one."""
    node = np.frombuffer(b"".join(rows.column("node").to_pylist()), "V16")
    _, root = np.unique(np.frombuffer(b"".join(rows.column("root").to_pylist()), "V16"), return_inverse=True)
    _, name = np.unique(node, return_inverse=True)
    side, size = rows.column("side").to_numpy(), rows.column("n_shingles").to_numpy()
    shapes = rows.column("histogram").to_pylist()
    cells = min(map(len, shapes))
    shape = np.stack([folded(h, cells) for h in shapes])
    at = rows.column("at").combine_chunks()
    value, asks = (x.to_numpy(zero_copy_only=False) for x in at.flatten().flatten())
    owner = np.repeat(np.arange(len(node)), at.value_lengths().to_numpy())
    there = np.flatnonzero(side[owner] & 2)
    there = there[np.lexsort((~asks[there], value[there]))]
    sorted_value, member, asking = value[there], owner[there], np.concatenate([[0], np.cumsum(asks[there])])
    # Where all nodes are on side 1, it is enough that each one looks at the values with which it asks itself.
    mine = np.flatnonzero((side[owner] & 1 > 0) & (asks | (side == 2).any()))
    low, high = np.searchsorted(sorted_value, value[mine], "left"), np.searchsorted(sorted_value, value[mine], "right")
    high = np.where(asks[mine], high, low + asking[high] - asking[low])
    bounds = np.searchsorted(owner[mine], np.unique(owner[mine]))
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ends = np.searchsorted(owner[mine], np.unique(owner[mine]), "right")
    for lo, hi in zip(bounds.tolist(), ends.tolist(), strict=True):
        i = owner[mine[lo]]
        met = np.zeros(len(node), bool)
        for x, y in zip(low[lo:hi].tolist(), high[lo:hi].tolist(), strict=True):
            met[member[x:y]] = True
        others = np.flatnonzero(met & (root != root[i]) & (5 * np.minimum(size, size[i]) >= 4 * np.maximum(size, size[i])))
        apart = np.concatenate([others[:0], *(np.abs(shape[o] - shape[i]).sum(1) for o in np.array_split(others, len(others) // 4096 + 1))])
        fits = 9 * apart <= size[others] + size[i]
        others, apart = others[fits], apart[fits]
        if nearest and len(others):
            others = others[[np.argmin(apart / (size[others] + size[i]))]]
        lefts.append(np.minimum(name[others], name[i]))
        rights.append(np.maximum(name[others], name[i]))
    _, once = np.unique(name, return_index=True)
    pairs = np.unique(np.concatenate(lefts) * len(once) + np.concatenate(rights))
    raw = node[once].view(np.uint8).reshape(-1, 16)
    return pa.table({"a": _fixed(raw[pairs // len(once)]), "b": _fixed(raw[pairs % len(once)])})


def _nearest_apart(rows: pa.Table) -> pa.Table:
    return _apart(rows, nearest=True)


def _still_apart(rows: pa.Table) -> pa.Table:
    return _apart(rows, nearest=False)


def node_roots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sketches of all rows, (node, root) for the nodes with links)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = checkpointed(sketch(docs.withColumn("doc_id", F.struct("doc_id", F.xxhash64("text").alias("text_key")))).select("doc_id.*", "n_shingles", "node", "histogram"))
    classes = checkpointed(rows.filter("node is not null").groupBy("node").agg(F.min("text_key").alias("text_key"), F.min("n_shingles").alias("n_shingles"), F.min("histogram").alias("histogram")))
    elements = classes.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(64, math.ceil(elements * 6 / BUCKET_BYTES))
    met = checkpointed(listed(docs, buckets).groupBy("bucket").applyInArrow(_meetings, "a binary, b binary, val long, asks binary"))
    pairs = met.filter("b is not null").select("a", "b")
    if (more := _against_all(docs, met.filter("val is null and b is null").select(F.col("a").alias("node"), F.col("asks").alias("vals")))) is not None:
        pairs = pairs.unionByName(more)
    pairs = pairs.distinct()
    few = checkpointed(_ruled(pairs, classes))
    many = met.filter("val is not null").select("val", F.expr("transform(sequence(0, cast(length(a) / 16 as int) - 1), i -> struct(substring(a, i * 16 + 1, 16) as node, hex(substring(asks, i + 1, 1)) = '01' as asks))").alias("members"))
    # A value's members come in parts of bounded size; only each part's least node meets the others'.
    least = many.groupBy("val").agg(F.min(F.expr("array_min(transform(members, x -> x.node))")).alias("least"), F.max(F.expr("exists(members, x -> x.asks)")).alias("asked")).filter("asked").select("val", "least")
    least = checkpointed(least)
    each = many.select("val", F.explode("members").alias("m")).groupBy("val", "m.node").agg(F.max("m.asks").alias("asks"))
    member = checkpointed(each.join(F.broadcast(least) if least.count() <= BROADCAST_IDS else least, "val").select("val", "node", "asks", "least"))
    first = few.unionByName(_ruled(member.select(F.col("least").alias("a"), F.col("node").alias("b")).filter("a < b").distinct(), classes)).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    first = checkpointed(first)
    (roots, n), tried = grouped(verified(first, classes, docs)), first
    for turn in range(ROUNDS + 1):
        nodes, plan = _families(member, held(roots, n), classes)
        # Large families of which much lies outside their largest component are dealt anew for another round of nearest ones.
        nearest = turn < ROUNDS and (turn == 0 or plan.filter("n_few > 1").limit(1).count() > 0)
        apart = checkpointed(_between(few, held(roots, n), _groups(nodes, plan, nearest, turn), nearest).join(tried, ["a", "b"], "left_anti"))
        (roots, n), tried = merged(roots, n, verified(apart, classes, docs)), tried.unionByName(apart)
        if not nearest:
            break
    return rows, held(roots, n)


def _families(member: DataFrame, roots: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each node of a family, and a plan for the large families.

    Values with the same least member come from one family. A row (least, node, root, at, n_shingles, histogram, weight)
    holds all its values on which two components meet. The plan (least, big, n_all, n_few) names a family's largest
    component, and how many blocks of ``GROUP_BYTES`` its nodes and those outside that component make; it has a row
    for each family above one block, so that its rows are bounded by all bytes over a block's.
    """
    known = member.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = known.groupBy("val").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("val")
    nodes = known.join(mixed, "val", "left_semi").groupBy("least", "node").agg(F.first("root").alias("root"), F.collect_list(F.struct("val", "asks")).alias("at"))
    nodes = nodes.join(classes.select("node", "n_shingles", "histogram"), "node")
    nodes = checkpointed(nodes.withColumn("weight", (9 * F.size("at") + F.length("histogram") + 64).cast("long")))
    large = nodes.groupBy("least").agg(F.sum("weight").alias("_all")).filter(F.col("_all") > GROUP_BYTES).select("least")
    by_root = nodes.join(F.broadcast(large), "least", "left_semi").groupBy("least", "root").agg(F.sum("weight").alias("own"))
    plan = by_root.groupBy("least").agg(F.sum("own").alias("whole"), F.max(F.struct("own", "root")).alias("big"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / GROUP_BYTES)).cast("long")
    return nodes, checkpointed(plan.select("least", F.col("big.root").alias("big"), blocks(F.col("whole")).alias("n_all"), blocks(F.col("whole") - F.col("big.own")).alias("n_few")))


def _groups(nodes: DataFrame, plan: DataFrame, nearest: bool, salt: int) -> DataFrame:
    """The nodes with their groups (least, i, j) and sides: every pair in two components has one of side 1 and one of
    side 2 in some group, no group is much larger than two blocks.

    A family of one block is one group. In a larger one each block i of the nodes outside the largest component meets
    each block j of all nodes; for nearest ones, where there are many i, each i meets one j, so that rows don't multiply.
    """
    rows = nodes.join(F.broadcast(plan), "least", "left")
    place = F.xxhash64("node", F.lit(salt))
    i, j, n_few, n_all = F.pmod(place, "n_few"), F.pmod(place, "n_all"), F.col("n_few"), F.col("n_all")
    meets = lambda x: F.pmod(x + salt, n_all)
    cell = lambda x, y, side: F.struct(x.cast("long").alias("i"), y.cast("long").alias("j"), F.lit(side).alias("side"))
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    outside, inside = F.transform(every(n_all), lambda y: cell(i, y, 1)), F.transform(every(n_few), lambda x: cell(x, j, 2))
    if nearest:
        outside = F.when(n_few > 1, F.array(cell(i, meets(i), 1))).otherwise(outside)
        inside = F.when(n_few > 1, F.transform(F.filter(every(n_few), lambda x: meets(x) == j), lambda x: cell(x, j, 2))).otherwise(inside)
    alone = F.array(cell(F.lit(0), F.lit(0), 3))
    cells = F.when(F.col("big").isNull(), alone).when(F.col("root") == F.col("big"), inside).otherwise(F.concat(outside, inside))
    return rows.select("least", "node", "root", "at", "n_shingles", "histogram", "weight", F.explode(cells).alias("c")).select("*", "c.*").drop("c")


def _between(few: DataFrame, roots: DataFrame, groups: DataFrame, nearest: bool) -> DataFrame:
    """Candidates whose nodes lie in two components: all that meet in few, and those that meet in the groups."""
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    apart = few.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    met = groups.drop("weight").groupBy("least", "i", "j").applyInArrow(_nearest_apart if nearest else _still_apart, "a binary, b binary")
    return apart.unionByName(met).distinct()


def _ruled(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that sizes and histograms don't rule out."""
    shape = lambda side: classes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"{side}_n"), F.col("histogram").alias(f"{side}_h"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fits = []
                for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("a_h", "b_h", "a_n", "b_n")), strict=True):
                    cells = min(len(x), len(y))
                    fits.append(5 * min(n, m) >= 4 * max(n, m) and 9 * int(np.abs(folded(x, cells) - folded(y, cells)).sum()) <= n + m)
                yield batch.select(["a", "b"]).filter(pa.array(fits))

    return pairs.join(shape("a"), "a").join(shape("b"), "b").mapInArrow(near, "a binary, b binary")


def join_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: the least id that links reach from it."""
    rows, roots = node_roots(docs)
    rows = rows.select("doc_id", "n_shingles", "node")
    least = rows.filter("node is not null").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("doc_id").alias("component_id"))
    named = roots.join(least, "root").select("node", "component_id")
    single = least.select(F.col("root").alias("node"), "component_id").join(roots.select("node"), "node", "left_anti")
    return rows.join(named.unionByName(single), "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the least id (then least text hash, then least hash of all columns), and all
    rows without shingles."""
    rows, roots = node_roots(docs)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    rows = rows.filter("node is not null").select("doc_id", "text_key", "node")
    # The least key of a component is found with partial minima and joined by itself: a large component is no hot key.
    by_node = rows.groupBy("node").agg(F.min(key).alias("key")).join(roots, "node", "left")
    least = by_node.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("key").alias("key")).select(F.col("key.doc_id").alias("least_id"), F.col("key.text_key").alias("least_key"))
    each = rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    keyed = each.join(least, (F.col("text_key") == F.col("least_key")) & F.col("doc_id").eqNullSafe(F.col("least_id")), "left")
    known = checkpointed(keyed.select("doc_id", "text_key", F.col("least_key").isNotNull().alias("stays"), "n").filter("not stays or n > 1"))
    leave, twice = known.filter("not stays").select("doc_id", "text_key"), known.filter("stays").select("doc_id", "text_key")
    tagged = docs.select(boxed(docs), F.col("doc_id").alias("own_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_key"))

    def matched(df: DataFrame, side: DataFrame, how: str) -> DataFrame:
        return df.join(F.broadcast(side) if side.count() <= BROADCAST_IDS else side, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("text_key")), how)

    kept = matched(tagged, leave, "left_anti")
    if twice.limit(1).count():
        first = matched(kept, twice, "left_semi").groupBy("own_id", "own_key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = matched(kept, twice, "left_anti").select("row").unionByName(first.select("row"))
    return unboxed(kept)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies among all ``documents``."""
    return join_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


#: The same by all pairs that share a shingle; for small tables.
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 OR ws IS NULL THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.y) AS component_id FROM s JOIN r ON s.doc_id = r.x GROUP BY s.doc_id, len(s.sh)
"""
