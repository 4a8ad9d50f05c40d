"""Product codes of vectors, by Yinyang Lloyd in whole numbers.

Components are scaled to integers and vectors cut into equal parts; each part position has a codebook. A round assigns
every part to its nearest entry and moves the entries to the floored means. Entries are clustered into groups once. A
part keeps one lower bound for each group, of its distance to the group's entries other than its own. When entries move,
a bound falls by the group's largest drift. The distance to the own entry is always computed; only the groups whose
bound doesn't lie above it are scanned. Bounds are rounded down and distances are compared as integers, so a skipped
entry is truly farther and ties go to the lower index.

A round is one pass over blocks of vectors (a row holds about ``BLOCK_BYTES``): it writes codes, bounds and the block's
sums for each entry; Spark adds the sums, and the driver holds codebooks alone, whose size is fixed by parameters. The
blocks of the round before last are removed. There is no shuffle of vectors.

Null vectors and those with null, NaN or infinite components are dropped. Shorter vectors count as filled up with zeros
to the longest one's length, and that to a multiple of the parts. Scaled components are held within +-2^26, so that
distances fit 64 bits. Equal ids are ordered by their vectors, null ids stand last; repeated rows stay. With fewer
vectors than entries the codebooks have as many entries as vectors. An empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.tables import forget, table
from docloom.sources.shared import new_folder

PARTS, ENTRIES, ROUNDS, SCALE, GROUP_SIZE = 8, 16, 6, 4096, 4
BLOCK_BYTES, BROADCAST_LABELS = 1 << 20, 100_000
LIMIT = 1 << 26
#: Above the error of a square root.
SLACK = 1 + 1e-12


@dataclass
class Codebooks:
    """Entries of each part position, their groups, and how far each group's entries moved at most in the last round."""

    entries: np.ndarray  # int64 (part, entry, component)
    groups: list[list[np.ndarray]]
    drift: np.ndarray  # (part, group)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def grouped(entries: np.ndarray, size: int = GROUP_SIZE) -> list[np.ndarray]:
    """Indexes of a part's entries in groups of about ``size``: far seeds, then some rounds of means."""
    x = entries.astype(np.float64)
    seeds = [0]
    for _ in range(max(1, len(x) // size) - 1):
        seeds.append(int(np.min([((x - x[s]) ** 2).sum(1) for s in seeds], axis=0).argmax()))
    means = x[seeds]
    for _ in range(5):
        of = ((x[:, None] - means[None]) ** 2).sum(2).argmin(1)
        means = np.stack([x[of == g].mean(0) if (of == g).any() else m for g, m in enumerate(means)])
    return [np.flatnonzero(of == g) for g in range(len(means)) if (of == g).any()]


def started(entries: np.ndarray) -> Codebooks:
    groups = [grouped(e) for e in entries]
    return Codebooks(entries, groups, np.zeros((len(entries), max(map(len, groups)))))


def moved(books: Codebooks, sums: np.ndarray) -> Codebooks:
    """Entries at their parts' floored means; ``sums`` has the components' sums and, last, the count of each entry."""
    count = sums[:, :, -1:]
    entries = np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books.entries)
    shift = np.sqrt(((entries - books.entries) ** 2).sum(2).astype(np.float64)) * SLACK
    drift = np.zeros_like(books.drift)
    for p, groups in enumerate(books.groups):
        for g, members in enumerate(groups):
            drift[p, g] = shift[p, members].max()
    return Codebooks(entries, books.groups, drift)


def nearest(x: np.ndarray, entries: np.ndarray, groups: list[np.ndarray], drift: np.ndarray, own: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, squared distance, bounds, distances computed) of one part position's vectors, from the last round's entry and bounds."""
    held = ((x - entries[own]) ** 2).sum(1)
    reach = np.sqrt(held.astype(np.float64)) * SLACK
    best, least, work = own.copy(), held.copy(), len(x)
    lower = bounds.astype(np.float64) - drift[: len(groups)]
    scans = []
    for g, members in enumerate(groups):
        rows = np.flatnonzero(lower[:, g] <= reach)
        if not len(rows):
            continue
        far = np.stack([((x[rows] - entries[j]) ** 2).sum(1) for j in members], axis=1)
        work += far.size
        at = far.argmin(1)
        first, which = far[np.arange(len(rows)), at], members[at]
        far[np.arange(len(rows)), at] = np.iinfo(np.int64).max
        scans.append((g, rows, which, first, far.min(1)))
        better = (first < least[rows]) | ((first == least[rows]) & (which < best[rows]))
        best[rows[better]], least[rows[better]] = which[better], first[better]
    group_of = np.empty(len(entries), np.int64)
    for g, members in enumerate(groups):
        group_of[members] = g
    left = np.flatnonzero(best != own)  # the entry that was left is now one of the others
    lower[left, group_of[own[left]]] = np.minimum(lower[left, group_of[own[left]]], np.sqrt(held[left].astype(np.float64)))
    for g, rows, which, first, second in scans:
        lower[rows, g] = np.sqrt(np.where(which == best[rows], second, first).astype(np.float64))
    return best, least, np.nextafter(lower.astype(np.float32), np.float32(-np.inf)), work


def assign(parts: np.ndarray, books: Codebooks, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes, summed distances and bounds of vectors (vector, part, component), and the number of distances computed."""
    codes, bounds, error, work = codes.copy(), bounds.copy(), np.zeros(len(parts), np.int64), 0
    for p, groups in enumerate(books.groups):
        best, least, lower, done = nearest(parts[:, p].astype(np.int64), books.entries[p], groups, books.drift[p], codes[:, p].astype(np.int64), bounds[:, p, : len(groups)])
        codes[:, p], bounds[:, p, : len(groups)] = best, lower
        error += least
        work += done
    return codes, error, bounds, work


def sums_of(parts: np.ndarray, codes: np.ndarray, entries: int) -> np.ndarray:
    """(part, entry, component and count) sums; exact, as a block's sums stay below 2^53."""
    out = np.zeros((parts.shape[1], entries, parts.shape[2] + 1), np.int64)
    for p in range(parts.shape[1]):
        for d in range(parts.shape[2]):
            out[p, :, d] = np.bincount(codes[:, p], parts[:, p, d], entries).astype(np.int64)
        out[p, :, -1] = np.bincount(codes[:, p], minlength=entries)
    return out


def scaled(column: pa.Array, width: int) -> np.ndarray:
    """int32 (vector, part, component) of lists of finite numbers."""
    out = np.zeros((len(column), PARTS * width), np.int32)
    lengths = np.array(column.value_lengths(), np.int64)
    values = np.clip(np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE), -LIMIT, LIMIT)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out.reshape(len(column), PARTS, width)


def _kept(vectors: DataFrame) -> DataFrame:
    inf = F.lit(float("inf"))
    good = F.forall("embedding", lambda x: F.abs(x) < inf)  # NaN stands above infinity
    return vectors.select("vec_id", "label", "embedding").filter(F.coalesce(good, F.lit(False)))


def _list(column: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def _opened(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = np.frombuffer(row["parts"].as_py(), "<i4").reshape(-1, PARTS, width)
    return parts, np.frombuffer(row["codes"].as_py(), np.uint8).reshape(-1, PARTS), np.frombuffer(row["bounds"].as_py(), "<f4").reshape(len(parts), PARTS, -1)


def encode(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """((vec_id, label, code, error) of each kept vector as a stored table, the final codebooks; none without vectors)."""
    spark = vectors.sparkSession
    kept = _kept(vectors)
    ids, labels = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    longest = kept.agg(F.max(F.size("embedding")).alias("n")).first().n
    row_form = f"vec_id {ids}, label {labels}, code string, error long"
    if longest is None:
        return spark.createDataFrame([], row_form), None
    width = max(1, -(-longest // PARTS))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").toArrow().column(0).combine_chunks()
    books = started(np.ascontiguousarray(scaled(first, width).transpose(1, 0, 2), np.int64))
    block = max(1, BLOCK_BYTES // (4 * PARTS * width))
    form = f"ids array<{ids}>, labels array<{labels}>, parts binary, codes binary, bounds binary, sums array<long>, work long"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                some = batch.slice(lo, block)
                parts = scaled(some.column("embedding"), width)
                zero = np.zeros((len(parts), PARTS), np.uint8), np.full((len(parts), PARTS, books.drift.shape[1]), -np.inf, np.float32)
                yield _list(some.column("vec_id")), _list(some.column("label")), parts, *zero

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in ("parts", "codes", "bounds")}
                yield batch.column("ids").slice(k, 1), batch.column("labels").slice(k, 1), *_opened(row, width)

    def pass_over(read, books: Codebooks):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for own_ids, own_labels, parts, codes, bounds in read(batches):
                codes, _, bounds, work = assign(parts, books, codes, bounds)
                sums = sums_of(parts, codes, books.entries.shape[1]).reshape(-1)
                yield pa.RecordBatch.from_arrays([own_ids, own_labels, pa.array([parts.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary()), pa.array([bounds.tobytes()], pa.binary()), pa.array([sums], pa.list_(pa.int64())), pa.array([work], pa.int64())], ["ids", "labels", "parts", "codes", "bounds", "sums", "work"])

        return run

    def finish(books: Codebooks):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for own_ids, own_labels, parts, codes, bounds in again(batches):
                codes, error, _, _ = assign(parts, books, codes, bounds)
                yield pa.RecordBatch.from_arrays([own_ids.flatten(), own_labels.flatten(), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["vec_id", "label", "code", "error"])

        return run

    source, read, old = kept, blocks, None
    for _ in range(max(1, rounds)):
        path = new_folder(spark, "vectors")
        source.mapInArrow(pass_over(read, books), form).write.option("compression", "zstd").parquet(path)
        state = spark.read.schema(form).parquet(path)
        if rounds:
            added = state.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).toArrow()
            sums = np.zeros(len(added), np.int64)
            sums[added.column("at").to_numpy()] = added.column("x").to_numpy()
            books = moved(books, sums.reshape(*books.entries.shape[:2], -1))
        if old:
            forget(spark, old)
        source, read, old = state, again, path
    out = new_folder(spark, "codes")
    source.mapInArrow(finish(books), row_form).write.parquet(out)
    forget(spark, old)
    return spark.read.schema(row_form).parquet(out), books


def label_errors(rows: DataFrame) -> DataFrame:
    """The rows with the sum of errors over equal labels, nulls together. Sums are broadcast up to a counted number of labels."""
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    few = sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return rows.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector of ``embeddings`` after six rounds, with errors and a digest of the codebooks."""
    rows, books = encode(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    digest = books.digest() if books else None
    return label_errors(rows).select("vec_id", "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    """Plain rounds: every part against every entry."""
    far = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS MATERIALIZED (SELECT r, p, x[p * (len(x) // {PARTS}) + 1:(p + 1) * (len(x) // {PARTS})] v FROM kept, (SELECT unnest(range({PARTS})) p))",
        f"book0 AS MATERIALIZED (SELECT p, r - 1 j, v c FROM parts WHERE r <= {ENTRIES})",
    ]
    for k in range(rounds + 1):
        steps.append(f"""at{k} AS MATERIALIZED (SELECT r, p, v, j, far FROM (SELECT r, p, v, j, {far} far, row_number() OVER (PARTITION BY r, p ORDER BY {far}, j) place FROM parts JOIN book{k} USING (p)) WHERE place = 1)""")
        if k < rounds:
            steps.append(f"""sum{k} AS MATERIALIZED (SELECT p, j, d, sum(v[d]) s, count(*) n FROM (SELECT p, j, v, unnest(range(1, len(v) + 1)) d FROM at{k}) GROUP BY ALL)""")
            steps.append(f"""new{k} AS MATERIALIZED (SELECT p, j, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY d) c FROM sum{k} GROUP BY ALL)""")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.j, coalesce(n.c, b.c) c FROM book{k} b LEFT JOIN new{k} n ON b.p = n.p AND b.j = n.j)")
    return f"""WITH {", ".join(steps)},
coded AS (SELECT r, string_agg(lower(printf('%02x', j)), '' ORDER BY p) code, CAST(sum(far) AS BIGINT) error FROM at{rounds} GROUP BY r),
digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, j, d)) codebooks_sha256 FROM (SELECT p, j, unnest(c) x, unnest(range(len(c))) d FROM book{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) label_error, codebooks_sha256 FROM kept JOIN coded USING (r), digest"""


OP13_SQL = _sql()
