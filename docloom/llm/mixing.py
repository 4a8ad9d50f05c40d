"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in id order, form blocks of about ``block_chars`` characters. Weights are shares of a
period of slots; block j of a source with share a may be placed from slot floor(j P / a) on and must be placed
before slot ceil((j + 1) P / a). Earliest deadline first over one period (a table of as many rows as the period has
slots, made on the driver from the shares alone) is the pattern of all periods, so every block's slot is arithmetic:
at each point of the mix a source is less than one block ahead of or behind its share. The period grows with the
number of sources, whose names and sizes the driver holds; a pattern above ``BROADCAST_SLOTS`` is joined by a
shuffle. A source that ends leaves its slots empty; no row is dropped or repeated.

Null sources form one source, apart from empty ones. Null ids come first, ids of any type in their order; equal ids
are ordered by text hash, and equal rows share the order of each other (in ``mix`` their first slot). Null and empty
texts take no room. A document longer than a block takes the blocks it covers: its source's next document stands as
many blocks later. Sources without a weight get the least share. An empty table gives an empty result. Further
columns, whatever their names, pass through ``mix``.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.tables import boxed, checkpointed, table, unboxed

BLOCK_CHARS, PERIOD, SLOTS_A_SOURCE, BROADCAST_SLOTS = 20_000, 1_000, 4, 100_000
Weights = dict[str | None, float]


def period_for(sources: int, period: int = PERIOD) -> int:
    """The least multiple of ``period`` with room for ``SLOTS_A_SOURCE`` slots a source."""
    return period * max(1, -(-sources * SLOTS_A_SOURCE // period))


def _by_name(source: str | None) -> tuple[bool, str]:
    return source is not None, source or ""


def shares(weights: Weights, period: int) -> dict[str | None, int]:
    """Whole shares of the period, at least 1 each, by largest remainders (ties by name)."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources need a period of as many slots; it has {period}")
    total = sum(weights.values()) or 1.0
    exact = {s: max(0.0, w) / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    left = period - sum(out.values())
    if left > 0:
        gains = [(out[s] - exact[s], _by_name(s), s) for s in out]
        heapq.heapify(gains)
        for _ in range(left):
            off, name, s = heapq.heappop(gains)
            out[s] += 1
            heapq.heappush(gains, (off + 1, name, s))
    elif left < 0:
        losses = [(exact[s] - out[s], _by_name(s), s) for s in out if out[s] > 1]
        heapq.heapify(losses)
        for _ in range(-left):
            off, name, s = heapq.heappop(losses)
            out[s] -= 1
            if out[s] > 1:
                heapq.heappush(losses, (off + 1, name, s))
    return out


def pattern(share: dict[str | None, int], period: int) -> list[str | None]:
    """The source of each slot of a period: of the released blocks, that with the earliest deadline (ties by name)."""
    waiting = [(0, -(-period // a), _by_name(s), 0) for s, a in share.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, tuple[bool, str], int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, deadline, name, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, name, j))
        _, name, j = heapq.heappop(ready)
        s = name[1] if name[0] else None
        out.append(s)
        if j + 1 < share[s]:
            heapq.heappush(waiting, ((j + 1) * period // share[s], -(-(j + 2) * period // share[s]), name, j + 1))
    return out


def root_weights(docs: DataFrame) -> Weights:
    """Target weights by the square root of each source's characters."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0))).alias("n"))
    return {r.source: float(max(1, r.n)) ** 0.5 for r in sizes.toLocalIterator()}


def text_hash() -> Column:
    return F.xxhash64("text")


def _places(docs: DataFrame) -> DataFrame:
    """(doc_id, source, hash, n_chars, before): the characters before each document in its source.

    Narrow rows are dealt by ranges of (source, id, hash), so that a large source fills many ranges. Sums by source
    and range give offsets, a running sum inside a range the rest.
    """
    narrow = docs.select("doc_id", "source", text_hash().alias("hash"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))
    ranged = checkpointed(narrow.repartitionByRange("source", "doc_id", "hash").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("source", "part").agg(F.sum("n_chars").alias("n"))
    earlier = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = W.partitionBy("source", "part").orderBy("doc_id", "hash").rowsBetween(W.unboundedPreceding, -1)
    rows = ranged.withColumn("inside", F.coalesce(F.sum("n_chars").over(inside), F.lit(0)))
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return rows.select("doc_id", "source", "hash", "n_chars", (F.col("offset") + F.col("inside")).alias("before"))


def schedule(docs: DataFrame, weights: Weights, block_chars: int = BLOCK_CHARS, period: int | None = None) -> DataFrame:
    """(doc_id, source, hash, n_chars, share, block, slot) of each row; ``hash`` is the text's."""
    period = period or period_for(len(weights))
    share = shares(weights, period) if weights else {}
    turns: dict[str | None, int] = {}
    rows = []
    for slot, s in enumerate(pattern(share, period) if share else []):
        rows.append((s, share[s], turns.get(s, 0), slot))
        turns[s] = turns.get(s, 0) + 1
    slots = docs.sparkSession.createDataFrame(rows, "s string, of long, turn long, at long")
    few = (lambda df: F.broadcast(df)) if period <= BROADCAST_SLOTS else (lambda df: df)
    placed = _places(docs).withColumn("block", F.floor(F.col("before") / block_chars))
    placed = placed.join(few(slots.select("s", "of").distinct()), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    placed = placed.withColumn("share", F.coalesce("of", F.lit(1).cast("long"))).drop("of")
    own = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") % F.col("share") == F.col("turn"))
    out = placed.join(few(slots.drop("of")), own, "left")
    slot = F.floor(F.col("block") / F.col("share")) * period + F.coalesce("at", F.lit(period - 1))
    return out.select("doc_id", "source", "hash", "n_chars", "share", "block", slot.cast("long").alias("slot"))


def mix(docs: DataFrame, weights: Weights, block_chars: int = BLOCK_CHARS, period: int | None = None) -> DataFrame:
    """The rows in the order of the mix: partitions and rows ascend by slot."""
    place = schedule(docs.select("doc_id", "source", "text"), weights, block_chars, period)
    place = place.groupBy(F.struct("doc_id", "source", "hash").alias("key")).agg(F.min("slot").alias("slot"))
    rows = docs.select(boxed(docs), F.struct("doc_id", "source", text_hash().alias("hash")).alias("own"))
    same = F.lit(True)
    for c in ("doc_id", "source", "hash"):
        same = same & F.col(f"own.{c}").eqNullSafe(F.col(f"key.{c}"))
    found = rows.join(place, same, "left").select("row", "slot")
    return unboxed(found.repartitionByRange("slot", "row.doc_id").sortWithinPartitions("slot", "row.source", "row.doc_id"))


def op5_mixing(spark: SparkSession, sf_dir: str, weigh: Callable[[DataFrame], Weights] = root_weights) -> DataFrame:
    """Slot and block of every document in a mix by the square roots of the sources' sizes."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return schedule(docs, weigh(docs)).select("doc_id", "source", "n_chars", "share", F.col("block").alias("block_no"), "slot")
