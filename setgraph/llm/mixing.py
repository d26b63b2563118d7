"""Mixing sources to target weights by Pfair scheduling.

Documents of a source, in the order of their hashed ids, form blocks. A source of weight w (a part of the sum of all)
has its k-th block released at slot floor((k - 1) / w) and due by slot ceil(k / w), in exact integers. Blocks are put
into slots of their windows, so that after every slot each source is less than one block from its target weight.

Slots are scheduled in stretches, each on its own. How many blocks of each source come before a stretch's first slot
follows from the windows around it alone (see blocks_before); within the stretch the released block with the earliest
deadline gets each slot. No stretch needs the one before, so they are dealt over tasks. A stretch is no shorter than
the longest window, so a block lies in two stretches at most: the source of least weight w makes tasks of 1/w slots,
which hold one block of each source in memory at a time.

A source that has run out leaves its slots empty, so the others keep their proportions. Where target weights are
given, the mix ends where the sources that still have blocks hold less than a part of them; documents after that end
are surplus of sources that have more than their share. Without given weights it goes on until every source has run
out.

A null source is a source of its own; rows with equal ids and lengths are in any order. Repeated rows are documents of
their own. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Documents of a block; slots of a stretch, or of a period; hash buckets that a source is counted in.
BLOCK_DOCS, PERIOD, BUCKETS = 8, 1000, 1024
#: Without given weights, sources weigh as much as this power of their size.
FLATTENING = 0.8
#: With given weights, the mix ends where sources with blocks left hold less than this part of the weight.
LEAST_LIVE = 0.5


def shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots of a period for each source, by largest remainders, one at least."""
    weights = {s: w for s, w in weights.items() if w > 0}
    total = sum(weights.values())
    period = max(period, 4 * len(weights))
    exact = {s: Fraction(w) / Fraction(total) * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    by_remainder = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    for s in by_remainder[: max(0, period - sum(out.values()))]:
        out[s] += 1
    while sum(out.values()) > period:  # many tiny sources were raised to one slot
        out[max(out, key=lambda s: (out[s], s))] -= 1
    return out


def schedule(slots: dict[str, int]) -> list[str]:
    """The source of each slot of a period, earliest deadline first among released blocks."""
    period = sum(slots.values())
    future = [(k * period // n, -(-(k + 1) * period // n), s) for s, n in slots.items() for k in range(n)]
    heapq.heapify(future)
    ready: list[tuple[int, str]] = []
    out = []
    for slot in range(period):
        while future and future[0][0] <= slot:
            _, due, source = heapq.heappop(future)
            heapq.heappush(ready, (due, source))
        out.append(heapq.heappop(ready)[1])
    return out


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The positive weights as integers of exactly the same proportions."""
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * scale) for s, x in exact.items()}


def blocks_before(at: int, start: int, weights: list[int], total: int) -> list[int]:
    """How many blocks of each source come before slot at, where slots from start on are scheduled up to there.

    Each count is the share rounded down or up. Blocks whose window spans the slot come before it by earliest deadline,
    as long as the slots from any later one on hold all that is released from a on. A choice that leaves the later blocks enough
    slots exists (the shares themselves are a fractional one), and as the sets of blocks that fit are a matroid, the
    greedy one takes as many of the first deadlines as any, so it leaves enough too.
    """
    low = [w * at // total for w in weights]
    open_slots = at - sum(low)
    if not open_slots:
        return low
    released = np.zeros(at - start, np.int64)
    for w, n in zip(weights, low, strict=True):
        k = n
        while k and (r := (k - 1) * total // w) >= start:
            released[r - start] += 1
            k -= 1
    room = np.arange(at - start, 0, -1) - np.cumsum(released[::-1])[::-1]
    spanning = [(-(-(n + 1) * total // w), s, n * total // w) for s, (w, n) in enumerate(zip(weights, low, strict=True)) if w * at % total]
    for _, s, r in sorted(spanning):
        reached = room[1 : max(1, r - start + 1)]  # the slots from start on are filled in any case
        if reached.min(initial=1) > 0:
            reached -= 1
            low[s] += 1
            open_slots -= 1
            if not open_slots:
                break
    return low


def stretch(start: int, stop: int, before: list[int], after: list[int], weights: list[int], total: int) -> Iterator[tuple[int, int]]:
    """(source, block from 0) of each slot from start to stop, earliest deadline first among released blocks."""
    future = [(n * total // weights[s], s, n) for s, n in enumerate(before) if n < after[s]]
    heapq.heapify(future)
    ready: list[tuple[int, int, int]] = []
    for slot in range(start, stop):
        while future and future[0][0] <= slot:
            _, s, k = heapq.heappop(future)
            heapq.heappush(ready, (-(-(k + 1) * total // weights[s]), s, k))
            if k + 1 < after[s]:
                heapq.heappush(future, ((k + 1) * total // weights[s], s, k + 1))
        yield heapq.heappop(ready)[1:]


def slots_of_blocks(spark: SparkSession, weights: dict[str, int], blocks: dict[str, int]) -> DataFrame:
    """_source, _block, _slot of all blocks, for whole weights and the number of blocks of each source."""
    names, whole = list(weights), list(weights.values())
    total, counts = sum(whole), [blocks[s] for s in names]
    length = max(PERIOD, 4 * len(names), -(-total // min(whole, default=1)) + 2)
    slots = max((-(-n * total // w) for n, w in zip(counts, whole, strict=True)), default=0)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, after = -1, []
        for batch in batches:
            for number in batch["id"].tolist():
                start, stop = number * length, (number + 1) * length
                if not any((n := w * start // total) < most and -(-w * stop // total) > n for w, most in zip(whole, counts, strict=True)):
                    continue
                before = after if at == start else blocks_before(start, start - length, whole, total)
                at, after = stop, blocks_before(stop, start, whole, total)
                placed = enumerate(stretch(start, stop, before, after, whole, total), start)
                found = ((names[s], k, slot) for slot, (s, k) in placed if k < counts[s])
                while rows := list(itertools.islice(found, 50_000)):
                    yield pd.DataFrame(rows, columns=["_source", "_block", "_slot"])

    return spark.range(-(-slots // length)).mapInPandas(place, "_source string, _block long, _slot long")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS, least_live: float = LEAST_LIVE) -> DataFrame:
    """docs with _block (number within the source), _slot and _mixed (whether the slot is before the mix's end).

    Sources without a weight, where weights are given, have null slots and aren't mixed. Without weights all documents
    are mixed. Ranks within a source come from counts of hash buckets, so a source with a third of all rows has no task
    of its own. The sources and their counts come to the driver; they have to be few (10,000).
    """
    spark = docs.sparkSession
    source = F.coalesce(F.col("source").cast("string"), F.lit("\0"))
    order = F.xxhash64("doc_id", "n_chars")
    keyed = docs.withColumn("_source", source).withColumn("_order", order)
    keyed = keyed.withColumn("_bucket", F.pmod(F.col("_order"), F.lit(BUCKETS)).cast("int"))
    counts = docs.select(source.alias("_source"), F.pmod(order, F.lit(BUCKETS)).cast("int").alias("_bucket")).groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_before", F.coalesce(before, F.lit(0)))
    sizes = {r[0]: r[1] for r in counts.groupBy("_source").agg(F.sum("_n")).limit(10_001).collect()}
    if len(sizes) > 10_000:
        raise ValueError("more than 10,000 sources; group them first")
    given = {s: n**FLATTENING for s, n in sizes.items()} if weights is None else {("\0" if s is None else s): w for s, w in weights.items()}
    whole = whole_weights({s: w for s, w in given.items() if s in sizes})
    blocks = {s: -(-sizes[s] // block_docs) for s in whole}
    live = total = sum(whole.values())
    end = None
    for at, s in sorted((-(-blocks[s] * total // w), s) for s, w in whole.items()) if weights is not None else ():
        end = at
        live -= whole[s]
        if live < least_live * total:
            break
    bucketed = keyed.join(counts.select("_source", "_bucket", "_before"), ["_source", "_bucket"])
    rank = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_order", "doc_id"))
    placed = bucketed.withColumn("_block", F.floor((F.col("_before") + rank - 1) / block_docs).cast("long"))
    # Without the hint the table of slots, whose size isn't known, would be sent to every task.
    placed = placed.join(slots_of_blocks(spark, whole, blocks).hint("merge"), ["_source", "_block"], "left")
    within = F.col("_slot").isNotNull() if end is None else F.coalesce(F.col("_slot") < end, F.lit(False))
    placed = placed.withColumn("_mixed", within)
    return placed.select(*docs.columns, "_block", "_slot", "_mixed")


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block and slot of every document, and whether it is within the mix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    placed = mix(docs)
    return placed.select("doc_id", "source", F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_mixed").alias("mixed"))
