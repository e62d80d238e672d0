"""Mixing sources to target weights by Pfair scheduling, with built-in functions only.

A source's documents are cut into blocks. With weight w of all weights, an exact fraction, the source's k-th block is released at
floor(k / w) and due at ceil((k + 1) / w); among released blocks the earliest deadline goes first. The fractions add up to 1, so every
deadline is met and, in any run of slots from the start, each source is less than one block from its weight for as long as it
has blocks, however long the table is.

Weights that are whole numbers of ``slots`` repeat: their schedule is worked out for one period and a block's slot follows from its number.
Other weights have no short period: the blocks that exist are scheduled one by one on the driver (one slot number a block is kept), and a
block's slot is looked up.

A source that ends early leaves its slots empty and the others keep their order and proportions. No document is dropped, repeated
or capped.

Documents of a source are numbered in the order of an MD5 of their id, a fixed shuffle. Numbering is done in chunks of
that order, as many for every source as there are tasks, with prefix sums of the chunks' counts; so a source with a third of all rows is spread over all tasks.

Defined cases: a null source is a source of its own. Null ids are ordered first. Rows with the same id are ordered by their
other columns. An empty table gives an empty result. Columns named block, slot or position are replaced.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions


#: Slot numbers a row of the lookup table, and blocks up to which the table (8 bytes a block) is broadcast.
LOOKUP_BLOCKS = 256
BROADCAST_BLOCKS = 2_000_000


def fractions_of(weights: dict[str, float]) -> dict[str, Fraction]:
    """Each weight as written in decimals, as an exact part of all."""
    exact = {k: Fraction(repr(float(v))) for k, v in weights.items()}
    if bad := sorted(k for k, v in exact.items() if v <= 0):
        raise ValueError(f"weights must be above zero: {bad[:5]}")
    total = sum(exact.values())
    return {k: v / total for k, v in exact.items()}


def shares_of(weights: dict[str, float], slots: int) -> dict[str, int]:
    """Whole slots by weight, rounded by largest remainders, then by name; one at least each."""
    if len(weights) > slots:
        raise ValueError(f"{len(weights)} sources need at least as many slots a period; there are {slots}")
    ideal = {k: slots * w for k, w in fractions_of(weights).items()}
    shares = {k: max(1, int(v)) for k, v in ideal.items()}
    while (left := slots - sum(shares.values())) > 0:
        for k in sorted(ideal, key=lambda k: (shares[k] - ideal[k], k))[:left]:
            shares[k] += 1
    while sum(shares.values()) > slots:
        shares[max((k for k in shares if shares[k] > 1), key=lambda k: (shares[k] - ideal[k], k))] -= 1
    return shares


def schedule(parts: dict[str, Fraction], blocks: dict[str, int]) -> dict[str, np.ndarray]:
    """The slot of each of a source's blocks: earliest deadline first among released blocks; ended sources leave slots free."""
    out = {name: np.empty(n, np.int64) for name, n in blocks.items()}
    waiting = [(0, name, 0) for name, n in blocks.items() if n]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slot = 0
    while waiting or ready:
        if not ready and waiting[0][0] > slot:
            slot = waiting[0][0]
        while waiting and waiting[0][0] <= slot:
            _, name, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * parts[name].denominator // parts[name].numerator), name, k))
        deadline, name, k = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("missed a deadline")
        out[name][k] = slot
        slot += 1
        if k + 1 < blocks[name]:
            heapq.heappush(waiting, ((k + 1) * parts[name].denominator // parts[name].numerator, name, k + 1))
    return out


def period(shares: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block of the period, slot): earliest deadline first among released blocks."""
    slots = sum(shares.values())
    release = lambda k, a: k * slots // a
    due = lambda k, a: -(-(k + 1) * slots // a)
    waiting = [(0, name, 0) for name in shares]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, name, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due(k, shares[name]), name, k))
        deadline, name, k = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("missed a deadline")
        out.append((name, k, slot))
        if k + 1 < shares[name]:
            heapq.heappush(waiting, (release(k + 1, shares[name]), name, k + 1))
    return out


def _name(source: Column) -> Column:
    """Sources as non-null names."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    block_docs: int = 16,
    slots: int = 1000,
    alpha: float = 0.5,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Adds block (number within the source), slot and position (within the block); order by slot, position.

    weights: target weight by source, above zero; by default a source's count to the power alpha. One count a source and one slot
    number a block reach the driver.
    """
    spark = docs.sparkSession
    named = docs.drop("block", "slot", "position").withColumn("__name", _name(F.col(source_col)))
    counts = {r["__name"]: r["n"] for r in named.groupBy("__name").agg(F.count("*").alias("n")).collect()}
    if weights is None:
        target = {k: float(n) ** alpha for k, n in counts.items()}
    else:
        given = {"null" if k is None else f"={k}": v for k, v in weights.items()}
        if missing := sorted(counts.keys() - given.keys()):
            raise ValueError(f"no weight for sources {missing[:5]}")
        target = {k: given[k] for k in counts}
    chunks = 4 * partitions(spark)
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    chunk = F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * chunks / F.lit(1 << 32)).cast("int")
    keyed = named.withColumn("__key", key).withColumn("__chunk", chunk)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__name").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = keyed.groupBy("__name", "__chunk").agg(F.count("*").alias("n")).select("__name", "__chunk", before.alias("__before"))
    ties = [F.col(id_col), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c not in {"block", "slot", "position"}])]
    within = F.row_number().over(Window.partitionBy("__name", "__chunk").orderBy("__key", *ties)) - 1
    number = keyed.withColumn("__within", within).join(groups, ["__name", "__chunk"]).withColumn("__n", F.col("__before") + F.col("__within"))
    numbered = number.withColumn("block", F.floor(F.col("__n") / block_docs).cast("long"))
    placed, slot = _slots(numbered, target, {k: -(-n // block_docs) for k, n in counts.items()}, slots)
    return placed.select(*named.drop("__name").columns, "block", slot.alias("slot"), (F.col("__n") % block_docs).alias("position"))


def _slots(numbered: DataFrame, target: dict[str, float], blocks: dict[str, int], slots: int) -> tuple[DataFrame, Column]:
    """Rows joined to what their block's slot follows from, and the slot."""
    spark = numbered.sparkSession
    parts = fractions_of(target)
    shares = shares_of(target, slots) if target and len(target) <= slots else {}
    if all(Fraction(shares.get(k, 0), slots) == w for k, w in parts.items()):
        rows = [(name, k, slot, shares[name]) for name, k, slot in (period(shares) if shares else [])]
        table = F.broadcast(spark.createDataFrame(rows, "__name string, __k long, __at long, __share long"))
        share = F.broadcast(spark.createDataFrame(list(shares.items()), "__name string, __a long"))
        placed = numbered.join(share, "__name").withColumn("__k", F.col("block") % F.col("__a")).join(table, ["__name", "__k"])
        return placed, F.floor(F.col("block") / F.col("__a")).cast("long") * slots + F.col("__at")
    names, firsts, cuts = [], [], []
    for name, found in schedule(parts, blocks).items():
        for first in range(0, len(found), LOOKUP_BLOCKS):
            names.append(name)
            firsts.append(first // LOOKUP_BLOCKS)
            cuts.append(found[first : first + LOOKUP_BLOCKS])
    columns = [pa.array(names, pa.string()), pa.array(firsts, pa.int64()), pa.array(cuts, pa.list_(pa.int64()))]
    table = spark.createDataFrame(pa.Table.from_arrays(columns, ["__name", "__k", "__slots"]))
    if sum(blocks.values()) <= BROADCAST_BLOCKS:
        table = F.broadcast(table)
    placed = numbered.withColumn("__k", F.floor(F.col("block") / LOOKUP_BLOCKS).cast("long")).join(table, ["__name", "__k"])
    return placed, F.get("__slots", (F.col("block") % LOOKUP_BLOCKS).cast("int"))
