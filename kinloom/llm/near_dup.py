"""Near-duplicate documents: MinHash by fast similarity sketching, banding, exact verification, components.

1. Each document's set of word shingles is hashed (64 bits); documents with equal sets form a class, whose smallest doc_id stands for it. So
   exact copies cost one row, whatever their number.
2. A sketch of t coordinates: in round i each shingle goes to a bin of its own for that round, with a value in [i, i + 1), and each bin
   keeps its least; rounds go on until every bin is filled, and from round t on all shingles go to bin i - t, so 2t rounds always
   fill. Equal coordinates estimate the Jaccard similarity with Chernoff-like concentration.
3. Bands of r coordinates: classes that share a band meet at the band's smallest class; the components of these stars
   are candidate groups. A pair at similarity s is missed with probability (1 - s ** r) ** bands: 4e-7 at 0.8
   with 80 bands of 8 rows, 7e-7 at 0.85 with 54 of 9. Pairs that only share a common passage rarely meet. Sets too small to reach the threshold with a different set skip this.
4. Each group is verified exactly on full sets, in blocks of members that are bounded by number and by bytes. First every block is compared with the group's
   block 0. A member that this ties to the largest part of block 0 is settled: it is in the same component as all others that are. Only pairs with an unsettled
   member outside block 0 are left, and those are compared next, block by block. So no link is lost, no group is held in one task, and pairs are never emitted: a
   task counts common shingles of two blocks and returns a spanning forest of the links, at most one row a member.
5. The components of the verified links give the smallest reachable doc_id.

Cost: of a group with m different texts, 2 m rows are shipped first; u unsettled members cost another u * m / block rows and u * m comparisons, done as matrix
products. Exact copies add nothing to m.

Defined cases: a text without words has an empty set and is its own component. Null doc_ids link with nothing: component
null, kept. Rows with the same doc_id are one document: both kept if it is kept. Very long texts are read whole; a batch is cut where its sets get large. An empty
table gives an empty result. Other columns are not carried, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, hashes_of, partitions, slices_of, split_words, stored
from .components import components

U64 = np.uint64
#: Shingles up to which the sets of a batch are sketched together.
TOGETHER = 1 << 20
#: Odd multipliers for mixing 64-bit hashes.
MIX = (U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * MIX[1]
    x = (x ^ (x >> U64(27))) * MIX[2]
    return x ^ (x >> U64(31))


def rolled(h: np.ndarray, width: int, multiplier: np.uint64 = MIX[0]) -> np.ndarray:
    """A hash of each run of ``width`` word hashes."""
    n = max(0, len(h) - width + 1)
    total = h[:n].copy()
    for i in range(1, width):
        total *= multiplier
        total += h[i : i + n]
    return mix(total + U64(width))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z are lowered, white space is space and tab to carriage return."""
    words = split_words(pc.ascii_lower(texts.cast(pa.string())))
    h, ends = hashes_of(words.values), words.offsets.to_numpy()
    whole = rolled(h, width)
    # a text of fewer words has its whole sequence as its one shingle
    return [np.unique(whole[a : b - width + 1] if b - a >= width else rolled(h[a:b], max(b - a, 1))) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()), width)[0]


def key_of(items: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; None for the empty one."""
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of t coordinates a set; every set has at least one element."""
    n = len(sets)
    out = np.full(n * t, np.iinfo(np.uint64).max, U64)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    for i in range(2 * t):
        h = mix(items + U64((i + 1) * int(MIX[0]) & 0xFFFFFFFFFFFFFFFF))
        if i < t:
            place = ((h & U64(0xFFFFFFFF)) * U64(t) >> U64(32)).astype(np.int64)
        else:
            place = np.int64(i - t)
        value = (U64(i) << U64(48)) | (h >> U64(16))
        np.minimum.at(out, owner * t + place, value)
        open_ = (out.reshape(n, t) == np.iinfo(np.uint64).max).any(1)
        if not open_.any():
            break
        stay = open_[owner]
        items, owner = items[stay], owner[stay]
    return out.reshape(n, t)


def bands_of(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit hash for each band of each sketch; the band's number is part of it."""
    n, t = sketch.shape
    cut = sketch.reshape(n, t // rows, rows)
    total = np.broadcast_to(np.arange(1, t // rows + 1, dtype=U64), (n, t // rows)).copy()
    for k in range(rows):
        total = mix(total * MIX[0] + cut[:, :, k])
    return total


def labels_of(keys: np.ndarray, sets: list[np.ndarray], percent: int, columns: int = 4096) -> np.ndarray:
    """For each set the smallest key of its component, by links among the sets.

    Common shingles are counted by products of membership matrices, some columns at a time.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(uses > 1)
    number = np.full(len(uses), -1)
    number[shared] = np.arange(len(shared))
    column = number[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.float32)
    for begin in range(0, len(shared), columns):
        a, b = np.searchsorted(column, [begin, begin + columns])
        member = np.zeros((n, min(columns, len(shared) - begin)), np.float32)
        member[owner[a:b], column[a:b] - begin] = 1
        common += member @ member.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = 100 * common.astype(np.int64) >= percent * union.astype(np.int64)
    np.fill_diagonal(linked, False)
    label = keys.copy()
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
        if (least == label).all():
            return label
        label = least


def shingle_docs(docs: DataFrame, width: int, percent: int, rows: int, bands: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_key, bands (empty where the set can only be linked with an equal one)."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch["id"].astype("Int64").array, pa.array(batch["text"], pa.string())
            for first, some in slices_of(texts):
                sets, at = shingle_sets(some, width), 0
                while at < len(sets):
                    end, size = at, 0
                    while end < len(sets) and end - at < 512 and (end == at or size + len(sets[end]) <= TOGETHER):
                        size, end = size + len(sets[end]), end + 1
                    yield sketched(ids[first + at : first + end], sets[at:end])
                    at = end

    def sketched(ids, sets: list[np.ndarray]) -> pd.DataFrame:
        # a set of n differs from another by one element at least: n / (n + 1) must reach the threshold
        big = [i for i, s in enumerate(sets) if 100 * len(s) >= percent * (len(s) + 1)]
        found: list[list[int]] = [[] for _ in sets]
        if big:
            for i, row in zip(big, bands_of(sketches([sets[i] for i in big], rows * bands), rows).view(np.int64), strict=True):
                found[i] = row
        return pd.DataFrame({"doc_id": ids, "n_shingles": [len(s) for s in sets], "set_key": [key_of(s) for s in sets], "bands": found})

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInPandas(sketch, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def met_in_batch(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bands and nodes of a batch's rows, sorted and distinct, and whether a record is the first of its band."""
    bands = [b for b in batch["bands"] if len(b)]
    if not bands:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    band = np.concatenate(bands)
    node = np.repeat(batch["node"].to_numpy(np.int64), [len(b) for b in batch["bands"]])
    order = np.lexsort((node, band))
    band, node = band[order], node[order]
    new = np.append(True, band[1:] != band[:-1])
    keep = new | np.append(True, node[1:] != node[:-1])
    return band[keep], node[keep], new[keep]


def links_in_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b) from each node to the smallest node of the batch that shares a band with it."""
    for batch in batches:
        _, node, new = met_in_batch(batch)
        first = node[np.maximum.accumulate(np.where(new, np.arange(len(node)), 0))]
        yield pd.DataFrame({"a": node[~new], "b": first[~new]}).drop_duplicates()


def firsts_of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(band, node): each band of a batch once, with its smallest node."""
    for batch in batches:
        band, node, new = met_in_batch(batch)
        yield pd.DataFrame({"band": band[new], "node": node[new]})


def candidate_groups(found: DataFrame) -> DataFrame:
    """(node, component) over classes, each named by the hash of its set, that share a band, directly or by others.

    Classes that meet within a batch are linked there. Of each band a batch sends on its smallest class alone, so in the one shuffle of bands a band has
    at most a record a batch, whatever the number of its classes and copies.
    """
    sketched = found.where("set_key IS NOT NULL AND doc_id IS NOT NULL").select(F.xxhash64("set_key").alias("node"), "bands")
    least = F.min("node").over(Window.partitionBy("band"))
    across = sketched.mapInPandas(firsts_of_batches, "band long, node long").select(F.col("node").alias("a"), least.alias("b")).where("a <> b")
    return components(sketched.mapInPandas(links_in_batches, "a long, b long").union(across))


def links_of_tasks(percent: int):
    """A function for mapInPandas over rows (task, node, first, items), sorted by task: (a, b) links that span the components of each task's sets; and (a, null) for
    each member outside block 0 (first = false) that is not tied to the largest part of block 0."""

    def compared(nodes: list[int], firsts: list[bool], items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, at = np.unique(np.array(nodes, np.int64), return_index=True)
        first = np.array(firsts)[at]
        label = labels_of(keys, [np.frombuffer(items[k], U64) for k in at.tolist()], percent)
        open_ = np.zeros(0, np.int64)
        if first.any() and not first.all():
            # the largest part of block 0 by its own links alone, the same in all its tasks
            own = labels_of(keys[first], [np.frombuffer(items[k], U64) for k in at[first].tolist()], percent)
            names, sizes = np.unique(own, return_counts=True)
            main = label[np.searchsorted(keys, names[np.argmax(sizes)])]
            open_ = keys[~first & (label != main)]
        moved = keys != label
        return keys[moved], label[moved], open_

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, held = None, ([], [], [])

        def flush() -> pd.DataFrame:
            a, b, open_ = compared(*held)
            return pd.DataFrame({"a": np.append(a, open_), "b": pd.array([*b.tolist(), *[None] * len(open_)], "Int64")})

        for batch in batches:
            out = []
            for now, *row in zip(batch["task"], batch["node"], batch["first"], batch["items"], strict=True):
                if now != task and held[0]:
                    out.append(flush())
                    held = ([], [], [])
                task = now
                for column, value in zip(held, row, strict=True):
                    column.append(value)
            yield from out
        if held[0]:
            yield flush()

    return links


def verified_links(docs: DataFrame, groups: DataFrame, classes: DataFrame, width: int, percent: int, block: int, block_bytes: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(a, b) links that span the components of each candidate group, checked on full sets."""
    spark = docs.sparkSession
    blocks_of = lambda n, size: F.ceil(F.greatest(n / block, 8 * size / block_bytes)).cast("int")
    named = classes.select(F.xxhash64("set_key").alias("class"), F.col("rep").alias("node"), "set_key", "size")
    grouped = scratch.stored(groups.withColumnRenamed("node", "class").join(named, "class").drop("class"), "grouped")
    sizes = scratch.stored(grouped.groupBy("component").agg(blocks_of(F.count("*"), F.sum("size")).alias("blocks")), "group-sizes")
    members = grouped.join(sizes, "component")

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [s for _, some in slices_of(pa.array(batch["text"], pa.string())) for s in shingle_sets(some, width)]
            same = [key_of(s) == bytes(want) for s, want in zip(sets, batch["set_key"], strict=True)]
            yield pd.DataFrame({"component": batch["component"], "node": batch["node"], "blocks": batch["blocks"], "items": [s.tobytes() for s in sets]})[same]

    def compare(sent: DataFrame, *keys: str) -> DataFrame:
        dealt = sent.select(F.xxhash64("component", *keys).alias("task"), "node", "first", "items")
        dealt = dealt.repartition(partitions(spark), "task").sortWithinPartitions("task")
        return dealt.mapInPandas(links_of_tasks(percent), "a long, b long")

    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).where("node IS NOT NULL")
    sets = texts.join(members, "node").select("component", "node", "blocks", "set_key", "text").mapInPandas(to_sets, "component long, node long, blocks int, items binary")
    sets = scratch.stored(sets.dropDuplicates(["node"]).withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "group-sets")

    # block 0 meets every block
    others = F.when((F.col("mine") == 0) & (F.col("blocks") > 1), F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array("mine"))
    sent = sets.select("component", "node", (F.col("mine") == 0).alias("first"), F.explode(others).alias("j"), "items")
    near = scratch.stored(compare(sent, "j"), "first-links")

    # what is not settled meets all members but block 0
    rest = sets.where("blocks > 2 AND mine > 0").drop("blocks", "mine")
    rest = rest.join(near.where("b IS NULL").select(F.col("a").alias("node"), F.lit(True).alias("loose")).distinct(), "node", "left").withColumn("loose", F.col("loose").isNotNull())
    counted = lambda flag: (F.count_if(flag), F.sum(F.when(flag, F.octet_length("items") / 8).otherwise(0)))
    cut = rest.groupBy("component").agg(blocks_of(*counted(F.col("loose"))).alias("loose_blocks"), blocks_of(*counted(~F.col("loose"))).alias("tied_blocks"))
    rest = rest.join(scratch.stored(cut.where("loose_blocks > 0"), "loose-sizes"), "component")
    rest = rest.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("loose"), F.col("loose_blocks")).otherwise(F.col("tied_blocks"))).cast("int"))
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    mine = F.col("mine")
    loose_pairs = F.concat(F.transform(upto("loose_blocks"), lambda y: pair("loose", F.least(mine, y), F.greatest(mine, y))), F.transform(upto("tied_blocks"), lambda y: pair("tied", mine, y)))
    pairs = F.when(F.col("loose"), loose_pairs).otherwise(F.transform(upto("loose_blocks"), lambda x: pair("tied", x, mine)))
    sent = rest.select("component", "node", F.lit(False).alias("first"), F.explode(pairs).alias("p"), "items").select("*", "p.*")
    return near.where("b IS NOT NULL").union(compare(sent, "kind", "i", "j"))


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    rows: int = 8,
    bands: int = 80,
    block: int = 32,
    block_bytes: int = 16 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for every row; texts are linked at a similarity of percent / 100 or more.

    rows and bands must suit percent: a pair at similarity s is missed with probability (1 - s ** rows) ** bands.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    found = scratch.stored(shingle_docs(docs, width, percent, rows, bands, id_col, text_col), "shingles")
    classes = found.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size"))
    classes = scratch.stored(classes, "classes")
    groups = candidate_groups(found)
    links = verified_links(docs, groups, classes, width, percent, block, block_bytes, id_col, text_col, scratch)
    joined = components(links)
    final = classes.select("set_key", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    final = scratch.stored(final.select("set_key", F.coalesce("component", "rep").alias("component")), "near-classes")
    out = found.drop("bands").join(final, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = stored(out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")), "near-duplicates")
    scratch.clear()
    return out
