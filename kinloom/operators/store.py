"""Versions of tables with keys, as a log of upserts: a version is a folder of its own rows and a list of the parts that it goes on from.

Reading merges: of each key the row of the newest part counts, and none if that part took the key away. So a version writes its own rows alone, however large the tables are. When ``width`` parts
of one level stand at the end of the list they are written as one of the next level: n versions leave less than ``width`` parts a level, and a row is written anew once a level
at most, so about log(n) times, not once a version. What a reader needs is the list, a row a part.

Whole snapshots are versions without a list; later ones go on from them, and merging leaves them as they are. The list is written last: a version that was cut off has none, is named by no
ledger, and is never read. Files of a version are never changed.

Defined cases: a version may bring no rows. Of a snapshot all rows are kept, also several of one key, until a later version brings or takes away that key. One writer at a time.
Keys are not null.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import read_or

WIDTH = 8
#: Level of a whole snapshot, which no merge takes in.
WHOLE = 1000
PARTS = "place int, version string, level int"
_GONE = "__gone"

Keys = dict[str, list[str]]


def parts_of(spark: SparkSession, root: str, version: str) -> list[tuple[str, int]]:
    """(part, level) of a version, oldest first."""
    rows = read_or(spark, f"{root}/{version}/parts", PARTS).collect()
    return [(r.version, r.level) for r in sorted(rows, key=lambda r: r.place)] or [(version, WHOLE)]


def _rows(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df if _GONE in df.columns else df.withColumn(_GONE, F.lit(False))


def _latest(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Of each key the row of the last part that has one. Only rows of later parts are grouped; the first, the largest as a rule, is read past their keys."""
    first, *later = parts
    if not later:
        return first
    numbered = [df.withColumn("__place", F.lit(i)) for i, df in enumerate(later)]
    rest = [c for c in first.columns if c not in keys]
    newest = functools.reduce(DataFrame.unionByName, numbered).groupBy(*keys).agg(F.max_by(F.struct(*rest), "__place").alias("__row")).select(*keys, "__row.*")
    return first.join(newest.select(*keys), keys, "left_anti").select(*first.columns).unionByName(newest)


def read_version(spark: SparkSession, root: str, version: str, keys: Keys) -> dict[str, DataFrame]:
    """The tables of a version."""
    parts = [f"{root}/{part}" for part, _ in parts_of(spark, root, version)]
    return {name: _latest([_rows(spark, f"{p}/{name}") for p in parts], key).where(~F.col(_GONE)).drop(_GONE) for name, key in keys.items()}


def write_version(changed: dict[str, DataFrame], root: str, version: str, last: str | None, keys: Keys, gone: dict[str, DataFrame] | None = None, width: int = WIDTH) -> None:
    """Writes what changes the version ``last`` into a new one: whole rows by table, one a key, and the keys that are gone."""
    spark = next(iter(changed.values())).sparkSession
    if width < 2:
        raise ValueError("width must be 2 or more")
    for name, df in changed.items():
        rows = df.withColumn(_GONE, F.lit(False))
        if gone and name in gone:
            lost = gone[name].select(*keys[name]).distinct()
            rows = rows.join(lost, keys[name], "left_anti").unionByName(lost.withColumn(_GONE, F.lit(True)), allowMissingColumns=True)
        rows.write.parquet(f"{root}/{version}/{name}")
    parts = [*(parts_of(spark, root, last) if last else []), (version, 0)]
    while len(tail := parts[-width:]) == width and len({level for _, level in tail}) == 1:
        level = tail[0][1] + 1
        into = f"{version}-{level}"
        for name, key in keys.items():
            merged = _latest([_rows(spark, f"{root}/{p}/{name}") for p, _ in tail], key)
            # with nothing older below, keys that are gone need no mark
            merged = merged if len(parts) > width else merged.where(~F.col(_GONE))
            merged.write.parquet(f"{root}/{into}/{name}")
        parts = [*parts[:-width], (into, level)]
    spark.createDataFrame([(i, p, level) for i, (p, level) in enumerate(parts)], PARTS).coalesce(1).write.parquet(f"{root}/{version}/parts")
