"""Exact-size deterministic samples and splits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.functions.quantiles import placed


#: Counts of rows that a pass brings to the driver at most, and rows of the last cell that may follow them.
HASH_CELLS, LAST_CELL = 65_536, 10_000


def _within_first(df: DataFrame, h: Column, tie: Column, n: int) -> Column:
    """A condition that holds for the first n rows in the order of (h, tie), h a 64-bit hash and the pairs distinct.

    A pass counts rows by the next 16 bits of h within the cell that holds the n-th row, so at most four passes over two columns
    narrow it down; no row is sorted or moved, but for those of a last cell of at most LAST_CELL rows (or of one equal hash).
    """
    keyed = df.select(h.alias("h"), tie.alias("t"))
    shift, cell, left = 64, None, n
    while shift:
        shift -= 16
        inside = keyed if cell is None else keyed.where(F.shiftright("h", shift + 16) == cell)
        counts = {r.c: r.n for r in inside.groupBy(F.shiftright("h", shift).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most HASH_CELLS
        if left >= sum(counts.values()):
            return F.lit(True) if cell is None else F.shiftright(h, shift + 16) <= cell
        for c in sorted(counts):
            if left < counts[c]:
                cell = c
                break
            left -= counts[c]
        if not left:
            return F.shiftright(h, shift) < cell
        if counts[cell] <= LAST_CELL:
            break
    here = keyed.where(F.shiftright("h", shift) == cell)
    last = here.orderBy("h", "t").limit(left).agg(F.max(F.struct("h", "t")).alias("x")).first().x
    return (h < last.h) | ((h == last.h) & (tie <= F.lit(last.t)))


def uniform_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly min(n, rows) rows without replacement, the first by the key's seeded hash, as a filter on df. Keys are distinct."""
    return df.where(_within_first(df, F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.col(key), n))


def bootstrap_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows with replacement; keys are distinct. An empty table gives none.

    Keys fall into at most HASH_CELLS cells by hash. The draws of each cell are one multinomial split of n by the cells' sizes, on the driver; a task
    then draws from the rows of a cell, in the order of their keys, with a generator of its own that seed and cell name.
    """
    total = df.count()
    if not total:
        return df
    cells = min(HASH_CELLS, -(-total // 1_000))
    keyed = df.select(F.col(key).alias("_k"), F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(cells)).alias("_c"))
    sizes = sorted((r["_c"], r["count"]) for r in keyed.groupBy("_c").count().collect())  # at most HASH_CELLS
    drawn = np.random.default_rng(seed).multinomial(n, np.array([m for _, m in sizes]) / total)
    table = F.broadcast(df.sparkSession.createDataFrame([(c, int(d)) for (c, _), d in zip(sizes, drawn, strict=True) if d], "_c long, _d long"))

    def draw(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("_k")
        rng = np.random.default_rng([seed, int(group[0])])
        times = np.bincount(rng.integers(0, len(rows), int(rows["_d"].iloc[0])), minlength=len(rows))
        return pd.DataFrame({"_k": rows["_k"].to_numpy()[times > 0], "_times": times[times > 0]})

    times = keyed.join(table, "_c").groupBy("_c").applyInPandas(draw, f"_k {df.schema[key].dataType.simpleString()}, _times int")
    return df.join(times, F.col(key) == F.col("_k")).withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_k", "_times", "_t")


def quotas(sizes: dict[str, int], n: int) -> dict[str, int]:
    """Shares of n in proportion to sizes by largest remainders, ties by name; they add up to min(n, total)."""
    total = sum(sizes.values())
    n = min(n, total)
    if not total:
        return {}
    exact = {g: n * s / total for g, s in sizes.items()}
    out = {g: int(x) for g, x in exact.items()}
    for g in sorted(sizes, key=lambda g: (out[g] - exact[g], g))[: n - sum(out.values())]:
        out[g] += 1
    return out


def stratified_sample(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows, a bounded number, each group in proportion; keys are distinct, and rows without a group are not drawn."""
    share = quotas({r[group]: r["count"] for r in df.where(F.col(group).isNotNull()).groupBy(group).count().collect()}, n)
    table = df.sparkSession.createDataFrame(list(share.items()), f"{group} string, _quota int")
    order = F.struct(F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("h"), F.col(key).alias("key"))
    places = placed(df.select(F.col(group).alias("_g"), order.alias("_o")), ["_g"], "_o")
    chosen = places.join(F.broadcast(table.withColumnRenamed(group, "_g")), "_g").where("before < _quota").select("_g", F.col("_o.key").alias("_k"))  # n rows
    return df.join(F.broadcast(chosen), (F.col(group) == F.col("_g")) & (F.col(key) == F.col("_k")), "left_semi")


def group_subsample(df: DataFrame, group: Sequence[str], fraction: float, seed: int) -> DataFrame:
    """All rows of a fraction of the groups, drawn without replacement."""
    groups = df.select(*group).distinct()
    n = round(fraction * groups.count())
    kept = groups.where(_within_first(groups, F.xxhash64(*group, F.lit(seed)), F.struct(*group), n))
    return df.join(_small(kept), list(group), "left_semi")


def _small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A broadcast hint where a count proves at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hold_out(df: DataFrame, column: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(train, test): test has the value; null goes to train."""
    is_test = F.coalesce(F.col(column) == value, F.lit(False))
    return df.where(~is_test), df.where(is_test)


def group_slice(df: DataFrame, group: Sequence[str], start: int, end: int) -> DataFrame:
    """Rows of the groups numbered start..end-1 in sorted order."""
    places = placed(df.select(F.struct(*group).alias("_g")).distinct(), [], "_g").where((F.col("before") >= start) & (F.col("before") < end))
    return df.join(_small(places.select("_g.*")), list(group), "left_semi")
