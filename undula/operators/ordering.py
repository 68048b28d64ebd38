"""Positions, neighbours, ranks and runs, without a task that orders a whole series or table.

Series are cut by time into chunks; what passes between chunks is a row or two of each,
and only those are ordered together. Values are cut into ranges, of which a key has a
bounded number. Keys are known values; times of a key differ from one another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Keys = Sequence[str]
#: Values of t that one task orders at a time, and positions in a tile.
TIME_CHUNK = 4096
#: Ranges that the values of a key are cut into: this many times this many.
RANGES = 16


def joined(rows: DataFrame, other: DataFrame, keys: Keys, how: str = "inner") -> DataFrame:
    """rows with the columns that other has for their keys; without keys, other is one row."""
    return rows.join(other, list(keys), how) if keys else rows.join(F.broadcast(other))


def beside(rows: DataFrame, value: str, keys: Keys = (), name: str = "x", back: bool = False) -> DataFrame:
    """rows (keys, t, value) with the next value of the same keys, or the one before, as `name`; null at the end.

    Rows are ordered within chunks of time, and chunks meet by their first or last rows,
    of which there is one for each.
    """
    chunk = rows.withColumn("_chunk", F.floor(F.col("t") / TIME_CHUNK))
    end = chunk.groupBy(*keys, "_chunk").agg((F.max_by if back else F.min_by)(value, "t").alias("_end"))
    move = F.lag if back else F.lead
    over = end.select(*keys, "_chunk", move("_end").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_over"))
    within = move(value).over(Window.partitionBy(*keys, "_chunk").orderBy("t"))
    return chunk.join(over, [*keys, "_chunk"]).withColumn(name, F.coalesce(within, F.col("_over"))).drop("_chunk", "_over")


def following(rows: DataFrame, value: str, keys: Keys = (), name: str = "x") -> DataFrame:
    """rows (keys, t, value) with the next value of the same keys as `name`; null for the last."""
    return beside(rows, value, keys, name)


def numbered(rows: DataFrame, keys: Keys = (), name: str = "n") -> DataFrame:
    """rows (keys, t) with their position from 0 in the order of t within their keys, by counts of chunks."""
    chunk = rows.withColumn("_chunk", F.floor(F.col("t") / TIME_CHUNK))
    sizes = chunk.groupBy(*keys, "_chunk").agg(F.count("*").alias("_size"))
    before = sizes.select(*keys, "_chunk", (F.sum("_size").over(Window.partitionBy(*keys).orderBy("_chunk")) - F.col("_size")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy("t")) - 1
    return chunk.join(before, [*keys, "_chunk"]).withColumn(name, F.col("_before") + within).drop("_chunk", "_before")


def tiled(rows: DataFrame, before: int = 0, after: int = 0, n: str = "n") -> DataFrame:
    """rows with positions n, dealt to tiles: `_tile`, and `_own` for the tile that a row belongs to.

    A tile also has copies of the `before` rows in front of it and of the `after` rows
    behind, so that windows over its own rows need no other tile.
    """
    size = max(TIME_CHUNK, 2 * (before + after))
    tile, place = F.floor(F.col(n) / size), F.col(n) % size
    copies = F.array_compact(F.array(F.when(place < after, tile - 1), tile, F.when(place >= size - before, tile + 1)))
    return rows.withColumn("_tile", F.explode(copies)).withColumn("_own", F.col("_tile") == F.floor(F.col(n) / size))


def sign_runs(rows: DataFrame, sign: str, top: str, keys: Keys) -> DataFrame:
    """(keys, length, top): runs of rows of one sign that follow one another in t, and the largest `top` of each.

    Runs are told within chunks of time; the first and the last of each chunk then meet
    those of its neighbours.
    """
    chunk = rows.withColumn("_chunk", F.floor(F.col("t") / TIME_CHUNK))
    by = Window.partitionBy(*keys, "_chunk")
    turned = chunk.withColumn("_c", F.coalesce((F.col(sign) != F.lag(sign).over(by.orderBy("t"))).cast("int"), F.lit(0)))
    told = turned.withColumn("_run", F.sum("_c").over(by.orderBy("t")))
    runs = told.groupBy(*keys, "_chunk", "_run").agg(F.first(sign).alias("_s"), F.count("*").alias("length"), F.max(top).alias("top"))
    runs = runs.withColumn("_last", F.col("_run") == F.max("_run").over(by)).withColumn("_first", F.col("_run") == 0)
    inner = runs.where("not _first and not _last").select(*keys, "length", "top")
    # at most two runs of a chunk; one at its beginning goes on if the chunk before ended with its sign
    order = Window.partitionBy(*keys).orderBy("_chunk", "_run")
    goes_on = F.col("_first") & F.coalesce(F.col("_s") == F.lag("_s").over(order), F.lit(False))
    edges = runs.where("_first or _last").withColumn("_new", (~goes_on).cast("int")).withColumn("_run", F.sum("_new").over(order))
    return inner.unionByName(edges.groupBy(*keys, "_run").agg(F.sum("length").alias("length"), F.max("top").alias("top")).drop("_run"))


def value_ranks(rows: DataFrame, value: str, keys: Keys = (), bounds: tuple[float, float] | None = None) -> DataFrame:
    """(keys, value, count, below, total, range): each distinct value that is known, how often a key has it, and how many smaller ones.

    Equal values are counted before they are ordered. Ranges of a key, between
    approximate quantiles or, given bounds, of one width, are ordered by themselves, and
    their sizes put them in place. Values out of the bounds count in the ranges at the ends.
    """
    known = rows.where(F.col(value).isNotNull()).select(*keys, value)
    distinct = known.groupBy(*keys, value).agg(F.count("*").alias("count"))
    if bounds:
        width = (bounds[1] - bounds[0]) / RANGES**2
        placed = distinct.withColumn("range", F.greatest(F.least(F.floor((F.col(value) - bounds[0]) / width), F.lit(RANGES**2 - 1)), F.lit(0)).cast("int"))
    else:
        cuts = known.groupBy(*keys).agg(F.percentile_approx(value, [i / RANGES**2 for i in range(1, RANGES**2)], 20 * RANGES**2).alias("_cuts"))
        coarse = F.transform(F.sequence(F.lit(1), F.lit(RANGES - 1)), lambda i: F.element_at("_cuts", i * RANGES))
        steps = joined(distinct, cuts.withColumn("_coarse", coarse), keys).withColumn("_r", F.size(F.filter("_coarse", lambda c: c < F.col(value))) * RANGES)
        fine = F.size(F.filter(F.slice("_cuts", F.col("_r") + 1, F.lit(RANGES)), lambda c: c < F.col(value)))
        placed = steps.withColumn("range", F.col("_r") + fine).drop("_cuts", "_coarse", "_r")
    sizes = placed.groupBy(*keys, "range").agg(F.sum("count").alias("_n"))
    each = Window.partitionBy(*keys)  # a bounded number of ranges
    before = sizes.select(*keys, "range", (F.sum("_n").over(each.orderBy("range")) - F.col("_n")).alias("_before"), F.sum("_n").over(each).alias("total"))
    within = F.sum("count").over(Window.partitionBy(*keys, "range").orderBy(value)) - F.col("count")
    return placed.join(before, [*keys, "range"]).withColumn("below", F.col("_before") + within).drop("_before")


def least_from(ranks: DataFrame, value: str, scaled: Column, keys: Keys = (), name: str = "least") -> DataFrame:
    """value_ranks with `name`: the least `scaled` of a value and those above it, range by range."""
    x = ranks.withColumn("_x", scaled)
    lows = x.groupBy(*keys, "range").agg(F.min("_x").alias("_low"))
    above = F.min("_low").over(Window.partitionBy(*keys).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1))  # bounded
    within = F.min("_x").over(Window.partitionBy(*keys, "range").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0))
    return x.join(lows.select(*keys, "range", above.alias("_above")), [*keys, "range"]).withColumn(name, F.least(within, "_above")).drop("_x", "_above")


def at_positions(ranks: DataFrame, value: str, place: Column, keys: Keys = (), name: str = "value") -> DataFrame:
    """(keys, name): the value at a position from 1, linear between whole ones; of rows of value_ranks, place may use total."""
    low = F.floor(place)
    covers = lambda p: (F.col("below") < p) & (p <= F.col("below") + F.col("count"))
    share = F.when(covers(low), 1 - (place - low)).otherwise(0.0) + F.when(covers(low + 1), place - low).otherwise(0.0)
    return ranks.groupBy(*keys).agg(F.sum(F.when(share > 0, F.col(value) * share)).alias(name))
