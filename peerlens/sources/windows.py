"""Sources that are read window by window, with windows that fail or are cut off split into smaller ones.

A source answers for a window (a facet and a range of whole numbers, such as years) with rows, and with no more than `limit` of them. A window
that reaches the limit may have been cut off, and one without an answer has failed; both are split, down to single numbers, and asked again. What a
round has found is stored, so a lost job goes on from the round before. Rows that are known or come twice are left out by their id.

A single number that is still cut off can't be split by its range. With `dealt`, it is asked for in parts: each round has twice as many, and a row belongs
to the part that a hash of its id gives, so every row comes in the end, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sinks import stored

#: windows (facet, first, last) -> rows with the facet, first and last they answer, or no row for a window that fails.
Fetch = Callable[[DataFrame], DataFrame]


def covering(facets: DataFrame, first: int, last: int, width: int) -> DataFrame:
    """facet, first, last: windows of `width` numbers from first to last for each facet."""
    start = F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(width)))
    return facets.select("facet", start.alias("first")).select("facet", "first", F.least(F.col("first") + width - 1, F.lit(last)).alias("last"))


def halves(windows: DataFrame) -> DataFrame:
    """Each window in two; single numbers stay out."""
    middle = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
    parts = F.explode(F.array(F.struct("first", middle.alias("last")), F.struct((middle + 1).alias("first"), "last")))
    return windows.where("first < last").select("facet", parts.alias("p")).select("facet", "p.first", "p.last")


def singles(windows: DataFrame) -> DataFrame:
    """Each window of several numbers as windows of one."""
    return windows.where("first < last").select("facet", F.explode(F.sequence("first", "last")).alias("first")).select("facet", "first", F.col("first").alias("last"))


def part_of(key: Column, parts: Column) -> Column:
    """The part, of so many, that a row belongs to by its id."""
    return F.pmod(F.xxhash64(key), parts.cast("long")).cast("int")


def more_parts(windows: DataFrame) -> DataFrame:
    """Windows of one number in twice as many parts: a part's rows lie in the one with its number and in the one as many parts behind."""
    part = F.explode(F.array(F.col("part"), F.col("part") + F.col("parts")))
    return windows.where("first = last").select("facet", "first", "last", (F.col("parts") * 2).alias("parts"), part.alias("part"))


def fetched(windows: DataFrame, fetch: Fetch, key: str, limit: int, seen: DataFrame | None = None, split: Callable[[DataFrame], DataFrame] = halves, rounds: int = 40, dealt: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows of all windows, one for each id that isn't seen, and the windows that stay cut off or failed (facet, first, last, rows).

    Single numbers that are cut off keep the rows they gave; with `dealt` they are asked for in more and more parts until none is cut off: windows then have the
    columns part and parts too, and fetch gives only rows whose part_of(id, parts) is the window's. Of several rows with one id the one of the least window counts.
    """
    names = ["facet", "first", "last"]
    pending, found, open_ = windows.select(*names).distinct(), None, None
    if dealt:
        names = [*names, "parts", "part"]
        pending = pending.withColumns({"parts": F.lit(1), "part": F.lit(0)})
    for _ in range(rounds):
        rows = stored(fetch(pending), "window-rows")
        counts = rows.groupBy(*names).agg(F.count("*").alias("rows"))
        state = stored(pending.join(counts, names, "left").fillna(0, ["rows"]), "windows")
        one, full = F.col("first") == F.col("last"), F.col("rows") >= limit
        # a part without rows has none: its window answers
        empty = (F.col("rows") == 0) & (F.col("parts") == 1) if dealt else F.col("rows") == 0
        good = state.where((F.col("rows") > 0) & ~full | (F.lit(False) if dealt else full & one))
        kept = rows.join(good.select(*names), names, "left_semi")
        found = kept if found is None else found.unionByName(kept)
        bad = state.where(empty | full)
        left = bad.where(one & ~full if dealt else one)
        open_ = left if open_ is None else open_.unionByName(left)
        halved = split(bad)
        if dealt:
            halved = halved.withColumns({"parts": F.lit(1), "part": F.lit(0)}).unionByName(more_parts(bad.where(full)))
        pending = stored(halved, "windows-left")
        if pending.isEmpty():
            break
    else:
        open_ = open_.unionByName(pending.withColumn("rows", F.lit(None).cast("long")))
    order = Window.partitionBy(key).orderBy(*names)
    once = found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return (once if seen is None else once.join(seen.select(key).distinct(), key, "left_anti")), open_
