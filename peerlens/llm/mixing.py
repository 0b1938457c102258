"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Sources, by code point with null last, have the weights 5, 2, 1, repeating. They share all words of the corpus; a target stops at
MOST times the words of its source and the excess goes to the others by weight, until none is above (a water level, found in one sort
of the sources' totals). A document's expected copies are target / words of its source. Expected copies are summed up in the order of
the documents of a source, one offset drawn for the source is added, and a document is taken once for each whole number that its own
share of the sum crosses: so a document with e expected copies has floor(e) or ceil(e). All sums are whole numbers of 2^-32 copies.

The order is by size (to 1 %), then by a hash of doc_id and text, so that the words taken of a source are near its target whatever the
sizes are. The sum has two levels: a source is cut into blocks by size and range of the hash, of about BLOCK rows; blocks are added up,
then the rows within each. What one task holds is a block of rows, the blocks of one source, or one row for each source. The table
of sources and sizes is broadcast up to BROADCAST_RANGES rows, else joined by shuffle.

Defined results: a null text is empty and has size 0; documents without words are taken like others but add no words; a source without
words has target 0. A null source is a source. Repeated rows are documents of their own; rows that agree in doc_id, source and text
share a place in the order and a block. An empty table gives an empty result. Other columns of any name are kept by copies() and mixed().
The draw depends on `seed`, doc_id, source and text alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 13
BLOCK = 20_000
BROADCAST_RANGES = 100_000
ONE = 2**32
WORD = r"[^\x20\x09-\x0D]+"

_ALL_BEFORE = (Window.unboundedPreceding, -1)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: str) -> Column:
    """Orders and joins like the source, null last."""
    return F.struct(F.col(source).isNull().alias("null"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"))


def _bin(size: str) -> Column:
    """Sizes to their eight leading bits: ascending with the size, a few thousand values at most."""
    return F.expr(f"length(bin({size})) * 256 + shiftright({size}, greatest(length(bin({size})) - 8, 0))")


def measured(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with size and order columns, and their names by role."""
    name = {role: fresh(docs.columns, f"_{role}") for role in ("size", "hash", "key", "bin", "slice", "expected", "at", "before", "copies", "source_size", "target", "slices")}
    mark = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    sized = docs.withColumns({name["size"]: words(F.col("text")), name["hash"]: F.conv(F.substring(mark, 1, 15), 16, 10).cast("long"), name["key"]: _source_key("source")})
    return sized.withColumn(name["bin"], _bin(name["size"])), name


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (key, source_size), one row for each source, with target: shares of all words by weight, none above `most` times its source."""
    rank = F.row_number().over(Window.orderBy("key")) - 1
    cap = F.col("source_size") * most
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(rank, F.lit(len(weights))) + 1)).withColumns({"cap": cap})
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    level = ranked.withColumns(
        {
            "nth": F.row_number().over(rising),
            "left": F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(rising.rowsBetween(*_ALL_BEFORE)), F.lit(0)),
            "heft": F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).withColumn("level", F.col("left").cast("double") / F.col("heft"))
    free = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("nth", "level"))
    found = level.withColumn("water", F.min(free).over(Window.partitionBy())["level"])
    return found.select("key", "source_size", F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")).alias("target"))


def _carried(ranges: DataFrame) -> DataFrame:
    """One row for each source and size: a broadcast side if they are few, else a side of a shuffled join, where AQE splits what is skewed."""
    return F.broadcast(ranges) if ranges.count() <= BROADCAST_RANGES else ranges


def allocated(sized: DataFrame, name: dict[str, str], weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The rows of measured() with their source's words and target, and the copies of each."""
    key, bin_, part, size, expected = (name[r] for r in ("key", "bin", "slice", "size", "expected"))
    bins = written(sized.groupBy(F.col(key).alias("key"), F.col(bin_).alias("bin")).agg(F.count("*").alias("rows"), F.sum(size).alias("words")), "mixing-bins")
    per = targets(bins.groupBy("key").agg(F.sum("words").alias("source_size")), weights, most)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key.name"))), 1, 8), 16, 10).cast("long")
    share = F.when(F.col("source_size") > 0, F.floor(F.col("target") * float(ONE) / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    per = per.select("key", "source_size", "target", share.alias("expected"), start.alias("start"))
    ranges = written(bins.join(per, "key").withColumn("slices", F.floor(F.col("rows") / BLOCK).cast("long") + 1), "mixing-ranges")
    known = _carried(ranges.select(F.col("key").alias(key), F.col("bin").alias(bin_), F.col("slices").alias(name["slices"]), F.col("expected").alias(expected)))
    placed = sized.join(known, [key, bin_]).withColumn(part, F.expr(f"shiftright(shiftright(`{name['hash']}`, 28) * `{name['slices']}`, 32)")).drop(name["slices"])
    in_source = Window.partitionBy(key).orderBy(bin_, part).rowsBetween(*_ALL_BEFORE)
    blocks = placed.groupBy(key, bin_, part).agg((F.sum(expected) % ONE).alias("sum")).select(key, bin_, part, F.coalesce(F.sum("sum").over(in_source), F.lit(0)).alias(name["before"]))
    marks = ranges.select(F.col("key").alias(key), F.col("bin").alias(bin_), F.col("source_size").alias(name["source_size"]), F.col("target").alias(name["target"]), F.col("start").alias(name["at"]))
    starts = written(blocks.join(_carried(marks), [key, bin_]), "mixing-blocks")
    inside = Window.partitionBy(key, bin_, part).orderBy(name["hash"], "doc_id", size).rowsBetween(*_ALL_BEFORE)
    at = (F.col(name["before"]) + F.coalesce(F.sum(expected).over(inside), F.lit(0)) + F.col(name["at"])) % ONE
    return placed.join(starts, [key, bin_, part]).withColumn(name["copies"], F.shiftright(at + F.col(expected), 32).cast("int"))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, column: str = "copies") -> DataFrame:
    """docs with the number of times that the mix takes each (`column`, which must be new)."""
    sized, name = measured(docs)
    return allocated(sized, name, weights, most, seed).select(*docs.columns, F.col(name["copies"]).alias(column))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix: each document as often as it is taken."""
    column = fresh(docs.columns, "copies")
    nth = F.explode(F.expr(f"CASE WHEN `{column}` > 0 THEN sequence(1, `{column}`) END"))
    return copies(docs, weights, most, seed, column).select(*docs.columns, nth.alias(fresh(docs.columns, "copy"))).select(*docs.columns)


def allocation(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies. Texts are read once; sizes and hashes are kept in the shared folder."""
    sized, name = measured(docs.select("doc_id", "source", "text"))
    narrow = written(sized.select("doc_id", *[name[r] for r in ("size", "hash", "key", "bin")]), "mixing-sizes")
    found = allocated(narrow, name, weights, most, seed)
    taken = F.col(name["size"]) * F.col(name["copies"])
    return found.select("doc_id", F.col(name["size"]).alias("size"), F.col(name["source_size"]).alias("source_size"), F.col(name["target"]).alias("target"), taken.alias("taken"), F.col(name["copies"]).alias("copies"))
