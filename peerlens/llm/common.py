"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_LONG = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor and the driver can read: spark.checkpoint.dir, or one under the warehouse in tests."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


_made: list[tuple[str, str]] = []


def made() -> int:
    """How many tables and folders there are by now; see release()."""
    return len(_made)


def release(spark: SparkSession, keep: DataFrame | None = None, since: int = 0) -> None:
    """Drops the tables and folders that written() and bucketed() have made since made() was `since`, but for the one that `keep`
    reads; call it when no other result of theirs is needed any more."""
    kept = None if keep is None else keep.__dict__.get("_folder")
    left = [m for m in _made[since:] if m[1] == kept]
    for kind, name in _made[since:]:
        if name == kept:
            continue
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _made[since:] = left


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage so that a lost executor costs a read, not a rebuild."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append(("folder", path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """A copy of df in the warehouse, bucketed by keys: joins on them shuffle the other side only."""
    name = f"bucketed_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").bucketBy(shuffle_partitions(df.sparkSession), *keys).saveAsTable(name)
    _made.append(("table", name))
    return df.sparkSession.table(name)


def fresh(columns: list[str], name: str) -> str:
    """name, with as many underscores behind it as it takes to differ from all columns, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def order_bounds(df: DataFrame, key: str, buckets: int) -> list[int]:
    """Up to buckets - 1 ascending values that cut the key's values into ranges of about equal row counts."""
    if buckets <= 1:
        return []
    at = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(key, at, 20 * buckets).alias("b")).first()["b"]
    return sorted(set(found or []))


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds that are at or below the key; two short scans in place of one over all bounds."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*[F.lit(b).cast("long") for b in bounds[::step]])
    groups = F.array(*[F.array(*[F.lit(b).cast("long") for b in bounds[i : i + step]]) for i in range(0, len(bounds), step)])
    at = F.size(F.filter(coarse, lambda b: b <= key))
    return F.when(at == 0, F.lit(0)).otherwise(
        (at - 1) * step + F.size(F.filter(F.element_at(groups, F.greatest(at, F.lit(1))), lambda b: b <= key))
    )


def bucket_count(df: DataFrame, rows_per_bucket: int = 20_000, most: int = 65_536) -> int:
    """At least a few buckets for each shuffle partition, more when the table is large, never more than rows."""
    n = df.count()
    return max(1, min(n, most, max(n // rows_per_bucket, 4 * shuffle_partitions(df.sparkSession))))
