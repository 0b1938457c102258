"""Sinks: corpus files, raw reports, evaluation reports, and single documents of any size. Graphs are written by operators.graph."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for files that are read back."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, for tables that several branches of a plan read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys over twice as many tasks as there are cores: for rows of few bytes that mean much work, which would come as one partition."""
    return df.repartition(max(8, 2 * df.sparkSession.sparkContext.defaultParallelism), *keys)


def file_system(spark: SparkSession, path: str):
    """The file system of a path, without checksum files where it is a local one, and its Path class."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    fs = kind(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        return fs.getRawFileSystem(), kind
    except Py4JError:  # no such method: not a local file system
        return fs, kind


def remove(spark: SparkSession, path: str) -> None:
    """A scratch folder that nothing reads any more."""
    fs, at = file_system(spark, path)
    fs.delete(at(path), True)


def write_small(fs, path, text: str) -> None:
    """A new file of a few bytes, written by the driver."""
    out = fs.create(path, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def append_and_remove(spark: SparkSession, fs, whole, files: list) -> None:
    """Files copied behind each other into a new one, each removed once it is copied."""
    out = fs.create(whole, False)
    try:
        for f in files:
            part = fs.open(f)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
            fs.delete(f, False)
    finally:
        out.close()


def write_document(spark: SparkSession, sections: list[tuple[str, DataFrame, list[str], Column]], end: str, path: str, between: str = "") -> str:
    """One file below path from sections (head, rows, order, line of a row), whatever their size, and its path.

    Rows of a section are dealt to ranges of the order and written in parallel, one a line; `between` stands between any two of them. The parts, with
    the heads, separators and end as small files, are then put in a row by the file system's own concatenation, so no task and not the driver
    holds a document. A file system without it raises an error and leaves the ordered parts where they are. Local ones, whose concatenation copies, get
    part after part, each removed once it is copied, so that a document is not there twice.
    """
    fs, at = file_system(spark, path)
    root = at(path)
    fs.delete(root, True)
    fs.mkdirs(root)
    files, n = [], 0

    def small(text: str) -> None:
        nonlocal n
        files.append(at(root, f"_small-{n:06d}"))
        n += 1
        write_small(fs, files[-1], text)

    for k, (head, rows, order, line) in enumerate(sections):
        small(head)
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its partition
        ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)  # lines are made behind it: they are longer than their rows
        folder = f"{path}/_section-{k}"
        ranged.select(F.concat(F.when(first, "").otherwise(between), line).alias("value")).write.text(folder)
        parts = sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(at(folder)))
        full = [at(folder, name) for name, size in parts if size and name.startswith("part-")]
        for i, part in enumerate(full):
            if i and between:
                small(between)
            files.append(part)
    small(end)
    whole = at(root, "document")
    if fs.getUri().getScheme() == "file":
        append_and_remove(spark, fs, whole, files)
    else:
        write_small(fs, whole, "\n")  # some file systems want a target that isn't empty
        array = spark._sc._gateway.new_array(at, len(files) + 1)
        array[0] = at(root, "_begin")
        write_small(fs, array[0], "\n")
        for i, f in enumerate(files):
            array[i + 1] = f
        fs.concat(whole, array)
    for s in fs.listStatus(root):
        if s.getPath().getName().startswith("_"):
            fs.delete(s.getPath(), True)
    return f"{path}/document"


def write_corpus(records: DataFrame, path: str) -> None:
    """Canonical records as JSON lines; absent fields are left out. The write is committed as a whole or not at all."""
    records.write.mode("overwrite").json(path)


def write_raw(reports: DataFrame, path: str, without: tuple[str, ...] = ("meta_tags",)) -> None:
    """Raw reports as JSON lines without the columns that only the parser needs."""
    reports.drop(*without).write.mode("overwrite").json(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Derived tables (enriched corpus, analytics, centroids, vectors) as Parquet, a folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def fresh_vectors(corpus: DataFrame, vectors: DataFrame, key: str = "norm", text: str = "text", mark: str = "text_hash") -> tuple[DataFrame, DataFrame]:
    """Stored vectors that are still valid, and the rows that need a new one: a vector belongs to the hash of the text it was made of."""
    now = corpus.withColumn(mark, F.xxhash64(text))
    met = [key, mark]
    return vectors.join(now.select(*met), met, "left_semi"), now.join(vectors.select(*met), met, "left_anti")
