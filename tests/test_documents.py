"""Documents put together from parts, and tables whose versions are committed as a whole."""

import json
import threading
import xml.etree.ElementTree as ET

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from peerlens.operators import graph
from peerlens.sources import sinks, versions

NODES, EDGES = "id string, type string, name string", "source string, target string, relation string"


def make(spark, n):
    nodes = spark.createDataFrame([(f"n{i:04d}", "t" if i % 2 else None, f'say "{i}" <&>\n, é') for i in range(n)], NODES).repartition(5)
    edges = spark.createDataFrame([(f"n{i:04d}", f"n{i * 7 % max(n, 1):04d}", "R&D") for i in range(n)] * 2, EDGES).repartition(3)
    return nodes, edges


@pytest.mark.parametrize("n", [0, 1, 300])
def test_one_json_document(spark, tmp_path, n):
    nodes, edges = make(spark, n)
    graph.write_node_link_document(nodes, edges, str(tmp_path / "g"))
    assert [p.name for p in (tmp_path / "g").iterdir()] == ["document"]
    whole = json.loads((tmp_path / "g" / "document").read_text())
    assert whole["directed"] is True and [x["id"] for x in whole["nodes"]] == [f"n{i:04d}" for i in range(n)] and len(whole["edges"]) == 2 * n
    a, b = graph.read_node_link_lines(spark, str(tmp_path / "g"), NODES, EDGES)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, nodes.collect())) and sorted(b.collect()) == sorted(edges.collect())
    if n:
        a, b = graph.read_node_link(spark, str(tmp_path / "g"))
        assert a.count() == n and b.count() == 2 * n


@pytest.mark.parametrize("n", [0, 200])
def test_one_gexf_document(spark, tmp_path, n):
    nodes, edges = make(spark, n)
    graph.write_gexf(nodes, edges, str(tmp_path / "g"))
    root = ET.parse(tmp_path / "g" / "document").getroot()
    space = "{http://www.gexf.net/1.2draft}"
    assert [x.get("label") for x in root.iter(f"{space}node")] == [f'say "{i}" <&>\n, é' for i in range(n)] and len(list(root.iter(f"{space}edge"))) == 2 * n
    a, b = graph.read_gexf(spark, str(tmp_path / "g"))
    assert a.count() == n and sorted(b.collect()) == sorted(edges.collect())


def test_a_document_is_never_there_twice(spark, tmp_path, monkeypatch):
    nodes, edges = make(spark, 300)
    sizes, whole = [], sinks.append_and_remove

    def size():
        return sum(p.stat().st_size for p in (tmp_path / "g").rglob("*") if p.is_file() and not p.name.endswith(".crc"))

    class Watched:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            sizes.append(size())
            return getattr(self.fs, name)

    monkeypatch.setattr(sinks, "append_and_remove", lambda spark, fs, *rest: whole(spark, Watched(fs), *rest))
    graph.write_node_link_document(nodes, edges, str(tmp_path / "g"))
    largest = max(p.stat().st_size for p in (tmp_path / "g").iterdir())
    assert len(sizes) > 10 and max(sizes) < 1.7 * largest


def test_graph_documents_leave_no_document(spark):
    from pathlib import Path

    from peerlens.plans import source_queries

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    found = source_queries.graph_documents(spark, "/root/testdata/sf0.001")
    assert found.count() > 0 and not list(shared.glob("graph-*/document"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions_are_whole_or_absent(spark, tmp_path):
    t = versions.VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        t.read()
    one = spark.createDataFrame([(1, "a"), (2, "")], "k int, v string")
    assert t.versions() == [] and t.commit(one) == 1
    broken = spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string").withColumn("v", F.when(F.col("k") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(PySparkException):
        t.upsert(broken, "k", {})
    assert t.versions() == [1] and rows(t.read()) == [(1, "a"), (2, "")]
    assert t.upsert(spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string"), "k", {}) == 2
    assert rows(t.read()) == [(1, "a"), (2, "b"), (3, "c")] and rows(t.read(1)) == [(1, "a"), (2, "")]
    assert t.commit(spark.createDataFrame([(9, "z")], "k int, v string"), append=True) == 3 and t.read().count() == 4
    t.vacuum(keep=1)
    assert t.versions() == [3] and t.read().count() == 4
    with pytest.raises(ValueError):
        t.read(1)


def test_of_two_writers_one_commits(spark, tmp_path):
    t = versions.VersionedTable(spark, str(tmp_path / "t"))
    one = lambda k: spark.createDataFrame([(k,)], "k int")
    t.commit(one(0))
    assert t.commit(one(1), after=1) == 2
    with pytest.raises(versions.Conflict):
        t.commit(one(2), after=1)
    assert rows(t.read()) == [(1,)] and len(list((tmp_path / "t" / "data").iterdir())) == 2
    meanwhile = iter([True, False, False])

    def add(old):
        if next(meanwhile):
            t.commit(one(5), append=True)  # another writer comes first
        return old.unionByName(one(7))

    assert t.change(add) == 4 and rows(t.read()) == [(1,), (5,), (7,)]
    threads = [threading.Thread(target=lambda k=k: t.change(lambda old: old.unionByName(one(k)), 10)) for k in (10, 11, 12)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert rows(t.read()) == [(1,), (5,), (7,), (10,), (11,), (12,)]


def test_lines_of_gexf_are_read_in_parallel(spark, tmp_path):
    edges = spark.createDataFrame([(f"a {i}", 'b & \n\t<"é">' + str(i), "R") for i in range(300)], "source string, target string, relation string")
    nodes = edges.select(F.col("target").alias("id"), F.when(F.col("source") != "a 3", "t").alias("type"), F.col("source").alias("name"))
    graph.write_gexf(nodes, edges, str(tmp_path / "g"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        found, whole = graph.read_gexf_lines(spark, str(tmp_path / "g/document")), graph.read_gexf(spark, str(tmp_path / "g/document"))
        assert all(x.rdd.getNumPartitions() > 2 for x in found)
        assert all(x.count() == 300 and x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty() for x, y in zip(found, whole, strict=True))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
