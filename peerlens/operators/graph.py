"""Entity graphs as node and edge tables: building, filters, neighbourhoods, sampling and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlens.functions import text as tx
from peerlens.sources.sinks import stored, write_document

HEAVY = ["FROM_SOURCE", "HAS_DATA_SOURCE"]


def node_id(kind: str, value: Column, most: int | None = None) -> Column:
    v = F.regexp_replace(F.trim(value), r"\s+", " ")
    return F.concat(F.lit(f"{kind.upper()}:"), F.left(v, F.lit(most)) if most else v)


def edges_of(df: DataFrame, source: Column, relation: str, target: Column, several: bool = False) -> DataFrame:
    """source, target, relation; with `several` the target is a list."""
    t = F.explode(target) if several else target
    return df.select(source.alias("source"), t.alias("target"), F.lit(relation).alias("relation")).where("source is not null and target is not null")


def distinct_edges(edges: list[DataFrame]) -> DataFrame:
    """Union of edge tables, one edge for each (source, target, relation)."""
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.distinct()


def nodes_of(declared: list[DataFrame], edges: DataFrame) -> DataFrame:
    """id, type, name: declared nodes, one for each id, and end points that nobody declared as type unknown."""
    out = declared[0]
    for n in declared[1:]:
        out = out.unionByName(n)
    out = out.groupBy("id").agg(F.min("type").alias("type"), F.min("name").alias("name"))
    ends = edges.select(F.col("source").alias("id")).union(edges.select(F.col("target").alias("id"))).distinct()
    implicit = ends.join(out, "id", "left_anti").select("id", F.lit("unknown").alias("type"), F.col("id").alias("name"))
    return out.unionByName(implicit)


def chain(df: DataFrame, node: str, order: list[str], relation: str = "FOLLOWED_BY") -> DataFrame:
    """Edges between neighbours in an order; for a small table of batches."""
    nxt = F.lead(node).over(Window.orderBy(*order))
    return df.select(F.col(node).alias("source"), nxt.alias("target"), F.lit(relation).alias("relation")).where("target is not null")


def without_types(nodes: DataFrame, edges: DataFrame, types: list[str], relations: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes not of some types, and the edges between them not of some relations."""
    kept = nodes.where(~F.col("type").isin(types)) if types else nodes
    left = edges.where(~F.col("relation").isin(relations)) if relations else edges
    ids = kept.select("id")
    left = left.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept, left


BROADCAST_NODES = 200_000  # reached nodes that are broadcast at most


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """seed, id, hops: nodes within some hops of the seeds (column `seed`), with the least number of hops.

    Each hop joins the nodes reached last to either end of the edges, so the edges are cut down before anything is made distinct.
    """
    found = reached = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("hops"))
    for h in range(1, hops + 1):
        side = F.broadcast(reached) if reached.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else reached
        out = edges.join(side.select("seed", F.col("id").alias("source")), "source").select("seed", F.col("target").alias("id"))
        back = edges.join(side.select("seed", F.col("id").alias("target")), "target").select("seed", F.col("source").alias("id"))
        reached = stored(out.unionByName(back).distinct().withColumn("hops", F.lit(h)), "reached")
        found = found.unionByName(reached)
    return found.groupBy("seed", "id").agg(F.min("hops").alias("hops"))


def systematic_sample(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """`most` rows at even steps through an order: row r of n is kept if the step changes there."""
    n = df.count()
    if n <= most:
        return df
    ranked = numbered(df, order)
    r = F.col("_r")
    return ranked.where(F.ceil(r * most / F.lit(n)) < F.ceil((r + 1) * most / F.lit(n))).drop("_r")


def numbered(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """Adds _r, the 0-based place in an order: ranges by quantiles of the first column (64, or one for a million rows up to 4,096), numbered within, with the counts before them."""
    first, parts = order[0], parts or min(4096, max(64, df.count() // 1_000_000))
    bounds = df.agg(F.percentile_approx(first, [i / parts for i in range(1, parts)]).alias("b")).first()["b"] or []
    table = F.array(*[F.lit(b) for b in sorted(set(bounds))]) if bounds else F.array().cast(f"array<{df.schema[first].dataType.simpleString()}>")
    rows = df.withColumn("_part", F.size(F.filter(table, lambda b: b <= F.col(first))))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_c"))  # at most `parts` rows
    before = counts.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_part").orderBy(*order)
    return rows.join(F.broadcast(before), "_part").withColumn("_r", F.row_number().over(w) - 1 + F.col("_before")).drop("_part", "_before")


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def bulk_nodes(nodes: DataFrame) -> DataFrame:
    """Rows for a property-graph bulk loader: `id:ID`, `:LABEL`, and all other columns by name as text, absent ones empty."""
    rest = sorted(c for c in nodes.columns if c not in ("id", "type"))
    return nodes.select(F.col("id").alias("id:ID"), F.upper(F.coalesce("type", F.lit("unknown"))).alias(":LABEL"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rest])


def bulk_edges(edges: DataFrame) -> DataFrame:
    """`:START_ID`, `:END_ID`, `:TYPE`, and all other columns by name."""
    rest = sorted(c for c in edges.columns if c not in ("source", "target", "relation"))
    return edges.select(F.col("source").alias(":START_ID"), F.col("target").alias(":END_ID"), F.col("relation").alias(":TYPE"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rest])


def write_bulk(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """CSV folders nodes/ and edges/ with headers."""
    bulk_nodes(nodes).write.mode("overwrite").csv(f"{path}/nodes", header=True)
    bulk_edges(edges).write.mode("overwrite").csv(f"{path}/edges", header=True)


def write_node_link(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """JSON lines of nodes and links, each in its folder."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/links")


def write_xml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """XML of nodes and edges, each in its folder."""
    nodes.withColumnsRenamed({"id": "_id", "name": "_label", "type": "_type"}).write.format("xml").mode("overwrite").option("rootTag", "nodes").option("rowTag", "node").save(f"{path}/nodes")
    edges.withColumnsRenamed({"source": "_source", "target": "_target", "relation": "_label"}).write.format("xml").mode("overwrite").option("rootTag", "edges").option("rowTag", "edge").save(f"{path}/edges")


def read_node_link(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one JSON document, under `edges` or `links`."""
    doc = spark.read.json(path, multiLine=True)
    links = [F.col(c) for c in ("edges", "links") if c in doc.columns]
    return doc.select(F.inline("nodes")), doc.select(F.inline(F.coalesce(*links)))


def resemblance_edges(matches: DataFrame, user: Column, company: Column, top: int = 15) -> DataFrame:
    """Edges from a query's node to its best matches; the relation tells the match's outcome, or a clone among the dead."""
    relation = (
        F.when(F.col("outcome") == "dead", F.when(F.col("convergence"), "RESEMBLES_DEAD_CLONE").otherwise("RESEMBLES_DEAD"))
        .when(F.col("outcome") == "acquired", "RESEMBLES_ACQUIRED")
        .when(F.col("outcome") == "operating", "RESEMBLES_OPERATING")
        .otherwise("RESEMBLES")
    )
    return matches.where(F.col("final_rank") <= top).select(user.alias("source"), company.alias("target"), relation.alias("relation"))


def integrated(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph with another merged in: known nodes keep what they have and fill what is absent, edges are distinct."""
    a, b = nodes.alias("a"), new_nodes.alias("b")
    joined = a.join(b, F.col("a.id") == F.col("b.id"), "full_outer")
    columns = [c for c in nodes.columns if c != "id"]
    merged = joined.select(F.coalesce("a.id", "b.id").alias("id"), *[F.coalesce(F.nullif(F.col(f"a.{c}"), F.lit("")), F.col(f"b.{c}")).alias(c) for c in columns])
    return merged, edges.unionByName(new_edges).distinct()


def section_graph(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of pages and their sections: page_id, section, heading."""
    page = F.concat(F.lit("PAGE:"), "page_id")
    own = F.concat(page, F.lit("#"), "section")
    nodes = sections.select(own.alias("id"), F.lit("section").alias("type"), F.col("heading").alias("name")).unionByName(sections.select(page.alias("id"), F.lit("page").alias("type"), page.alias("name")).distinct())
    return nodes, sections.select(page.alias("source"), own.alias("target"), F.lit("HAS_SECTION").alias("relation"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, key, n: nodes by type and edges by relation."""
    a = nodes.groupBy(F.col("type").alias("key")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "key", "n")
    return a.unionByName(edges.groupBy(F.col("relation").alias("key")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "key", "n"))


def write_node_link_document(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as one JSON document with `nodes` and `edges`, each in order and one a line; of any size."""
    def line(df: DataFrame, first: str) -> Column:
        rest = [c for c in df.columns if c != first]
        return F.to_json(F.struct(first, *rest), {"ignoreNullFields": "false"})

    head = '{"directed": true, "multigraph": false, "nodes": [\n'
    sections = [(head, nodes, ["id"], line(nodes, "id")), ('],\n"edges": [\n', edges, ["source", "target", "relation"], line(edges, "source"))]
    write_document(nodes.sparkSession, sections, "]}\n", path, ",")


def read_node_link_lines(spark, path: str, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, by the given schemas, of a document that write_node_link_document() wrote: its lines are read in parallel."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^,", "").alias("value"))
    a, b = lines.where(F.col("value").startswith('{"id":')), lines.where(F.col("value").startswith('{"source":'))
    return tuple(x.select(F.from_json("value", schema).alias("r")).select("r.*") for x, schema in ((a, nodes), (b, edges)))


def _escaped(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as one GEXF 1.2 document with types and relations as attributes, one element a line; of any size."""
    n = F.concat(F.lit('<node id="'), _escaped(F.col("id")), F.lit('" label="'), _escaped(F.coalesce("name", "id")), F.lit('"><attvalues><attvalue for="0" value="'), _escaped(F.coalesce("type", F.lit(""))), F.lit('"/></attvalues></node>'))
    e = F.concat(F.lit('<edge source="'), _escaped(F.col("source")), F.lit('" target="'), _escaped(F.col("target")), F.lit('" label="'), _escaped(F.col("relation")), F.lit('"/>'))
    head = '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="directed"><attributes class="node"><attribute id="0" title="type" type="string"/></attributes>\n<nodes>\n'
    sections = [(head, nodes.select("id", "type", "name"), ["id"], n), ("</nodes>\n<edges>\n", edges.select("source", "target", "relation"), ["source", "target", "relation"], e)]
    write_document(nodes.sparkSession, sections, "</edges></graph></gexf>\n", path)


def read_gexf(spark, path: str) -> tuple[DataFrame, DataFrame]:
    n = spark.read.format("xml").option("rowTag", "node").option("attributePrefix", "_").schema("_id string, _label string, attvalues struct<attvalue: struct<_value: string>>").load(path)
    e = spark.read.format("xml").option("rowTag", "edge").option("attributePrefix", "_").schema("_source string, _target string, _label string").load(path)
    return n.select(F.col("_id").alias("id"), F.col("attvalues.attvalue._value").alias("type"), F.col("_label").alias("name")), e.select(F.col("_source").alias("source"), F.col("_target").alias("target"), F.col("_label").alias("relation"))


def read_gexf_lines(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """read_gexf() of a document that write_gexf() wrote: its lines, one element each, are read in parallel, where the reader of XML takes a document as one task."""
    lines = spark.read.text(path)
    n, e = (lines.where(F.col("value").startswith(f"<{tag} ")).select(F.from_xml("value", schema, {"attributePrefix": "_"}).alias("r")) for tag, schema in (("node", "_id string, _label string, attvalues struct<attvalue: struct<_value: string>>"), ("edge", "_source string, _target string, _label string")))
    return n.select(F.col("r._id").alias("id"), F.col("r.attvalues.attvalue._value").alias("type"), F.col("r._label").alias("name")), e.select(F.col("r._source").alias("source"), F.col("r._target").alias("target"), F.col("r._label").alias("relation"))


def with_origin(edges: DataFrame, origin: str) -> DataFrame:
    """Edges with the name of the source that says so."""
    return edges.withColumn("origin", F.lit(origin))


def merged_edges(edges: list[DataFrame]) -> DataFrame:
    """One edge for each (source, target, relation), with the sorted origins that say so."""
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    # origins are few: one for each source
    return out.groupBy("source", "target", "relation").agg(F.array_sort(F.collect_set("origin")).alias("origins"))


def selected_nodes(nodes: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Nodes with one of the values."""
    return nodes.where(F.col(column).isin(values))


def selected_by_edges(nodes: DataFrame, edges: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Nodes at either end of edges with one of the values."""
    hit = edges.where(F.col(column).isin(values))
    ends = hit.select(F.col("source").alias("id")).union(hit.select(F.col("target").alias("id"))).distinct()
    return nodes.join(ends, "id", "left_semi")


def nodes_by_name(rows: DataFrame, name: str, nodes: DataFrame) -> DataFrame:
    """rows with `id` of the node whose compact name is theirs; of several nodes the greatest id."""
    key = tx.compact_key
    one = nodes.withColumn("_key", key(F.col("name"))).where("_key <> ''").groupBy("_key").agg(F.max("id").alias("id"))
    return rows.withColumn("_key", key(F.col(name))).join(one, "_key").drop("_key")


def concern_edges(queries: DataFrame, user: Column, most: int = 60) -> DataFrame:
    """Edges from a query's node to the nodes of its main and secondary concerns."""
    concerns = F.array_distinct(F.filter(F.concat(F.array(F.coalesce("main_concern", F.lit(""))), F.coalesce("secondary_concerns", F.array().cast("array<string>"))), lambda c: F.trim(c) != ""))
    rows = queries.select(user.alias("source"), F.explode(concerns).alias("c"))
    return rows.select("source", node_id("concern", F.col("c"), most).alias("target"), F.lit("CONCERNED_ABOUT").alias("relation"))


def section_tree_graph(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of nested sections (page_id, node, parent, heading): HAS_SECTION from the page, HAS_SUBSECTION from a section."""
    page = F.concat(F.lit("PAGE:"), "page_id")
    own, above = F.concat(page, F.lit("#"), "node"), F.concat(page, F.lit("#"), "parent")
    nodes = tree.select(own.alias("id"), F.lit("section").alias("type"), F.col("heading").alias("name")).unionByName(tree.select(page.alias("id"), F.lit("page").alias("type"), page.alias("name")).distinct())
    edges = tree.select(F.when(F.col("parent").isNull(), page).otherwise(above).alias("source"), own.alias("target"), F.when(F.col("parent").isNull(), "HAS_SECTION").otherwise("HAS_SUBSECTION").alias("relation"))
    return nodes, edges


def company_graph(companies: DataFrame, sections: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, name) and edges of companies as sources.company_page.companies() gives them.

    Statuses, categories, batches, places, people, acquirers, competitors, related companies, sections with content and build plans; a company
    that is only related is a node without a type. sections: column of a section -> its name. Batches are chained by batch_chain().
    """
    own = F.concat(F.lit("COMPANY:"), "slug")
    none = F.array().cast("array<string>")
    one = lambda c: F.array_compact(F.array(tx.absent(F.col(c))))
    several = lambda c: F.filter(F.coalesce(F.col(c), none), lambda x: tx.absent(x).isNotNull())

    def linked(values: Column, kind: str, out: str | None, back: str | None = None, name: Column | None = None, tail: Column | None = None) -> Column:
        """Entries (id, type, name, relation from and to the company) for an array of values."""
        def entry(v: Column) -> Column:
            label = kind.split(":")[0]
            there = F.concat(F.lit(f"{label}:"), v if tail is None else tail)
            return F.struct(there.alias("id"), F.lit(kind.split(":")[1]).alias("type"), (v if name is None else name).alias("name"), F.lit(out).alias("out"), F.lit(back).alias("back"))

        return F.transform(values, entry)

    parts = [
        linked(one("status"), "STATUS:status", "HAS_STATUS"),
        linked(several("categories"), "CATEGORY:category", "IN_CATEGORY"),
        linked(one("yc_batch"), "BATCH:yc_batch", "IN_BATCH"),
        linked(one("location"), "LOCATION:location", "LOCATED_IN"),
        linked(several("founders"), "PERSON:person", "HAS_FOUNDER", "FOUNDED"),
        linked(one("acquirer"), "ACQUIRER:acquirer", "ACQUIRED_BY", "ACQUIRED"),
        linked(several("competitors"), "COMPETITOR:competitor", "COMPETES_WITH"),
        linked(one("build_plan"), "BUILDPLAN:build_plan", "HAS_BUILD_PLAN", tail=F.col("slug")),
        *[linked(F.array_compact(F.array(F.when(tx.absent(F.col(f"{c}.content")).isNotNull(), F.lit(name)))), "SECTION:report_section", "HAS_SECTION", tail=F.concat("slug", F.lit(f":{name}"))) for c, name in sections.items()],
    ]
    rows = companies.select(own.alias("own"), F.explode(F.concat(*parts)).alias("e")).select("own", "e.*")
    related = companies.select(own.alias("source"), F.explode(several("related")).alias("r")).select("source", F.concat(F.lit("COMPANY:"), "r").alias("target"), F.lit("RELATED_TO").alias("relation"))
    out = rows.where("out is not null").select(F.col("own").alias("source"), F.col("id").alias("target"), F.col("out").alias("relation"))
    back = rows.where("back is not null").select(F.col("id").alias("source"), F.col("own").alias("target"), F.col("back").alias("relation"))
    edges = distinct_edges([out, back, related])
    declared = companies.select(own.alias("id"), F.lit("company").alias("type"), F.coalesce(tx.absent(F.col("name")), "slug").alias("name"))
    return nodes_of([declared, rows.select("id", "type", "name")], edges), edges


def batch_chain(batches: DataFrame) -> DataFrame:
    """Edges between batch nodes (name such as "Winter 2012") by year and season; batches are few."""
    form = r"(Winter|Summer|Spring|Fall)\s+(\d{4})"
    dated = batches.select(F.concat(F.lit("BATCH:"), "name").alias("id"), F.regexp_extract("name", form, 2).alias("year"), F.regexp_extract("name", form, 1).alias("season")).where("year <> ''").distinct()
    return chain(dated, "id", ["year", "season", "id"])
