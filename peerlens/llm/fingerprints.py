"""Document fingerprints: a Merkle tree over sections, paragraphs and word runs, in DataFrame expressions only.

A text is cut into sections at blank lines, each section into paragraphs at line ends, each paragraph into leaves that
tile it: runs of four pieces (single pieces in paragraphs of up to SHORT code points), a piece being up to PIECE code points of a word
with the white space behind. So long paragraphs without spaces have many leaves as well. A leaf's node is the SHA-256 of its text;
a paragraph's node is that of its leaves' nodes, a section's that of its paragraphs' nodes, the root that of the sections'
nodes. Cutting is reversible, so two roots are equal if and only if the texts are; where nodes differ,
the branch leads to the edit. A fingerprint is the root and the first eight hex digits of each leaf; these give the likeness.

Defined results: a null text counts as empty; an empty text has a root and no leaves; two texts without
leaves are alike (1.0) if their roots are equal, else 0.0. Repeated rows each get their own result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MIN_LONG, bucket_count, bucket_of, order_bounds

PIECE = 16
SHORT = 64
_SPACE, _WORD = r"[ \t\x0B\f\r]", r"[^ \t\x0B\f\r]"
WORD = rf"{_SPACE}*{_WORD}{{1,{PIECE}}}{_SPACE}*|{_SPACE}+"
RUN = rf"{_SPACE}*(?:{_WORD}{{1,{PIECE}}}{_SPACE}*){{1,4}}|{_SPACE}+"


def _sha(c: Column) -> Column:
    return F.sha2(c, 256)


def _let(value: Column, use) -> Column:
    """use(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def leaf_nodes(text: Column) -> Column:
    """Nodes of the leaves, by section and paragraph: array<array<array<string>>>."""
    paragraph = lambda p: F.transform(
        F.when(F.length(p) <= SHORT, F.regexp_extract_all(p, F.lit(WORD), F.lit(0))).otherwise(F.regexp_extract_all(p, F.lit(RUN), F.lit(0))), _sha
    )
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), paragraph))


def tree(text: Column) -> Column:
    """struct<root, sections, leaves> of a text: the root, the sections' nodes and the marks of the leaves in order; null counts as empty."""

    def joined(nodes: Column) -> Column:
        return _sha(F.array_join(nodes, ""))

    def of_sections(nodes: Column, marks: Column) -> Column:
        return F.struct(joined(nodes).alias("root"), nodes.alias("sections"), marks.alias("leaves"))

    def of_leaves(found: Column) -> Column:
        marks = F.transform(F.flatten(F.flatten(found)), lambda x: F.substring(x, 1, 8))
        return _let(F.transform(found, lambda s: joined(F.transform(s, joined))), lambda nodes: of_sections(nodes, marks))

    return _let(leaf_nodes(F.coalesce(text, F.lit(""))), of_leaves)


def fingerprint(node: Column) -> Column:
    """The root and the leaves of tree() as one string; equal for equal texts only."""
    return F.concat(node["root"], F.lit(":"), F.array_join(node["leaves"], ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of the distinct leaves that two trees have in common (Dice), 1.0 for equal roots."""
    n = F.size(F.array_distinct(a["leaves"])) + F.size(F.array_distinct(b["leaves"]))
    both = F.size(F.array_intersect(a["leaves"], b["leaves"]))
    return F.when(a["root"] == b["root"], F.lit(1.0)).when(n == 0, F.lit(0.0)).otherwise(2.0 * both / n)


def differing_sections(a: Column, b: Column) -> Column:
    """0-based places of the sections whose nodes differ between two trees: the branches that hold an edit."""
    n = F.greatest(F.size(a["sections"]), F.size(b["sections"]))
    return F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: ~F.get(a["sections"], i).eqNullSafe(F.get(b["sections"], i)),
    )


def with_next(df: DataFrame, key: str, text: str, out: str = "next_text") -> DataFrame:
    """Adds the text of the next row by ascending (key, text), the first row's after the last.

    Rows are dealt to ranges of the key by quantiles; the first rows of a range are also placed behind
    the range before it, so that no window spans more than one range. Null keys come first.
    """
    rows = df.withColumn("_key", F.coalesce(F.col(key).cast("long"), F.lit(MIN_LONG)))
    bounds = order_bounds(rows, "_key", bucket_count(df))
    rows = rows.withColumn("_bucket", bucket_of(F.col("_key"), bounds))
    # at most one row for each range
    heads = rows.groupBy("_bucket").agg(F.min("_key").alias("_key"))
    everything = Window.orderBy("_bucket")
    behind = F.coalesce(F.lag("_bucket").over(everything), F.last("_bucket").over(everything.rowsBetween(0, Window.unboundedFollowing)))
    heads = heads.select("_key", behind.alias("_behind"))
    placed = rows.join(F.broadcast(heads), "_key", "left").withColumn(
        "_at",
        F.explode(
            F.when(
                F.col("_behind").isNotNull(),
                F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("again")), F.struct(F.col("_behind").alias("b"), F.lit(1).alias("again"))),
            ).otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("again"))))
        ),
    ).select(*df.columns, "_key", F.col("_at.b").alias("_range"), F.col("_at.again").alias("_again"))
    w = Window.partitionBy("_range").orderBy("_again", "_key", F.coalesce(F.col(text), F.lit("")))
    return placed.withColumn(out, F.lead(F.coalesce(F.col(text), F.lit(""))).over(w)).where("_again = 0").drop("_key", "_range", "_again")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form: the last quarter replaced by the start of the next document."""
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text")
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), F.substring(F.col("next_text"), F.lit(1), k))})
    rows = rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        tree(F.col("text")).alias("own"),
        tree(F.col("edited")).alias("after"),
        tree(F.col("next_text")).alias("following"),
    )
    own, after, following = F.col("own"), F.col("after"), F.col("following")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(own).alias("fingerprint"),
        fingerprint(after).alias("edited_fingerprint"),
        likeness(own, after).alias("near_edited"),
        likeness(own, following).alias("near_next"),
    )
