"""Navigation graphs: nodes, edges, roots, paths, reach, recipes, gaps, frontier, text lines.

Paths are taken from operators/hierarchy.py, which needs no recursion over levels and tells cycles apart. Graphs are kept
per scope (session). Ties are settled by position, so each result is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import item_label
from ..session import checkpoint, hot_join

#: Titles that are symbols.
SYMBOLS = [">", "›", "<", "‹", "7", "L", "Q", "…", "-", "_"]


def nodes(screens: DataFrame, scope: str, fp: str, pos: str, *cols: str) -> DataFrame:
    """One row per fingerprint of a scope, the last by position (G1)."""
    return screens.where(F.col(fp).isNotNull()).groupBy(scope, fp).agg(F.max(F.struct(F.col(pos).alias("_p"), *cols)).alias("_r")).select(scope, fp, F.col("_r._p").alias(pos), *[F.col(f"_r.{c}").alias(c) for c in cols])


def edges(node_table: DataFrame, scope: str, fp: str, parent: str) -> DataFrame:
    """(scope, src, dst) for each node whose parent is neither null nor '' (G1, N15)."""
    return node_table.where(F.col(parent) != "").select(scope, F.col(parent).alias("src"), F.col(fp).alias("dst"))


def inner_edges(edge_table: DataFrame, node_table: DataFrame, scope: str, fp: str) -> DataFrame:
    """Edges whose ends are both nodes (U4)."""
    keys = node_table.select(scope, fp)
    return edge_table.join(keys.withColumnRenamed(fp, "src"), [scope, "src"], "left_semi").join(keys.withColumnRenamed(fp, "dst"), [scope, "dst"], "left_semi")


def roots(node_table: DataFrame, edge_table: DataFrame, scope: str, fp: str) -> DataFrame:
    """Nodes that no edge leads to."""
    return node_table.join(edge_table.select(scope, F.col("dst").alias(fp)), [scope, fp], "left_anti")


def first_root(node_table: DataFrame, scope: str, fp: str, parent: str, pos: str) -> DataFrame:
    """The first node of each scope without a parent (G5); only null counts as none."""
    return node_table.where(F.col(parent).isNull()).groupBy(scope).agg(F.min_by(fp, F.struct(pos, fp)).alias("root"))


def title_chain(placed: DataFrame, titles: DataFrame) -> DataFrame:
    """(scope, node, chain): array of the titles from the root down to each node of a tree (G6). placed: of hierarchy();
    titles: one row per scope and node; a null title reads as ''."""
    steps = placed.where("path is not null").select("scope", "node", F.posexplode("path").alias("at", "step"))
    named = hot_join(steps, titles.select("scope", F.col("node").alias("step"), F.coalesce("title", F.lit("")).alias("title")), ["scope", "step"])
    return named.groupBy("scope", "node").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "title"))), lambda x: x["title"]).alias("chain"))


def children(edge_table: DataFrame, node_table: DataFrame, scope: str, fp: str, pos: str) -> DataFrame:
    """(scope, src, children): children in order of position."""
    at = edge_table.join(node_table.select(scope, F.col(fp).alias("dst"), pos), [scope, "dst"])
    return at.groupBy(scope, "src").agg(F.transform(F.sort_array(F.collect_list(F.struct(pos, "dst"))), lambda x: x["dst"]).alias("children"))


def tap_map(log: DataFrame, scope: str, parent: str, text: str, child: str, seq: str) -> DataFrame:
    """Child that a tap on a text of a screen led to last."""
    return log.where(F.col(parent).isNotNull() & F.col(text).isNotNull()).groupBy(scope, parent, text).agg(F.max_by(child, F.struct(seq, child)).alias(child), F.max(seq).alias(seq))


def recipes(placed: DataFrame, taps: DataFrame, items: DataFrame) -> DataFrame:
    """(scope, node, recipe): texts to tap from the root to each node; null if a step is missing.

    taps: scope, parent, text, child, seq (the first tap of a step counts); items: scope, node, text.
    """
    step = taps.groupBy("scope", "parent", "child").agg(F.min_by("text", F.struct("seq", "text")).alias("text"))
    usable = step.join(items.select("scope", F.col("node").alias("parent"), "text").distinct(), ["scope", "parent", "text"], "left_semi")
    path = F.col("path")
    pairs = placed.where("depth > 0").select("scope", "node", "depth", F.posexplode(F.zip_with(F.slice(path, F.lit(1), F.size(path) - 1), F.slice(path, F.lit(2), F.size(path) - 1), lambda a, b: F.struct(a.alias("parent"), b.alias("child")))).alias("at", "e"))
    found = pairs.select("scope", "node", "depth", "at", "e.parent", "e.child").join(usable, ["scope", "parent", "child"], "left")
    return found.groupBy("scope", "node").agg(F.when(F.count("text") == F.max("depth"), F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])).alias("recipe"))


def gaps(title: Column, n_items: Column) -> Column:
    """Kinds of gaps of a screen: unknown or suspicious title, nothing to tap."""
    odd = (F.length(title) <= 1) | F.trim(title).isin(SYMBOLS)
    return F.filter(F.array(F.when(title == "unknown", "unknown_screen").when(odd, "suspicious_title"), F.when(n_items == 0, "untapped_screen")), lambda x: x.isNotNull())


def frontier(screens: DataFrame, depth: str, n_items: str, max_depth: int) -> DataFrame:
    """Screens at the last level or beyond that still have something to tap."""
    return screens.where((F.col(depth) >= max_depth - 1) & (F.col(n_items) > 0))


def reach(edge_table: DataFrame, starts: DataFrame, scope: str, max_depth: int) -> DataFrame:
    """(scope, node, level): nodes within max_depth steps of the starts (scope, node), by levels (G15, G16). One join and
    one written step a level; max_depth bounds the levels."""
    links = edge_table.select(scope, F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    found = checkpoint(starts.select(scope, "node").distinct().withColumn("level", F.lit(0)))
    front = found
    for level in range(1, max_depth + 1):
        step = front.join(links, [scope, "node"]).select(scope, F.col("next").alias("node")).distinct()
        front = checkpoint(step.join(found.select(scope, "node"), [scope, "node"], "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def neighbours(edge_table: DataFrame, scope: str) -> DataFrame:
    """(scope, node, role, other): parents and children of each node."""
    down = edge_table.select(scope, F.col("src").alias("node"), F.lit("child").alias("role"), F.col("dst").alias("other"))
    return down.unionByName(edge_table.select(scope, F.col("dst").alias("node"), F.lit("parent").alias("role"), F.col("src").alias("other"))).distinct()


def mermaid_lines(node_table: DataFrame, edge_table: DataFrame, scope: str, fp: str, pos: str) -> DataFrame:
    """(scope, line_no, line): Mermaid text of each scope's graph (G7). node_table: title, depth, n_items."""
    w = Window.partitionBy(scope).orderBy(pos, fp)
    named = node_table.withColumn("n", F.row_number().over(w) - 1)
    title = F.when(F.col("title") == "unknown", "❓unknown").otherwise(F.col("title"))
    head = named.select(scope).distinct().select(scope, F.lit(0).alias("part"), F.lit(0).alias("n"), F.lit(0).alias("m"), F.lit("graph TD").alias("line"))
    body = named.select(scope, F.lit(1).alias("part"), "n", F.lit(0).alias("m"), F.concat(F.lit("    n"), "n", F.lit('["'), title, F.lit(" (d="), "depth", F.lit(") | "), item_label(F.col("n_items")), F.lit('"]')).alias("line"))
    ids = named.select(scope, fp, "n")
    arrows = edge_table.join(ids.select(scope, F.col(fp).alias("src"), F.col("n").alias("a")), [scope, "src"]).join(ids.select(scope, F.col(fp).alias("dst"), F.col("n").alias("b")), [scope, "dst"])
    links = arrows.select(scope, F.lit(2).alias("part"), F.col("b").alias("n"), F.col("a").alias("m"), F.concat(F.lit("    n"), "a", F.lit(" --> n"), "b").alias("line"))
    style = named.where("title = 'unknown'").select(scope, F.lit(3).alias("part"), "n", F.lit(0).alias("m"), F.concat(F.lit("    style n"), "n", F.lit(" fill:#ffcccc")).alias("line"))
    lines = head.unionByName(body).unionByName(links).unionByName(style)
    return lines.select(scope, F.row_number().over(Window.partitionBy(scope).orderBy("part", "n", "m", "line")).alias("line_no"), "line")


def tree_lines(placed: DataFrame, shown: DataFrame) -> DataFrame:
    """(scope, line_no, line): the trees of each scope in pre-order, indented by depth (G8-G10). placed: of hierarchy();
    shown: scope, node, pos, title, n_items. Nodes on or below a cycle are no part of a tree."""
    t = placed.where("path is not null").select("scope", "node", "depth", "path").join(shown, ["scope", "node"])
    steps = t.select("scope", "node", F.posexplode("path").alias("at", "step"))
    keys = hot_join(steps, shown.select("scope", F.col("node").alias("step"), "pos"), ["scope", "step"]).groupBy("scope", "node").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "pos"))), lambda x: x["pos"]).alias("key"))
    title = F.when(F.col("title") == "unknown", "❓ unknown").otherwise(F.coalesce("title", F.lit("")))
    warn = F.when(F.col("title") == "unknown", "  ← unknown").when((F.col("n_items") <= 1) & (F.col("depth") > 0), "  ⚠ few items").otherwise("")
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), title, F.lit(" [depth="), F.col("depth"), F.lit("] ("), item_label(F.col("n_items")), F.lit(")"), warn)
    lines = t.join(keys, ["scope", "node"]).withColumn("line", line)
    return lines.select("scope", F.row_number().over(Window.partitionBy("scope").orderBy("key", "node")).alias("line_no"), "line")
