"""Parent-child links to full hierarchies, by leaf peeling.

Nodes belong to scopes (here: sessions) and links never leave their scope. Within a scope leaves are peeled bottom-up:
each peeled leaf hands its subtree size to its parent. In reverse peel order every node then takes root, depth and path
from its parent. What can't be peeled lies on a cycle; such nodes are met again from the far end of the peel order, so
peeled nodes below a cycle are told apart too.

Scopes of up to `local_nodes` nodes are peeled whole, many scopes to a task, as array operations over all of them at
once. Larger scopes are peeled by joins until what is left of them fits: each round peels all leaves and takes every
node out of its chain that has one child and comes before its neighbours in a pseudorandom order, its child inheriting
its link; so the number of rounds grows with the logarithm of the nodes, not with the depth, and a loop shrinks to a
node that is its own parent. The reverse order puts the nodes back one round after another. A link knows how many steps
and which nodes it stands for. The results are the same whatever local_nodes is.

Paths are arrays of keys, so keys may hold any character. Rows with a null scope or key are no nodes. A parent that is
null, '' or no node of the scope makes a root. Repeated keys are one node, the row with the smallest row id; ties of
that id, too, by parent and depth. An empty table has no nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, hot_join

#: status of a node: in a tree, on a cycle, below a cycle.
TREE, CYCLE, BELOW = "tree", "cycle", "below_cycle"
#: Columns of the placed nodes.
PLACED = "scope string, node string, parent string, stored_depth int, linked boolean, status string, root string, root_linked boolean, depth int, path array<string>, n_descendants long"
COLUMNS = [c.split()[0] for c in PLACED.split(", ")]


def nodes(df: DataFrame, scope: str, node: str, parent: str, depth: str, row_id: str) -> DataFrame:
    """(scope, node, parent, stored_depth, linked): one row per node; linked: its parent is neither null nor ''."""
    first = df.where(F.col(scope).isNotNull() & F.col(node).isNotNull()).groupBy(F.col(scope).alias("scope"), F.col(node).alias("node")).agg(F.min(F.struct(F.col(row_id).alias("a"), F.col(parent).alias("parent"), F.col(depth).cast("int").alias("stored_depth"))).alias("r"))
    return first.select("scope", "node", F.nullif("r.parent", F.lit("")).alias("parent"), "r.stored_depth").withColumn("linked", F.col("parent").isNotNull())


def peel(parent: np.ndarray, weight: np.ndarray | None = None, between: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """parent: index of each node's parent or -1; weight: nodes that a node stands for (1); between: nodes that its link
    stands for (0). Returns the peeled levels, leaves first, subtree sizes with the node itself, and whether a node was
    peeled."""
    n = len(parent)
    size = np.ones(n, np.int64) if weight is None else weight.astype(np.int64)
    link = np.zeros(n, np.int64) if between is None else between
    children = np.bincount(parent[parent >= 0], minlength=n)
    peeled, levels = np.zeros(n, bool), []
    level = np.flatnonzero(children == 0)
    while len(level):
        levels.append(level)
        peeled[level] = True
        up = parent[level]
        sends = up >= 0
        np.add.at(size, up[sends], size[level[sends]] + link[level[sends]])
        np.subtract.at(children, up[sends], 1)
        up = np.unique(up[sends])
        level = up[children[up] == 0]
    return levels, size, peeled


def place(parent: np.ndarray, levels: list[np.ndarray], peeled: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Status, index of the root (-1: none) and depth, in reverse peel order: parents come before their children."""
    n = len(parent)
    root, depth = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    status = np.where(peeled, BELOW, CYCLE).astype(object)
    for level in reversed(levels):
        above = parent[level]
        tops = level[above < 0]
        root[tops], depth[tops], status[tops] = tops, 0, TREE
        rest, above = level[above >= 0], above[above >= 0]
        inside = root[above] >= 0
        rest, above = rest[inside], above[inside]
        root[rest], depth[rest], status[rest] = root[above], depth[above] + steps[rest], TREE
    return status, root, depth


def paths(parent: np.ndarray, depth: np.ndarray, part: np.ndarray, names_at: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and places of names of the paths of the nodes `part`, all in trees. names_at: where the names of a node's
    link and its own begin; there are `steps` of them."""
    offsets = np.concatenate([[0], np.cumsum(depth[part] + 1)])
    values = np.zeros(offsets[-1], np.int64)
    at, end = part, offsets[1:].copy()
    while len(at):
        n = steps[at]
        begin = end - n
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        values[np.repeat(begin, n) + k] = np.repeat(names_at[at], n) + k
        on = parent[at] >= 0
        at, end = parent[at][on], begin[on]
    return offsets, values


#: Rows of whole scopes that a task peels at once, and names in the paths of a batch; with local_nodes they bound what a task holds.
CHUNK, NAMES = 100_000, 2_000_000
_ARROW = pa.schema([("scope", pa.string()), ("node", pa.string()), ("parent", pa.string()), ("stored_depth", pa.int32()), ("linked", pa.bool_()), ("status", pa.string()), ("root", pa.string()), ("root_linked", pa.bool_()), ("depth", pa.int32()), ("path", pa.list_(pa.string())), ("n_descendants", pa.int64())])


def _peeled(t: pa.Table, with_paths: bool) -> Iterator[pa.RecordBatch]:
    n = t.num_rows
    node = t.column("node").combine_chunks()
    keys = pd.MultiIndex.from_arrays([t.column("scope").to_pandas(), node.to_pandas()])
    parent = pd.Series(np.arange(n), index=keys).reindex(pd.MultiIndex.from_arrays([t.column("scope").to_pandas(), t.column("parent").to_pandas()])).fillna(-1).to_numpy(np.int64)
    weight, between, steps = (t.column(c).to_numpy() for c in ("weight", "between", "steps"))
    levels, size, peeled = peel(parent, weight, between)
    status, root, depth = place(parent, levels, peeled, steps)
    via = t.column("via").combine_chunks()
    lengths = via.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    # all names: of each node those of its link, then its own
    names_at = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    order = np.empty(n + int(lengths.sum()), np.int64)
    order[names_at + lengths] = np.arange(n)
    inner = np.ones(len(order), bool)
    inner[names_at + lengths] = False
    order[inner] = n + np.arange(int(lengths.sum()))
    names = pa.concat_arrays([node.cast(pa.string()), via.flatten().cast(pa.string())]).take(pa.array(order))
    in_tree = root >= 0
    own = np.where(in_tree, lengths + 1, 0)
    ends = np.cumsum(np.where(in_tree, depth + 1, 0)) if with_paths else np.zeros(n)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(NAMES, ends[-1] if n else 0, NAMES)) + 1, [n]])) if with_paths else np.array([0, n])
    for a, b in zip(cuts[:-1], np.minimum(cuts[1:], n)):
        rows = np.arange(a, b)
        tree = in_tree[rows]
        path = pa.nulls(len(rows), pa.list_(pa.string()))
        if with_paths:
            offsets, values = paths(parent, depth, rows[tree], names_at, own)
            full = np.zeros(len(rows) + 1, np.int32)
            full[1:][tree] = np.diff(offsets)
            path = pa.ListArray.from_arrays(pa.array(np.cumsum(full, dtype=np.int32)), names.take(pa.array(values)), mask=pa.array(~tree))
        mine = [t.column(c).combine_chunks().slice(a, b - a).cast(_ARROW.field(c).type) for c in _ARROW.names[:5]]
        top = pa.array(root[rows], mask=~tree)
        yield pa.RecordBatch.from_arrays([
            *mine, pa.array(status[rows], pa.string()), node.cast(pa.string()).take(top), t.column("linked").combine_chunks().take(top),
            pa.array(depth[rows].astype(np.int32), mask=~tree), path, pa.array(size[rows] - 1, mask=~tree),
        ], schema=_ARROW)


def _local(with_paths: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by scope; whole scopes are peeled as soon as CHUNK rows are there."""
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                t = pa.Table.from_batches(held)
                scope = t.column("scope").to_numpy(zero_copy_only=False)
                cut = int(np.argmax(scope == scope[-1]))
                if cut:
                    yield from _peeled(t.slice(0, cut), with_paths)
                    held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if rows:
            yield from _peeled(pa.Table.from_batches(held), with_paths)

    return run


def _whole(links: DataFrame, with_paths: bool) -> DataFrame:
    """Placed nodes of scopes that each fit a task."""
    return links.repartition("scope").sortWithinPartitions("scope").mapInArrow(_local(with_paths), PLACED)


def _linked(tree: DataFrame) -> DataFrame:
    none = F.expr("cast(array() as array<string>)")
    """What a link stands for: nodes and steps to the parent, and the names between."""
    return tree.select("scope", "node", "parent", "stored_depth", "linked", F.lit(1).cast("long").alias("weight"), F.lit(0).cast("long").alias("between"), F.lit(1).alias("steps"), none.alias("via"))


def _with_kids(links: DataFrame) -> DataFrame:
    kids = links.where("parent is not null").groupBy("scope", F.col("parent").alias("node")).agg(F.count("*").alias("n_kids"), F.min("node").alias("kid"))
    return links.join(kids, ["scope", "node"], "left")


def _contracted(links: DataFrame, local_nodes: int, with_paths: bool) -> DataFrame:
    """Placed nodes of scopes of any size."""
    keys = links.select("scope", F.col("node").alias("parent"), F.lit(True).alias("known"))
    links = checkpoint(hot_join(links, keys, ["scope", "parent"], "left").withColumn("parent", F.when(F.col("known"), F.col("parent"))).select(links.columns))
    parts: list[DataFrame] = []  # placed already: roots and loops that nothing hangs on
    steps: list[tuple[DataFrame, DataFrame]] = []  # leaves and nodes taken out of chains, by rounds
    own = F.array("node")
    rounds = 0
    while (links.groupBy("scope").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > local_nodes:
        a = checkpoint(_with_kids(links))
        leaf, top = F.col("n_kids").isNull(), F.col("parent").isNull()
        loop = F.coalesce((F.col("parent") == F.col("node")) & (F.col("n_kids") == 1), F.lit(False))
        none = F.lit(None)
        parts.append(a.where(leaf & top).select("scope", "node", F.lit(TREE).alias("status"), F.col("node").alias("root"), F.lit(0).alias("depth"), (own if with_paths else none.cast("array<string>")).alias("path"), F.col("weight").alias("size")))
        parts.append(a.where(loop).select("scope", "node", F.lit(CYCLE).alias("status"), none.cast("string").alias("root"), none.cast("int").alias("depth"), none.cast("array<string>").alias("path"), none.cast("long").alias("size")))
        leaves = a.where(leaf & ~top).select(links.columns)
        sums = leaves.groupBy("scope", F.col("parent").alias("node")).agg(F.sum(F.col("weight") + F.col("between")).alias("_sent"))
        rest = a.where(~leaf & ~loop).select(links.columns).join(sums, ["scope", "node"], "left").withColumn("weight", F.col("weight") + F.coalesce("_sent", F.lit(0))).select(links.columns)
        chain = (F.col("n_kids") == 1) & F.col("parent").isNotNull() & (F.col("parent") != F.col("node"))
        rest = checkpoint(_with_kids(rest).withColumn("order", F.when(chain, F.xxhash64(F.lit(rounds), "scope", "node"))))
        inside = rest.where("order is not null")
        up, down = inside.select("scope", F.col("node").alias("parent"), F.col("order").alias("_up")), inside.select("scope", F.col("node").alias("kid"), F.col("order").alias("_down"))
        least = hot_join(inside, up, ["scope", "parent"], "left").join(down, ["scope", "kid"], "left").where("(_up is null or order < _up) and (_down is null or order < _down)")
        child = rest.select("scope", F.col("node").alias("kid"), F.col("between").alias("kid_between"))
        cut = checkpoint(least.join(child, ["scope", "kid"]).select(*links.columns, "kid", "kid_between"))
        heir = cut.select("scope", F.col("kid").alias("node"), F.struct("node", "parent", "weight", "between", "steps", "via").alias("c"))
        took = F.col("c").isNotNull()
        kept = rest.select(links.columns).join(cut.select("scope", "node"), ["scope", "node"], "left_anti").join(heir, ["scope", "node"], "left")
        links = checkpoint(kept.select(
            "scope", "node", F.when(took, F.col("c.parent")).otherwise(F.col("parent")).alias("parent"), "weight", (F.col("between") + F.when(took, F.col("c.weight") + F.col("c.between")).otherwise(0)).alias("between"),
            (F.col("steps") + F.coalesce("c.steps", F.lit(0))).alias("steps"), F.when(took, F.concat("c.via", F.array("c.node"), "via")).otherwise(F.col("via")).alias("via") if with_paths else F.col("via"),
        ))
        steps.append((leaves, cut))
        rounds += 1
    rest = _whole(links.withColumns({"stored_depth": F.lit(None).cast("int"), "linked": F.lit(None).cast("boolean")}), with_paths)
    parts.append(checkpoint(rest.select("scope", "node", "status", "root", "depth", "path", (F.col("n_descendants") + 1).alias("size"))))

    def below(rows: DataFrame, kid: bool) -> DataFrame:
        placed = parts[0]
        for p in parts[1:]:
            placed = placed.unionByName(p)
        over = placed.select("scope", F.col("node").alias("parent"), F.col("status").alias("p_status"), F.col("root").alias("p_root"), F.col("depth").alias("p_depth"), F.col("path").alias("p_path"))
        rows = hot_join(rows, over, ["scope", "parent"])
        if kid:
            rows = rows.join(placed.select("scope", F.col("node").alias("kid"), F.col("status").alias("k_status"), F.col("size").alias("k_size")), ["scope", "kid"])
        on_cycle = F.col("k_status") == CYCLE if kid else F.lit(False)
        tree = F.col("p_status") == TREE
        size = F.col("weight") + (F.col("kid_between") + F.col("k_size") if kid else F.lit(0))
        path = F.concat("p_path", "via", own) if with_paths else F.lit(None).cast("array<string>")
        return checkpoint(rows.select("scope", "node", F.when(on_cycle, CYCLE).when(tree, TREE).otherwise(BELOW).alias("status"), F.when(tree, F.col("p_root")).alias("root"), F.when(tree, F.col("p_depth") + F.col("steps")).cast("int").alias("depth"), F.when(tree, path).alias("path"), F.when(tree, size).alias("size")))

    for leaves, cut in reversed(steps):  # within a round leaves went first, so they come back last
        parts.append(below(cut, True))
        parts.append(below(leaves, False))
    placed = parts[0]
    for p in parts[1:]:
        placed = placed.unionByName(p)
    return placed


def hierarchy(tree: DataFrame, local_nodes: int = 200_000, with_paths: bool = True) -> DataFrame:
    """(scope, node, parent, stored_depth, linked, status, root, root_linked, depth, path, n_descendants) of every node
    that nodes() gives.

    Root, depth, path and number of descendants are null on and below cycles. The paths of a scope hold as many keys as
    its nodes have ancestors; with_paths=False leaves them null.
    """
    large = tree.groupBy("scope").agg(F.count("*").alias("_n")).where(F.col("_n") > local_nodes).select("scope")
    if large.isEmpty():
        return _whole(_linked(tree), with_paths).select(COLUMNS)
    large = checkpoint(large)
    big = checkpoint(tree.join(large, "scope", "left_semi"))
    placed = _contracted(_linked(big).drop("stored_depth", "linked"), local_nodes, with_paths)
    out = placed.join(big, ["scope", "node"])
    # whether a root has a link matters for few roots
    odd = big.where("linked").select("scope", F.col("node").alias("root"), F.lit(True).alias("_odd"))
    out = hot_join(out, odd, ["scope", "root"], "left", counted=placed).withColumns({"root_linked": F.when(F.col("root").isNotNull(), F.coalesce("_odd", F.lit(False))), "n_descendants": F.col("size") - 1})
    return _whole(_linked(tree.join(large, "scope", "left_anti")), with_paths).select(COLUMNS).unionByName(out.select(COLUMNS))


def descendants(placed: DataFrame) -> DataFrame:
    """(scope, node, descendant, distance): one row per node of a tree and node below it, read off the paths.

    Rows, not lists: the list of a root would be one cell with its whole tree.
    """
    steps = placed.where("path is not null and depth > 0").select("scope", F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "node"))
    return steps.where("at < depth").select("scope", "node", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
