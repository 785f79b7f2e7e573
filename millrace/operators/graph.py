"""Graphs of symbols and trees of nodes."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.shared import counted, cut, stored


def reverse_deps(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("symbol")).agg(F.array_join(F.array_sort(F.collect_set("src")), ";").alias("used_by"), F.count_distinct("src").alias("n"))


def impact(edges: DataFrame, needle: str) -> DataFrame:
    """Sources that depend on a symbol whose name contains the needle."""
    return edges.filter(F.col("dst").contains(needle)).select("src").distinct()


def blast_radius(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, affected, risk): sources that depend on symbols ending with each changed path, the changed ones apart.

    Endings are joined by equality: of each name those as long as some changed path. The lengths are as many as the
    different lengths of paths, a small table.
    """
    lengths = changed.select(F.length("path").alias("n")).distinct()
    names = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()
    ends = names.join(lengths, F.length("name") >= F.col("n")).select("name", F.expr("right(name, n)").alias("path")).join(changed.distinct(), "path")
    hit = edges.join(ends.withColumnRenamed("name", "dst"), "dst").select("path", "src").distinct()
    hit = hit.join(ends.withColumnRenamed("name", "src"), ["path", "src"], "left_anti")
    rows = changed.join(hit.groupBy("path").agg(F.count("*").alias("affected")), "path", "left").withColumn("affected", F.coalesce("affected", F.lit(0)))
    return rows.withColumn("risk", F.when(F.col("affected") > 10, "HIGH").when(F.col("affected") > 3, "MEDIUM").otherwise("LOW"))


def flows(edges: DataFrame) -> DataFrame:
    """(entry, node, depth): what can be reached from each symbol without incoming edges, breadth first, to any depth."""
    edges = cut(edges.select("src", "dst").distinct())
    entries = edges.select("src").distinct().join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_anti")
    front = cut(entries.select(F.col("src").alias("entry"), F.col("src").alias("node"), F.lit(0).alias("depth")))
    seen = front
    for depth in itertools.count(1):
        step = front.join(edges, front["node"] == edges["src"]).select("entry", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, ["entry", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def _forest(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Links (u, v) as links of each node to the smallest that the partition's links reach; ``most`` are held at a time."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ends = [table.column(k).to_numpy() for k in range(2)]
        names, code = np.unique(np.concatenate(ends), return_inverse=True)
        a, b = np.split(code.reshape(-1), 2)
        low = np.arange(len(names))
        while (low[a] != low[b]).any():  # both trees of a link hang below the smaller one, then all paths are cut short
            least = np.minimum(low[a], low[b])
            np.minimum.at(low, low[a], least)
            np.minimum.at(low, low[b], least)
            while (low[low] != low).any():
                low = low[low]
        child = np.flatnonzero(low != np.arange(len(low)))
        return pa.RecordBatch.from_arrays([pa.array(names[child], table.schema.field(0).type), pa.array(names[low[child]], table.schema.field(0).type)], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def components(links: DataFrame, a: str = "a", b: str = "b", few: int = 1 << 17) -> DataFrame:
    """(node, component): for each node of a link the smallest node that it can reach.

    Each partition turns its links into links to its own smallest nodes. In each round every node points to its
    smallest neighbour, or to itself; pointers are followed to their ends, in steps that double, and each tree becomes
    its end. So the number of nodes that still have links halves at least. Once no more than ``few`` links are left, one
    task, whose size that bounds, turns them into pointers to their ends.
    What the joins read is stored: Spark can split the partitions of a name that many rows share.
    """
    kind = links.schema[a].dataType.simpleString()

    def thinned(rows: DataFrame) -> tuple[DataFrame, int]:
        return counted(rows.filter("u <> v").mapInArrow(_forest, f"u {kind}, v {kind}"))

    links, left = thinned(links.select(F.col(a).alias("u"), F.col(b).alias("v")))
    labels = links.select(F.col("u").alias("node")).union(links.select("v")).distinct().withColumn("component", F.col("node"))
    while left:
        if left <= few:
            names = links.coalesce(1).mapInArrow(_forest, f"u {kind}, v {kind}").toDF("old", "name")
            return labels.join(names, F.col("component") == F.col("old"), "left").select("node", F.coalesce("name", "component").alias("component"))
        names = stored(links.union(links.select("v", "u")).groupBy(F.col("u").alias("old")).agg(F.least(F.min("v"), F.col("u")).alias("name")))
        moved = 1
        while moved:
            further = names.select(F.col("old").alias("name"), F.col("name").alias("next"))
            jumped = names.join(further, "name").select("old", F.col("next").alias("name"), (F.col("next") != F.col("name")).alias("moved"))
            jumped, moved = counted(jumped, F.count_if("moved"))
            names = jumped.select("old", "name")
        labels = stored(labels.join(names, F.col("component") == F.col("old"), "left").select("node", F.coalesce("name", "component").alias("component")))
        renamed = links.join(names, F.col("u") == F.col("old")).select(F.col("name").alias("u"), "v")
        renamed = renamed.join(names, F.col("v") == F.col("old")).select("u", F.col("name").alias("v"))
        links, left = thinned(renamed)
    return labels


def clusters(edges: DataFrame) -> DataFrame:
    """(node, cluster): undirected components, named by their smallest node."""
    return components(edges, "src", "dst").withColumnRenamed("component", "cluster")


def _climbed(nodes: DataFrame, sums: bool) -> DataFrame:
    """(uri, up, top, depth) of nodes (uri, parent_uri, leaf), and with ``sums`` size, leaves and height.

    Pointers to ancestors double in each round: after round k ``up`` is the ancestor 2^k steps above, ``top`` the highest
    one so far and ``depth`` the steps to it, while size, leaves and height take in the descendants within less than 2^k
    steps. A tree of depth n takes about log2(n) rounds. Nodes in a ring or below one never arrive: when pointers are
    longer than there are nodes, those left are dropped.
    """
    there = nodes.select(F.col("uri").alias("parent_uri"), F.lit(True).alias("there"))
    start = [F.lit(1).cast("long").alias("size"), F.col("leaf").cast("long").alias("leaves"), F.lit(0).cast("long").alias("height")] if sums else []
    rows = nodes.join(there, "parent_uri", "left").select("uri", F.when(F.col("there"), F.col("parent_uri")).alias("up"), F.when(F.col("there"), 1).otherwise(0).alias("depth"), *start)
    rows, n = counted(rows.withColumn("top", F.coalesce("up", "uri")))
    length = 1
    while True:
        (climbing,) = rows.agg(F.count_if(F.col("up").isNotNull())).first()
        if not climbing or length > n:
            return rows.filter("up is null")
        going = rows.filter("up is not null")
        if sums:  # added up before they are sent, so that a node above most others is no burden
            below = going.groupBy(F.col("up").alias("uri")).agg(F.sum("size").alias("size_"), F.sum("leaves").alias("leaves_"), (F.max("height") + length).alias("height_"))
            more = [(F.col(c) + F.coalesce(f"{c}_", F.lit(0))).alias(c) for c in ("size", "leaves")]
            rows = stored(rows.join(below, "uri", "left").select("uri", "up", "depth", *more, F.greatest("height", "height_").alias("height"), "top"))
            going = rows.filter("up is not null")
        above = rows.select(F.col("uri").alias("up"), F.col("up").alias("next"), F.col("depth").alias("further"), F.col("top").alias("higher"))
        kept = [c for c in rows.columns if c not in ("uri", "up", "depth", "top")]
        moved = going.join(above, "up").select("uri", F.col("next").alias("up"), (F.col("depth") + F.col("further")).alias("depth"), *kept, F.col("higher").alias("top"))
        rows = stored(moved.unionByName(rows.filter("up is null")))  # nodes that have arrived take no part in the join
        length *= 2


def _rooted(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.join(nodes.filter("parent_uri is null").select(F.col("uri").alias("top")), "top", "left_semi")


def _strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all links (src, dst) of a task: each strongly connected component by its smallest node. Walks with a stack of its own."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    names, code = np.unique(np.concatenate([table.column(k).to_numpy(zero_copy_only=False) for k in range(2)]), return_inverse=True)
    src, dst = np.split(code.reshape(-1), 2)
    order = np.argsort(src, kind="stable")
    first = np.searchsorted(src[order], np.arange(len(names) + 1)).tolist()
    dst = dst[order].tolist()
    seen, low, component = [0] * len(names), [0] * len(names), [-1] * len(names)
    stack: list[int] = []
    clock = 0
    for root in range(len(names)):
        if seen[root]:
            continue
        clock += 1
        seen[root] = low[root] = clock
        stack.append(root)
        path = [(root, first[root])]
        while path:
            node, at = path.pop()
            while at < first[node + 1]:
                to = dst[at]
                at += 1
                if not seen[to]:
                    path.append((node, at))
                    clock += 1
                    seen[to] = low[to] = clock
                    stack.append(to)
                    path.append((to, first[to]))
                    break
                if component[to] < 0:
                    low[node] = min(low[node], seen[to])
            else:
                if low[node] == seen[node]:
                    start = len(stack) - 1
                    while stack[start] != node:
                        start -= 1
                    least = min(stack[start:])
                    for x in stack[start:]:
                        component[x] = least
                    del stack[start:]
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
    kind = table.schema.field(0).type
    yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(names[component], kind)], names=["node", "component"])


def strong_components(edges: DataFrame, few: int = 1 << 17) -> DataFrame:
    """(node, component): the strongly connected component of each node of (src, dst), named by its smallest node.

    Nodes without links in or out are components of their own and go first. What is left is coloured: each node takes the
    smallest node that reaches it, and those nodes of a colour that reach their colour's node are its component. Links
    between colours can't be in one. When no more than ``few`` links are left, one task, whose size that bounds, does
    the rest. Colours take as many rounds as the longest of the shortest ways.
    """
    kind = edges.schema["src"].dataType.simpleString()
    links, n = counted(edges.select("src", "dst").filter("src is not null and dst is not null and src <> dst").distinct())
    nodes = stored(edges.select(F.col("src").alias("node")).union(edges.select("dst")).filter("node is not null").distinct())
    found = None
    while n > few:
        before = n
        ends = links.select(F.col("dst").alias("src")).distinct(), links.select(F.col("src").alias("dst")).distinct()
        links, n = counted(links.join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi").select("src", "dst"))
        if n <= few or n < 0.9 * before:
            continue
        colours = stored(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct().withColumn("colour", F.col("node")))
        moved = 1
        while moved:
            came = links.join(colours.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("came"))
            least = F.least("colour", F.coalesce("came", "colour"))
            colours, moved = counted(colours.join(came, "node", "left").select("node", least.alias("colour"), (least != F.col("colour")).alias("moved")), F.count_if("moved"))
            colours = colours.select("node", "colour")
        inside = links.join(colours.select(F.col("node").alias("src"), "colour"), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst")
        inside = stored(inside.filter("colour = other").select("src", "dst", "colour"))
        whole = front = stored(colours.filter("node = colour"))
        while True:  # backwards from each colour's node, within the colour
            step = inside.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "colour").distinct()
            front, more = counted(step.join(whole.select("node"), "node", "left_anti"))
            if not more:
                break
            whole = stored(whole.unionByName(front))
        named = whole.select("node", F.col("colour").alias("component"))
        found = named if found is None else found.union(named)
        gone = whole.select("node")
        links, n = counted(inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    rest = links.coalesce(1).mapInArrow(_strong, f"node {kind}, component {kind}")
    found = stored(rest if found is None else found.union(rest))
    return nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def reach(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entry, component) for each component that an entry reaches, its own among them, and the members (node, component).

    Entries are the components that no other one leads to. A ring of many nodes is one row for each entry; ``expanded``
    makes pairs of nodes of them. The components form no rings, so there are as many rounds as steps on the longest way.
    """
    members = stored(strong_components(edges))
    ends = edges.join(members.toDF("src", "a"), "src").join(members.toDF("dst", "b"), "dst").filter("a <> b").select("a", "b").distinct()
    ends = stored(ends)
    entries = members.select("component").distinct().join(ends.select(F.col("b").alias("component")).distinct(), "component", "left_anti")
    front = seen = stored(entries.select(F.col("component").alias("entry"), "component"))
    while True:
        step = front.join(ends, front["component"] == ends["a"]).select("entry", F.col("b").alias("component")).distinct()
        front, more = counted(step.join(seen, ["entry", "component"], "left_anti"))
        if not more:
            return seen, members
        seen = stored(seen.unionByName(front))


def expanded(reached: DataFrame, members: DataFrame) -> DataFrame:
    """(entry, node): every node that an entry component reaches, under the entry's name."""
    return reached.join(members, "component").select("entry", "node")


def node_depth(nodes: DataFrame) -> DataFrame:
    """(uri, depth) by parent links, to any depth; nodes below none without a parent are left out, those in a ring too."""
    return _rooted(nodes, _climbed(stored(nodes.select("uri", "parent_uri")), False)).select("uri", "depth")


def tree_stats(nodes: DataFrame) -> DataFrame:
    """(uri, depth, children, size, leaves, height): the nodes and the leaves of the tree below a node, itself included, and its longest way down.

    Nodes below none without a parent are left out, those in a ring too. Uris should differ.
    """
    counts = children(nodes)
    rows = stored(nodes.select("uri", "parent_uri").join(counts, "uri").withColumn("leaf", (F.col("children") == 0).cast("int")))
    found = _rooted(nodes, _climbed(rows, True))
    return found.join(rows.select("uri", "children"), "uri").select("uri", "depth", "children", "size", "leaves", "height")


def subtree(nodes: DataFrame, uri: str) -> DataFrame:
    return nodes.filter((F.col("uri") == uri) | F.col("uri").startswith(uri + "/"))


def node_path(nodes: DataFrame, uri: str) -> DataFrame:
    """The chain of ancestors of a node, itself included: those whose address begins it."""
    target = nodes.filter(F.col("uri") == uri).select(F.col("uri").alias("target"))
    parts = F.split("target", "/")
    chain = target.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("uri"))
    return nodes.join(chain, "uri", "left_semi")


def children(nodes: DataFrame) -> DataFrame:
    n = nodes.filter("parent_uri is not null").groupBy(F.col("parent_uri").alias("uri")).agg(F.count("*").alias("children"))
    return nodes.select("uri").join(n, "uri", "left").withColumn("children", F.coalesce("children", F.lit(0)))


def crawl(links: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int) -> DataFrame:
    """(url, depth): pages within some steps of the seeds, nearest first."""
    links = cut(links.select("src", "dst").distinct())
    front = cut(seeds.select("url", F.lit(0).alias("depth")))
    seen = front
    for depth in range(1, max_depth + 1):
        step = links.join(front, F.col("src") == F.col("url")).select(F.col("dst").alias("url")).distinct()
        front = cut(step.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen.orderBy("depth", "url").limit(max_pages)


def load_graph(nodes: DataFrame, column: str = "metadata") -> tuple[DataFrame, DataFrame]:
    """Symbols and edges of the logic_graph in each node's metadata; names of fields may begin with capitals."""
    kind = "struct<logic_graph: struct<symbols: array<map<string, string>>, edges: array<map<string, string>>>>"
    graph = nodes.select("uri", F.from_json(column, kind)["logic_graph"].alias("g"))
    either = lambda m, a, b: F.coalesce(m[a], m[b])
    symbols = graph.select("uri", F.explode("g.symbols").alias("s")).select("uri", either(F.col("s"), "ID", "id").alias("id"), either(F.col("s"), "Kind", "kind").alias("kind"))
    edges = graph.select("uri", F.explode("g.edges").alias("e")).select("uri", either(F.col("e"), "From", "from").alias("src"), either(F.col("e"), "To", "to").alias("dst"))
    return symbols.filter("id <> ''"), edges.filter("src <> '' and dst <> ''")


def edge_resolve(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, from, name) to (src, dst): called names resolved in their own file; self calls go."""
    found = calls.join(symbols.select("file", "name", F.col("id").alias("dst")), ["file", "name"])
    return found.select(F.col("from").alias("src"), "dst").filter("src <> dst").distinct()
