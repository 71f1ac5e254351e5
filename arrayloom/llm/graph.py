"""Connected components, and linking the members of posting lists.

Nothing here gathers links or components on the driver, and no list is
expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.llm.common import Scratch, maybe_among, sweep

#: Edges of a graph that one task works on (a few MB); larger ones are dealt out.
SMALL_GRAPH = 200_000
#: A posting list of so few members that its pairs between components are made.
SHORT = 16
#: Members of a block, and the most bytes that one should hold.
BLOCK, BLOCK_BYTES = 256, 8 << 20


def _in_one_task(batches):
    """Union-find over all batches; one row a node."""
    root: dict[int, int] = {}

    def of(x: int) -> int:
        at = x
        while root.setdefault(at, at) != at:
            at = root[at]
        while root[x] != at:
            root[x], x = at, root[x]
        return at

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = of(a), of(b)
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([of(x) for x in nodes], pa.int64())], names=["node", "label"])


def state(e: DataFrame):
    """The number of edges and 64 bits that name them all; by xor, as a sum of hashes overflows beyond some million edges."""
    return e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(edges: DataFrame, scratch: Scratch, native: bool = False) -> DataFrame:
    """node, label (smallest node reachable) for every node of ``edges`` (a, b).

    Alternating large-star and small-star steps (Kiveris et al., 2014): either
    is a minimum per node and a join, so a hub costs no single task. Every
    step is a written table, and the last has one row a node but for the
    labels themselves. A graph of at most SMALL_GRAPH edges takes the same steps
    in one task, without an exchange; unless ``native``, that is a union-find.
    """

    def table(least: DataFrame, small: bool) -> DataFrame:
        return least if small else scratch.save(least, "least")

    def star(e: DataFrame, large: bool, small: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.coalesce(1) if small else both
        if large:
            least = table(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), small)
            out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            down = both.where("b < a")
            least = table(down.groupBy("a").agg(F.min("b").alias("m")), small)
            out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        out = out.coalesce(1) if small else out
        return out.where("a <> b").distinct()

    e = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = state(e)
    if seen[0] <= SMALL_GRAPH and not native:
        return scratch.save(e.coalesce(1).mapInArrow(_in_one_task, "node bigint, label bigint"), "labels")
    while seen[0]:
        old, small = e, seen[0] <= SMALL_GRAPH
        e = e.coalesce(1) if small else e
        mid = star(e, True, small)
        mid = mid.coalesce(1) if small else scratch.save(mid, "edges")
        e = scratch.save(star(mid, False, small).coalesce(1) if small else star(mid, False, small), "edges")
        scratch.drop(old)
        now = state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def link_lists(
    postings: DataFrame,
    sizes: DataFrame,
    check: Callable[[DataFrame], DataFrame],
    check_blocks: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
    merge: bool | str = True,
    native: bool = False,
    spare: bool = False,
    most: int | None = None,
) -> DataFrame:
    """node, label of the components of the links between members of a list.

    ``postings`` (key, node) are distinct; ``sizes`` (node, size) has about the
    bytes that a node's comparison holds. Any two nodes that share a list are
    checked or already in one component, and no list gives all its pairs:

    1. Every member is checked against the list's leader, its least node. With
       ``spare`` a node is first checked against the least of its leaders, and then
       only against those outside its component.
    2. Members of one component are skipped from then on, and so are lists
       whose members, but for the leader, are of one component.
    3. Lists of at most SHORT members give their pairs between components.
    4. The longer ones that are left are joined to clusters, as the lists of a
       large family have much the same members; with ``merge`` "leader" a cluster that one block
       can't hold is only the lists of one leader, so that lists that overlap in a chain
       aren't compared with each other as a whole; with ``merge`` false every list is a cluster of its own. The nodes outside
       a cluster's largest component are compared with all its nodes block by
       block, inside tasks: a node travels once for each block that it meets. A block has
       ``most`` nodes (BLOCK unless said), fewer if they are large.

    ``check`` takes distinct pairs (a, b); ``check_blocks`` takes rows (cluster,
    x, y, head, node, label), and compares heads and other rows of equal
    (cluster, x, y) whose labels differ. Both return the links (a, b).
    """
    # tables of their own, so that joins can split a long list
    sized = postings.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader"), F.max("node").alias("other")).where("n > 1")
    sized = scratch.save(sized, "sized")
    many = sized.where("n > 2").select("key", "n", "leader")
    lists = scratch.save(maybe_among(postings, "key", many).join(many, "key").where("node <> leader"), "posted")
    # a list of two is its pair
    pairs = lists.select(F.col("node").alias("a"), F.col("leader").alias("b")).union(sized.where("n = 2").select("other", "leader")).distinct()
    if spare:
        pairs = scratch.save(pairs, "led")
        links = scratch.save(check(pairs.groupBy("a").agg(F.min("b").alias("b"))).select("a", "b"), "links")
        label = components(links, scratch, native)
        apart = pairs.join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
        apart = apart.join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
        pairs = apart.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
        links = links.union(scratch.save(check(pairs).select("a", "b"), "links"))
    else:
        links = scratch.save(check(pairs).select("a", "b"), "links")
    scratch.drop(sized)
    sweep(scratch.spark)
    label = components(links, scratch, native)
    rest = lists.join(label, "node", "left").select("key", "n", "leader", "node", F.coalesce("label", "node").alias("label"))
    rest = scratch.save(rest, "lists")
    opened = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    rest = scratch.save(rest.join(scratch.save(opened, "open"), "key"), "rest")
    sweep(scratch.spark)

    few = rest.where(F.col("n") <= SHORT).select("key", "node", "label")
    other = few.select("key", F.col("node").alias("b"), F.col("label").alias("lb"))
    pairs = few.join(other, "key").where("node > b and label <> lb").select(F.col("node").alias("a"), "b").distinct()
    links = links.union(scratch.save(check(pairs).select("a", "b"), "links"))
    sweep(scratch.spark)

    long = rest.where(F.col("n") > SHORT)
    if long.head(1):
        if merge:
            edges = long.select(F.col("node").alias("a"), F.col("leader").alias("b"))
            cluster = components(edges, scratch, native).select("node", F.col("label").alias("cluster"))
            member = long.select("node", "label").distinct().join(cluster, "node")
            if merge == "leader":
                held = member.join(sizes, "node").groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
                over = held.where((F.col("n") > (most or BLOCK)) | (F.col("size") > BLOCK_BYTES)).select("cluster", F.lit(True).alias("over"))
                own = long.select("node", "label", "leader").distinct().join(cluster, "node").join(scratch.save(over, "over"), "cluster", "left")
                member = own.select("node", "label", F.when(F.col("over"), F.col("leader")).otherwise(F.col("cluster")).alias("cluster")).distinct()
        else:
            member = long.select("node", "label", F.col("key").alias("cluster"))
        member = scratch.save(member.join(sizes, "node"), "members")
        parts = member.groupBy("cluster", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
        whole = parts.groupBy("cluster").agg(
            F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max("n").alias("most"), F.max_by("size", F.struct("n", "label")).alias("own")
        )

        def blocks(n, size):
            return F.greatest(F.ceil(n / (most or BLOCK)), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")

        whole = whole.select("cluster", "main", blocks(F.col("n") - F.col("most"), F.col("size") - F.col("own")).alias("nx"), blocks(F.col("n"), F.col("size")).alias("ny"))
        placed = member.join(scratch.save(whole, "clusters"), "cluster")

        def one(n, salt):
            return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")

        def every(n):
            return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

        heads = placed.where("label <> main").select("cluster", one("nx", 1).alias("x"), every("ny").alias("y"), F.lit(True).alias("head"), "node", "label")
        others = placed.select("cluster", every("nx").alias("x"), one("ny", 2).alias("y"), F.lit(False).alias("head"), "node", "label")
        links = links.union(scratch.save(check_blocks(heads.union(others)).select("a", "b"), "links"))
    return components(links, scratch, native)


def linked(labels, pairs, same: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """The pairs of places that ``same`` accepts, without those that are joined by then."""
    root: dict[int, int] = {}

    def of(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    found = []
    for i, j in pairs:
        p, q = of(labels[i]), of(labels[j])
        if p != q and same(i, j):
            root[max(p, q)] = min(p, q)
            found.append((i, j))
    return found
