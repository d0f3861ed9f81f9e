"""Reachability, cycles, joins of branches and dependencies.

Page graphs are many and small, so a page is solved inside one task with array
operations after one shuffle by page.  A page over ``PAGE_CAP`` rows never goes
to one task: it is solved with joins, one round per step, keyed by page and
stage so that its rows stay spread over the cluster.  Both ways give the same
answer: stages of a page that share an id are one vertex, a seed if one of them
is, whose place is the first of theirs; of one position the first by id is first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procatlas.model import PAGE
from procatlas.operators.chains import along, contract
from procatlas.session import cut, written

PAGE_CAP = 50_000
ROUNDS_KEPT = 16
PLAIN_ROUNDS = 8  # steps taken one by one before flows are contracted
CORE_SHARE = 0.9  # a contraction that leaves more of the edges does not pay
SEP = "\u0001"
NULL = "\u0002"
LAST = 2**31 - 1  # the place of a node without one
CELLS = 4_000_000  # marks of heads times stages held at once
PACKED = "g string, a string, b string, pos int, seed boolean"


# --- whole pages in a task ---------------------------------------------------


def _named(column: str) -> Column:
    """The value as text, where null is a value of its own."""
    return F.coalesce(F.col(column).cast("string"), F.lit(NULL))


def _pack(nodes: DataFrame, edges: DataFrame, group: Sequence[str], node: str, pos: str) -> DataFrame:
    """Nodes (b null) and edges (b set) in one frame, so that one shuffle brings both together."""
    g = F.concat_ws(SEP, *[_named(c) for c in group]).alias("g")
    seed = F.col("seed") if "seed" in nodes.columns else F.lit(False)
    n = nodes.select(
        g, _named(node).alias("a"), F.lit(None).cast("string").alias("b"),
        F.coalesce(F.col(pos).cast("int"), F.lit(LAST)).alias("pos"), F.coalesce(seed, F.lit(False)).alias("seed"),
    )
    e = edges.where("src is not null and dst is not null").select(
        g, F.col("src").alias("a"), F.col("dst").alias("b"),
        F.lit(None).cast("int").alias("pos"), F.lit(False).alias("seed"),
    )
    return n.unionByName(e)


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Re-cut batches sorted by ``g`` so that no group is split; holds back the last group only."""
    held: pd.DataFrame | None = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        last = batch["g"] == batch["g"].iloc[-1]
        ready, held = batch[~last], batch[last]
        if len(ready):
            yield ready
    if held is not None and len(held):
        yield held


def _arrays(part: pd.DataFrame):
    """Node rows in document order with their vertex, each vertex's first row, and the edges between vertices."""
    is_node = part["b"].isna()
    nodes = part[is_node].sort_values(["g", "pos", "a"], kind="stable").reset_index(drop=True)
    edges = part[~is_node]
    vertex, names = pd.factorize(nodes["g"].str.cat(nodes["a"], sep=SEP))
    first = np.unique(vertex, return_index=True)[1]
    names = pd.Index(names)
    src = names.get_indexer(edges["g"].str.cat(edges["a"], sep=SEP))
    dst = names.get_indexer(edges["g"].str.cat(edges["b"], sep=SEP))
    on_page = (src >= 0) & (dst >= 0)
    return nodes, vertex, first, src[on_page].astype(np.int64), dst[on_page].astype(np.int64)


def _spread(mark: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Mark what the marked vertices lead to; each edge is looked at once."""
    order = np.argsort(src, kind="stable")
    ahead, starts = dst[order], np.searchsorted(src[order], np.arange(len(mark) + 1))
    frontier = np.flatnonzero(mark)
    while len(frontier):
        counts = starts[frontier + 1] - starts[frontier]
        skip = np.repeat(starts[frontier] - np.cumsum(counts) + counts, counts)
        found = np.unique(ahead[skip + np.arange(counts.sum())])
        frontier = found[~mark[found]]
        mark[frontier] = True
    return mark


def _reach_in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in _whole_groups(batches):
        nodes, vertex, first, src, dst = _arrays(part)
        mark = np.zeros(len(first), dtype=bool)
        mark[vertex[nodes["seed"].to_numpy(dtype=bool)]] = True
        yield pd.DataFrame({"g": nodes["g"], "node": nodes["a"], "reached": _spread(mark, src, dst)[vertex]})


def _component_heads(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Index of the first node of each node's cycle, -1 for nodes on no cycle.

    Nodes without a way in or out are trimmed; then the smallest index that
    reaches a node colours it, and a colour's own node pulls out its component.
    """
    head = np.full(n, -1, dtype=np.int64)
    alive = np.ones(n, dtype=bool)
    loops = np.zeros(n, dtype=bool)
    loops[src[src == dst]] = True
    src, dst = src[src != dst], dst[src != dst]
    while True:
        while True:
            keep = alive[src] & alive[dst]
            src, dst = src[keep], dst[keep]
            inner = np.zeros(n, dtype=bool)
            has_out = inner.copy()
            inner[dst], has_out[src] = True, True
            stuck = alive & ~(inner & has_out)
            if not stuck.any():
                break
            head[stuck & loops] = np.flatnonzero(stuck & loops)
            alive &= ~stuck
        if not alive.any():
            return head
        colour = np.where(alive, np.arange(n), n)
        while True:
            before = colour.copy()
            np.minimum.at(colour, dst, colour[src])
            if (colour == before).all():
                break
        back = alive & (colour == np.arange(n))
        same = colour[src] == colour[dst]
        back = _spread(back, dst[same], src[same])
        head[back] = colour[back]
        # a component of one node is a cycle only when the node loops on itself
        size = np.bincount(head[back], minlength=n)
        single = back & (size[np.where(head >= 0, head, 0)] == 1) & ~loops
        head[single] = -1
        alive &= ~back


def _cycles_in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in _whole_groups(batches):
        nodes, _, first, src, dst = _arrays(part)
        head = _component_heads(len(first), src, dst)
        on = head >= 0
        names, groups = nodes["a"].to_numpy()[first], nodes["g"].to_numpy()[first]
        yield pd.DataFrame({"g": groups[on], "node": names[on], "head": names[head[on]]})


def _joins_in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in _whole_groups(batches):
        asked = part["g"].isin(part.loc[part["seed"].astype(bool), "g"].unique())
        if asked.any():
            yield _joins_of_pages(part[asked])


def _joins_of_pages(part: pd.DataFrame) -> pd.DataFrame:
    """Of each branch the first stage that all its heads (rows with ``seed``) lead to; the heads are walked ``CELLS`` marks at a time."""
    is_head, is_node = part["seed"].to_numpy(dtype=bool), part["b"].isna().to_numpy()
    page = pd.factorize(part["g"])[0]
    link = ~is_head & ~is_node
    ends = [("a", is_node), ("a", link), ("b", link), ("b", is_head)]
    names = pd.concat([part.loc[rows, c] for c, rows in ends], ignore_index=True)
    pages = np.concatenate([page[rows] for _, rows in ends])
    table = pd.DataFrame({"p": pages, "x": names})
    vertex = table.groupby(["p", "x"], sort=True).ngroup().to_numpy()  # the vertices of a page come one after the other
    n = int(vertex.max()) + 1
    own, label = np.empty(n, dtype=np.int64), np.empty(n, dtype=object)
    own[vertex], label[vertex] = pages, names.to_numpy()
    at, src, dst, head = np.split(vertex, np.cumsum([rows.sum() for _, rows in ends])[:-1])
    place = np.full(n, LAST + 1, dtype=np.int64)
    np.minimum.at(place, at, part.loc[is_node, "pos"].to_numpy(dtype=np.int64))
    order = np.argsort(src, kind="stable")
    ahead, starts = dst[order], np.searchsorted(src[order], np.arange(n + 1))
    first = np.searchsorted(own, np.arange(own[-1] + 2))  # where each page's vertices begin
    forks = pd.DataFrame({"g": part.loc[is_head, "g"].to_numpy(), "a": part.loc[is_head, "a"].to_numpy()})
    fork = forks.groupby(["g", "a"], sort=True).ngroup().to_numpy()
    pairs = np.unique(fork * n + head)
    fork_of, head_of = pairs // n, pairs % n
    wanted = np.bincount(fork_of)
    size = (first[1:] - first[:-1])[own[head_of]]
    chunk = np.cumsum(size) // CELLS
    best = np.full(len(wanted), -1, dtype=np.int64)
    keys, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for c in np.unique(chunk):
        mine = np.flatnonzero(chunk == c)
        base = np.concatenate([[0], np.cumsum(size[mine])])
        shift = base[:-1] - first[own[head_of[mine]]]
        mark = np.zeros(base[-1], dtype=bool)
        cells, owner = head_of[mine] + shift, np.arange(len(mine))
        while len(cells):
            mark[cells] = True
            v = cells - shift[owner]
            many = starts[v + 1] - starts[v]
            skip = np.repeat(starts[v] - np.cumsum(many) + many, many)
            owner = np.repeat(owner, many)
            cells, where = np.unique(ahead[skip + np.arange(many.sum())] + shift[owner], return_index=True)
            fresh = ~mark[cells]
            cells, owner = cells[fresh], owner[where][fresh]
        hit = np.flatnonzero(mark)
        by = np.searchsorted(base, hit, side="right") - 1
        found = fork_of[mine][by] * n + hit - shift[by]
        keys, index = np.unique(np.concatenate([keys, found]), return_inverse=True)
        counts = np.bincount(index, weights=np.concatenate([counts, np.ones(len(found))]), minlength=len(keys)).astype(np.int64)
        done = (keys // n) < fork_of[mine[-1]] if c != chunk[-1] else np.ones(len(keys), dtype=bool)
        full = keys[done & (counts == wanted[keys // n])]
        full = full[place[full % n] <= LAST]
        full = full[np.lexsort((full % n, place[full % n], full // n))]
        lead = np.unique(full // n, return_index=True)[1]
        best[full[lead] // n] = full[lead] % n
        keys, counts = keys[~done], counts[~done]
    rows = forks.assign(fork=fork).drop_duplicates("fork").sort_values("fork")
    ok = best >= 0
    joined = np.where(place[best[ok]] < LAST, label[best[ok]], None)  # a place that is null says nothing
    return pd.DataFrame({"g": rows["g"].to_numpy()[ok], "node": rows["a"].to_numpy()[ok], "join_stage": joined})


def _in_tasks(packed: DataFrame, kernel, schema: str) -> DataFrame:
    return packed.repartition("g").sortWithinPartitions("g").mapInPandas(kernel, schema)


def _split_by_size(packed: DataFrame, cap: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups within the cap, rows of larger groups or None)."""
    sizes = packed.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("g")
    large = cut(sizes)
    if large.isEmpty():
        return packed, None
    return packed.join(large, "g", "left_anti"), packed.join(large, "g", "left_semi")


# --- large pages with joins --------------------------------------------------


def reach_rounds(edges: DataFrame, seeds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``keys + node`` that the seeds reach, seeds included.

    ``edges`` has some of the keys plus src and dst.  Each round joins only the
    nodes found in the last round; a round is checkpointed before the next.  What
    is still open after ``PLAIN_ROUNDS`` goes on over contracted flows, if these
    are shorter, and step by step if not.
    """
    on = [k for k in keys if k in edges.columns]
    steps = edges.select(*on, F.col("src").alias("node"), "dst").where("node <> dst").distinct()
    frontier = cut(seeds.select(*keys, "node").distinct())
    found = [frontier]
    rounds = 0
    while not frontier.isEmpty():
        if rounds == PLAIN_ROUNDS:
            rest = _reach_contracted(steps.withColumnRenamed("node", "src"), frontier, list(keys), on)
            if rest is not None:
                found.append(rest)
                return reduce(DataFrame.unionByName, found).distinct()
        rounds += 1
        reached = reduce(DataFrame.unionByName, found)
        ahead = (
            frontier.join(steps, [*on, "node"]).select(*keys, F.col("dst").alias("node")).distinct()
        )
        frontier = cut(ahead.join(reached, [*keys, "node"], "left_anti"))
        found.append(frontier)
        if len(found) > ROUNDS_KEPT:  # merge what many rounds left behind
            partitions = int(frontier.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            found = [cut(reduce(DataFrame.unionByName, found).coalesce(partitions))]
    return reduce(DataFrame.unionByName, found)


def _reach_contracted(edges: DataFrame, seeds: DataFrame, keys: list[str], on: list[str]) -> DataFrame | None:
    """What the seeds reach: the ends of their chains, then the core, then the chains on the way; None if the core is no smaller."""
    open_groups = seeds.select(*on).distinct()
    edges = cut(edges.join(open_groups, on, "left_semi") if on else edges)
    short = contract(edges, on)
    if short.core.count() > CORE_SHARE * edges.count():
        return None
    extra = [k for k in keys if k not in on]
    at_ends = seeds.join(short.ends, [*on, "node"]).select(*keys, F.col("to").alias("node"))
    in_core = short.branch.select(*on, F.col("src").alias("node")).distinct()
    starts = seeds.unionByName(at_ends).join(in_core, [*on, "node"], "left_semi")
    reached = reach_rounds(short.core, starts, keys)
    heads = reached.join(short.branch.withColumnRenamed("src", "node"), [*on, "node"]).select(*keys, F.col("dst").alias("node"))
    marks = cut(seeds.unionByName(reached).unionByName(heads).distinct())
    return along(short, marks, extra).select(*keys, "node")


def _joins_large(heads: DataFrame, edges: DataFrame, stages: DataFrame, group: Sequence[str]) -> DataFrame:
    """Reachability for all branches at once, each round over the nodes found in the last."""
    keys = [*group, "branch", "head"]
    seeds = heads.select(*keys, F.col("head").alias("node"))
    reached = reach_rounds(edges.select(*group, "src", "dst"), seeds, keys)
    wanted = heads.groupBy(*group, "branch").agg(F.count_distinct("head").alias("heads"))
    common = reached.groupBy(*group, "branch", "node").agg(F.count("*").alias("n"))
    pos = stages.select(*group, F.col("stage_id").alias("node"), "stage_pos")
    return (
        common.join(wanted, [*group, "branch"]).where("n = heads").join(pos, [*group, "node"])
        .groupBy(*group, "branch").agg(F.min_by("node", "stage_pos").alias("join_stage"))
    )


def _on_page(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a = nodes.select("g", F.col("node").alias("src"))
    b = nodes.select("g", F.col("node").alias("dst"))
    return edges.join(a, ["g", "src"], "left_semi").join(b, ["g", "dst"], "left_semi")


def _large_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = rows.where("b is null").select("g", F.col("a").alias("node"), "pos", "seed")
    edges = rows.where("b is not null").select("g", F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    return cut(nodes), cut(_on_page(edges, nodes))


def _reach_large(rows: DataFrame) -> DataFrame:
    nodes, edges = _large_graph(rows)
    reached = reach_rounds(edges, nodes.where("seed"), ["g"]).withColumn("reached", F.lit(True))
    return nodes.join(reached, ["g", "node"], "left").select(
        "g", "node", F.coalesce("reached", F.lit(False)).alias("reached")
    )


def _cycles_large(rows: DataFrame) -> DataFrame:
    """Components by contraction, then the first vertex by place and id of each as its head."""
    nodes, edges = _large_graph(rows)
    places = nodes.groupBy("g", "node").agg(F.struct(F.min("pos"), F.col("node")).alias("pos"))
    loops = edges.where("src = dst").select("g", F.col("src").alias("node"))
    members = cut(_components(cut(edges.where("src <> dst")), loops))
    first = members.join(places, ["g", "node"]).groupBy("g", "comp").agg(F.min("pos").alias("pos"))
    return members.join(first, ["g", "comp"]).select("g", "node", F.col("pos.node").alias("head"))


def _components(edges: DataFrame, loops: DataFrame) -> DataFrame:
    """(g, node, comp) of the vertices on cycles; ``loops`` (g, node) are on one by themselves.

    A vertex with one way out is on a cycle only together with its end, so the
    core's components give those of the chains between their members.
    """
    alone = loops.distinct().withColumn("comp", F.col("node"))
    if edges.isEmpty():
        return alone
    short = contract(edges, ["g"])
    if short.core.count() > CORE_SHARE * edges.count():
        found = _coloured(edges)
    else:
        inner = cut(_components(cut(short.core.where("src <> dst")), short.core.where("src = dst").select("g", F.col("src").alias("node"))))
        leaving = inner.select("g", F.col("node").alias("src"), "comp")
        closing = inner.select("g", F.col("node").alias("to"), F.col("comp").alias("back"))
        chains = short.branch.join(short.ends.withColumnRenamed("node", "dst"), ["g", "dst"])
        heads = chains.join(leaving, ["g", "src"]).join(closing, ["g", "to"]).where("comp = back").select("g", "comp", F.col("dst").alias("node"))
        between = along(short, cut(heads.distinct()), ["comp"]).join(short.ends.select("g", "node"), ["g", "node"], "left_semi")
        found = inner.unionByName(between.select(inner.columns)).unionByName(short.rings.withColumnRenamed("head", "comp"))
    found = cut(found)
    return found.unionByName(alone.join(found, ["g", "node"], "left_anti"))


def _coloured(edges: DataFrame) -> DataFrame:
    """(g, node, comp) of components of two and more vertices: the colouring done in a task, with joins."""
    found = None
    while True:
        while True:  # trim nodes without a way in or out
            inward = edges.select("g", F.col("dst").alias("node"))
            outward = edges.select("g", F.col("src").alias("node"))
            live = inward.intersect(outward)
            kept = cut(
                edges.join(live.withColumnRenamed("node", "src"), ["g", "src"], "left_semi").join(
                    live.withColumnRenamed("node", "dst"), ["g", "dst"], "left_semi"
                )
            )
            shrunk = kept.count() < edges.count()
            edges = kept
            if not shrunk:
                break
        if edges.isEmpty():
            break
        colour = cut(edges.select("g", F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            pulled = (
                edges.join(colour, (edges["g"] == colour["g"]) & (edges["src"] == colour["node"]))
                .select(edges["g"], F.col("dst").alias("node"), "colour")
                .groupBy("g", "node").agg(F.min("colour").alias("seen"))
            )
            stepped = cut(
                colour.join(pulled, ["g", "node"], "left").select(
                    "g", "node", F.least("colour", F.coalesce("seen", "colour")).alias("colour"),
                    (F.coalesce("seen", "colour") < F.col("colour")).alias("moved"),
                )
            )
            colour = stepped.drop("moved")
            if stepped.where("moved").isEmpty():
                break
        roots = colour.where("node = colour").select("g", "colour", "node")
        ends = colour.withColumnRenamed("node", "src").withColumnRenamed("colour", "c1")
        other = colour.withColumnRenamed("node", "dst").withColumnRenamed("colour", "c2")
        within = edges.join(ends, ["g", "src"]).join(other, ["g", "dst"]).where("c1 = c2")
        back = within.select("g", F.col("c1").alias("colour"), F.col("dst").alias("src"), F.col("src").alias("dst"))
        members = reach_rounds(back, roots, ["g", "colour"])
        sized = members.groupBy("g", "colour").agg(F.count("*").alias("n")).where("n > 1").select("g", "colour")
        new = cut(members.join(sized, ["g", "colour"], "left_semi").select("g", "node", F.col("colour").alias("comp")))
        found = new if found is None else found.unionByName(new)
        gone = members.select("g", "node")
        edges = cut(
            edges.join(gone.withColumnRenamed("node", "src"), ["g", "src"], "left_anti").join(
                gone.withColumnRenamed("node", "dst"), ["g", "dst"], "left_anti"
            )
        )
    if found is None:
        return edges.select("g", F.col("src").alias("node"), F.col("src").alias("comp"))
    return found


# --- public operators --------------------------------------------------------


def _unpack(solved: DataFrame, group: Sequence[str], node: str, *rest: str) -> DataFrame:
    parts = F.split("g", SEP, -1)
    return solved.select(
        *[F.nullif(parts[i], F.lit(NULL)).alias(c) for i, c in enumerate(group)],
        *[F.nullif(F.col(c), F.lit(NULL)).alias(n) for c, n in (("node", node), *((r, r) for r in rest if r == "head"))],
        *[r for r in rest if r != "head"],
    )


def reachable(
    nodes: DataFrame, edges: DataFrame, group: Sequence[str] = PAGE, node: str = "stage_id",
    pos: str = "stage_pos", cap: int = PAGE_CAP,
) -> DataFrame:
    """Whether the seed nodes (boolean ``seed``) of a group lead to each of its nodes.

    Edges with an end outside the group are ignored.
    """
    packed = written(_pack(nodes, edges, group, node, pos), "graph")
    small, large = _split_by_size(packed, cap)
    solved = _in_tasks(small, _reach_in_task, "g string, node string, reached boolean")
    if large is not None:
        solved = solved.unionByName(_reach_large(large))
    return _unpack(solved, group, node, "reached")


def cycles(
    nodes: DataFrame, edges: DataFrame, group: Sequence[str] = PAGE, node: str = "stage_id",
    pos: str = "stage_pos", cap: int = PAGE_CAP,
) -> DataFrame:
    """Nodes on a cycle with the ``head`` of their strongly connected component.

    The head is the component's first node in document order; a self-loop is a cycle.
    """
    packed = written(_pack(nodes, edges, group, node, pos), "graph")
    small, large = _split_by_size(packed, cap)
    solved = _in_tasks(small, _cycles_in_task, "g string, node string, head string")
    if large is not None:
        solved = solved.unionByName(_cycles_large(large))
    return _unpack(solved, group, node, "head")


def dependency_edges(owners: DataFrame, stages: DataFrame) -> DataFrame:
    """Distinct process→queue, process→object and object→application links by name.

    A queue action gives no object link.  The called object need not be in the release.
    """
    calls = stages.where((F.col("kind") == "action") & (F.col("owner_type") == "process"))
    targets = calls.select(
        "release_id", "owner_id",
        F.when(F.col("queue_name").isNotNull(), "queue").otherwise("object").alias("to_type"),
        F.coalesce("queue_name", "object_name").alias("to_name"),
        (F.col("queue_name").isNull() & (F.col("object_name") == "Work Queues")).alias("dynamic"),
    ).where(~F.coalesce("dynamic", F.lit(False)) & (F.coalesce("to_name", F.lit("")) != "")).drop("dynamic").distinct()
    named = targets.join(owners.select("release_id", "owner_id", F.col("name").alias("from_name")), ["release_id", "owner_id"])
    process = named.select("release_id", F.lit("process").alias("from_type"), "from_name", "to_type", "to_name")
    application = owners.where(F.coalesce("application_name", F.lit("")) != "").select(
        "release_id", F.lit("object").alias("from_type"), F.col("name").alias("from_name"),
        F.lit("application").alias("to_type"), F.col("application_name").alias("to_name"),
    )
    return process.unionByName(application).distinct()


def hotspots(edges: DataFrame, at_least: int = 2) -> DataFrame:
    """Targets that several distinct sources share.

    The distinct links are counted, so a link recorded many times weighs once and
    a popular target is combined map-side instead of meeting in one task.
    """
    links = edges.select("from_type", "from_name", "to_type", "to_name").distinct()
    shared = links.groupBy("to_type", "to_name").agg(F.count("*").alias("shared_by"))
    return shared.where(F.col("shared_by") >= at_least)


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Sources and targets of the links, with how many sources share each target."""
    sources = edges.select(F.col("from_type").alias("type"), F.col("from_name").alias("name")).distinct()
    targets = hotspots(edges, 1).select(F.col("to_type").alias("type"), F.col("to_name").alias("name"), "shared_by")
    left = sources.select(F.lit("source").alias("side"), "type", "name", F.lit(0).cast("long").alias("shared_by"))
    right = targets.select(F.lit("target").alias("side"), "type", "name", "shared_by")
    return left.unionByName(right).withColumn("hotspot", F.col("shared_by") >= 2)


FAILING_KINDS = ("action", "subsheetRef", "navigate", "write", "read", "wait", "code", "exception")


def first_stage(stages: DataFrame, kind: str, group: Sequence[str] = PAGE) -> DataFrame:
    """Earliest stage of a kind per group; a minimum, combined before the shuffle."""
    return stages.where(F.col("kind") == kind).groupBy(*group).agg(F.min_by("stage_id", "stage_pos").alias("stage_id"))


def infer_exception_edges(stages: DataFrame, group: Sequence[str] = PAGE) -> DataFrame:
    """An ``exception`` edge from every stage that may fail to its page's first recover stage."""
    recover = first_stage(stages, "recover", group).withColumnRenamed("stage_id", "dst")
    failing = stages.where(F.col("kind").isin(*FAILING_KINDS)).select(*group, F.col("stage_id").alias("src"))
    return failing.join(recover, list(group)).withColumn("kind", F.lit("exception"))


def flow_maps(stages: DataFrame, edges: DataFrame, group: Sequence[str] = PAGE) -> DataFrame:
    """Per stage with ways out: first flow successor, last true and false target, number of choices."""
    here = stages.select(*group, F.col("stage_id").alias("dst"))
    inside = edges.join(here, [*group, "dst"], "left_semi")
    is_ = lambda kind, col: F.when(F.col("kind") == kind, F.col(col))
    return inside.groupBy(*group, "src").agg(
        F.min_by(is_("flow", "dst"), is_("flow", "edge_pos")).alias("next_flow"),
        F.max_by(is_("true", "dst"), is_("true", "edge_pos")).alias("on_true"),
        F.max_by(is_("false", "dst"), is_("false", "edge_pos")).alias("on_false"),
        F.count_if(F.col("kind") == "choice").alias("choices"),
    )


def branch_joins(heads: DataFrame, edges: DataFrame, stages: DataFrame, group: Sequence[str] = PAGE, cap: int = PAGE_CAP) -> DataFrame:
    """For each branching stage the earliest stage that all of its branch heads lead to.

    ``heads`` has the group columns, ``branch`` and ``head``. Pages within ``cap`` rows are solved whole in tasks.
    """
    given = heads.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*group, "branch", "head")]))
    asked = given.select(*group, F.col("branch").alias("src"), F.col("head").alias("dst"))
    pages = _pack(stages.where("stage_id is not null"), edges, group, "stage_id", "stage_pos")
    starts = _pack(stages.limit(0), asked, group, "stage_id", "stage_pos").withColumn("seed", F.lit(True))
    packed = written(pages.unionByName(starts), "graph")
    small, large = _split_by_size(packed, cap)
    solved = _in_tasks(small, _joins_in_task, "g string, node string, join_stage string")
    types = heads.schema
    out = _unpack(solved, group, "branch", "join_stage").select(*[F.col(c).cast(types[c].dataType) for c in (*group, "branch")], "join_stage")
    if large is None:
        return out
    chosen = _unpack(large.select("g", F.lit("").alias("node")).distinct(), group, "branch").select(*[F.col(c).cast(types[c].dataType) for c in group])
    some = [df.join(chosen, list(group), "left_semi") for df in (given, edges, stages)]
    return out.unionByName(_joins_large(*some, group).select(out.columns))


def propagate_to_callers(pages: DataFrame, calls: DataFrame, group: Sequence[str] = ("release_id", "owner_id")) -> DataFrame:
    """Pages that need an item: those marked ``seed``, and callers of such pages up to pages marked ``stop``.

    ``calls`` has the group columns, ``caller`` and ``callee``.
    """
    stops = pages.where("stop").select(*group, F.col("page_id").alias("caller"))
    upward = calls.join(stops, [*group, "caller"], "left_anti").select(
        *group, F.col("callee").alias("src"), F.col("caller").alias("dst")
    )
    found = reachable(pages, upward.distinct(), group, "page_id", "page_index")
    return found.where("reached").drop("reached")


def resolve_calls(stages: DataFrame, owners: DataFrame, pages: DataFrame) -> DataFrame:
    """Object calls with the page they land on, or ``found = false``."""
    keys = ["release_id", "object_name", "action_name"]
    targets = (
        pages.where(F.col("owner_type") == "object").select("release_id", "owner_id", F.col("name").alias("action_name"), "page_id")
        .join(owners.select("release_id", "owner_id", F.col("name").alias("object_name")), ["release_id", "owner_id"])
        .groupBy(*keys).agg(F.max_by(F.struct("owner_id", "page_id"), F.struct("owner_id", "page_id")).alias("t"))
    )
    calls = stages.where(
        (F.col("kind") == "action") & F.col("queue_name").isNull() & (F.col("object_name") != "Work Queues")
    )
    joined = calls.join(targets, keys, "left")
    return joined.select(
        *calls.columns, F.col("t.owner_id").alias("object_id"), F.col("t.page_id").alias("object_page_id"),
        F.col("t").isNotNull().alias("found"),
    )


def _ways_home(stages: DataFrame, group: list[str]) -> DataFrame:
    """(group, node, mark_id, anchors) of stages whose flow works, writes one status, then hops home to the fetch.

    A row sums up some steps of a flow, twice as many each round: whether they may be walked before a status
    write (``fresh``) and after one (``done``), the write among them, and the anchors behind it and in all.
    """
    is_ = lambda *roles: F.col("role").isin(*roles)
    way = cut(stages.where(~is_("stop", "fetch") & F.col("next_flow").isNotNull()).select(
        *group, "size", "fetch_id", F.col("stage_id").alias("node"), F.col("next_flow").alias("to"),
        F.when(is_("mark"), F.col("stage_id")).alias("mark_id"), F.lit(True).alias("fresh"), is_("anchor").alias("done"),
        is_("work").alias("worked"), F.lit(0).alias("anchors"), is_("anchor").cast("int").alias("hops"),
    ))
    is_home = F.col("to") == F.col("fetch_id")
    longest, reach = way.agg(F.max("size")).first()[0] or 0, 1
    while reach < longest and not way.where(~is_home).isEmpty():
        a, b = way.where(~is_home).alias("a"), way.alias("b")
        ahead = (F.col("a.to") == F.col("b.node")) & reduce(Column.__and__, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in group])
        written_before = F.col("a.mark_id").isNotNull()
        joined = a.join(b, ahead).select(
            *[f"a.{c}" for c in [*group, "size", "fetch_id", "node"]], "b.to", F.coalesce("a.mark_id", "b.mark_id").alias("mark_id"),
            (F.col("a.fresh") & F.when(written_before, F.col("b.done")).otherwise(F.col("b.fresh"))).alias("fresh"),
            (F.col("a.done") & F.col("b.done")).alias("done"), (F.col("a.worked") | F.col("b.worked")).alias("worked"),
            F.when(written_before, F.col("a.anchors") + F.col("b.hops")).otherwise(F.col("b.anchors")).alias("anchors"),
            (F.col("a.hops") + F.col("b.hops")).alias("hops"),
        )
        way = cut(joined.where("fresh or done").unionByName(way.where(is_home)))
        reach *= 2
    return way.where(is_home & F.col("fresh") & F.col("worked") & F.col("mark_id").isNotNull()).select(*group, "node", "mark_id", "anchors")


def polling_loops(stages: DataFrame, edges: DataFrame, group: Sequence[str] = PAGE) -> DataFrame:
    """Pages of the shape: one fetch → decision → work → one status write → anchors → fetch.

    The other side of the decision must leave the loop.  Between decision and fetch
    each stage goes on by its only flow edge; a way that branches, ends, meets a second
    status write or works after one is none.  Of stages that share an id the first counts.
    """
    from procatlas.functions.text import queue_action_class

    group = list(group)
    is_queue = F.col("queue_name").isNotNull() | (F.coalesce("object_name", F.lit("")) == "Work Queues")
    role = (
        F.when((F.col("kind") == "action") & is_queue & (queue_action_class("action_name") == "get_next"), "fetch")
        .when((F.col("kind") == "action") & is_queue & F.lower("action_name").rlike("complete|exception"), "mark")
        .when(F.col("kind").isin("decision", "choice", "end"), "stop")
        .when(F.col("kind") == "anchor", "anchor")
        .otherwise("work")
    )
    marked = stages.select(*group, "stage_id", "stage_pos", "kind", role.alias("role"))
    sizes = marked.groupBy(*group).agg(
        F.count("*").alias("size"), F.count_if(F.col("role") == "fetch").alias("fetches"),
        F.max(F.when(F.col("role") == "fetch", F.col("stage_id"))).alias("fetch_id"),
    ).where("fetches = 1")
    flow = flow_maps(stages, edges, group)
    nxt = cut(
        marked.join(sizes.select(*group), group, "left_semi")
        .groupBy(*group, "stage_id").agg(F.min_by("kind", "stage_pos").alias("kind"), F.min_by("role", "stage_pos").alias("role"))
        .join(flow.withColumnRenamed("src", "stage_id"), [*group, "stage_id"], "left")
    )
    fetch = nxt.where("role = 'fetch'").join(sizes, group).select(*group, "size", "fetch_id", F.col("next_flow").alias("stage_id"))
    decision = (
        fetch.join(nxt, [*group, "stage_id"])
        .where("kind = 'decision' and on_true is not null and on_false is not null")
        .select(*group, "size", "fetch_id", F.col("stage_id").alias("decision_id"), "on_true", "on_false")
    )
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("on_true").alias("head"), F.col("on_false").alias("exit")),
        F.struct(F.lit(1).alias("side"), F.col("on_false").alias("head"), F.col("on_true").alias("exit")),
    )
    walk = decision.select(*group, "size", "fetch_id", "decision_id", F.inline(sides))
    walk = cut(walk)
    ways = _ways_home(nxt.join(walk.select(*group, "fetch_id", "size").distinct(), group), group)
    closed = cut(walk.join(ways.withColumnRenamed("node", "head"), [*group, "head"]))
    # the first side that loops decides; its exit must not lead back to the fetch
    first = closed.groupBy(*group).agg(F.min("side").alias("side"))
    closed = closed.join(first, [*group, "side"])
    seeds = closed.select(*group, F.col("exit").alias("node"))
    inside = edges.join(closed.select(*group).distinct(), group, "left_semi")
    back = reach_rounds(inside, seeds, group).withColumnRenamed("node", "fetch_id")
    return closed.join(back, [*group, "fetch_id"], "left_anti").select(
        *group, F.col("fetch_id").alias("get_next_id"), "decision_id",
        F.col("head").alias("work_head_id"), "mark_id", "anchors",
    )
