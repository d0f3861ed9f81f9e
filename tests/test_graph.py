"""Graph operators against plain loops, in tasks and with joins."""

import random

import pytest

from procatlas.operators import graph

GROUP = ["release_id", "owner_id", "page_id"]


def random_pages(seed, pages=12):
    rnd = random.Random(seed)
    nodes, edges = [], []
    for p in range(pages):
        n = rnd.randint(1, 9)
        names = [f"n{i}" for i in range(n)]
        for i, name in enumerate(names):
            nodes.append(("R", "O", f"p{p}", name, i, rnd.random() < 0.2))
        for _ in range(rnd.randint(0, 2 * n)):
            edges.append(("R", "O", f"p{p}", rnd.choice(names), rnd.choice([*names, "elsewhere"])))
    return nodes, edges


def closure(nodes, edges):
    """(page, node) → nodes it leads to in one or more steps."""
    known = {(n[2], n[3]) for n in nodes}
    out = {k: set() for k in known}
    for _, _, p, a, b in edges:
        if (p, a) in known and (p, b) in known:
            out[(p, a)].add((p, b))
    reach = {k: set(v) for k, v in out.items()}
    changed = True
    while changed:
        changed = False
        for k in reach:
            more = set().union(*[out[x] for x in reach[k]]) if reach[k] else set()
            if not more <= reach[k]:
                reach[k] |= more
                changed = True
    return reach


@pytest.fixture(scope="module", params=[1, 2])
def case(request, spark):
    nodes, edges = random_pages(request.param)
    n = spark.createDataFrame(nodes, "release_id string, owner_id string, page_id string, stage_id string, stage_pos int, seed boolean")
    e = spark.createDataFrame(edges, "release_id string, owner_id string, page_id string, src string, dst string")
    return nodes, closure(nodes, edges), n, e


@pytest.mark.parametrize("cap", [50_000, 0])
def test_reachable(case, cap):
    nodes, reach, n, e = case
    seeds = {(x[2], x[3]) for x in nodes if x[5]}
    want = {k: k in seeds or any(k in reach[s] for s in seeds) for k in reach}
    got = {(r.page_id, r.stage_id): r.reached for r in graph.reachable(n, e, cap=cap).collect()}
    assert got == want


@pytest.mark.parametrize("cap", [50_000, 0])
def test_cycles(case, cap):
    nodes, reach, n, e = case
    order = {(x[2], x[3]): x[4] for x in nodes}
    want = {}
    for k in reach:
        if k in reach[k]:
            members = [m for m in reach[k] if k in reach[m]]
            want[k] = min(members, key=order.get)[1]
    got = {(r.page_id, r.stage_id): r.head for r in graph.cycles(n, e, cap=cap).collect()}
    assert got == want


@pytest.mark.parametrize("cap", [1, 4, 50_000])
def test_one_answer_at_any_size(spark, cap):
    """Repeated ids, equal and missing positions, null group parts and null ends, in tasks and with joins."""
    rows = [
        (None, "O", "p", "a", 0, False), (None, "O", "p", "a", 1, True), (None, "O", "p", "b", 1, False), (None, "O", "p", "c", None, False),
        ("R", None, "p", "b", 0, False), ("R", None, "p", "a", 0, False), ("R", None, "p", "d", 0, False), ("R", None, "p", "c", 0, False),
        ("R", "p", None, "a", 0, True), ("R", "p", None, None, 1, False),
    ]
    links = [(None, "O", "p", "a", "b"), (None, "O", "p", "b", "a"), (None, "O", "p", "c", "c"), ("R", None, "p", "a", "b"), ("R", None, "p", "b", "a"),
             ("R", None, "p", "c", "d"), ("R", None, "p", "d", "c"), ("R", "p", None, "a", None), ("R", "p", None, None, "a")]
    n = spark.createDataFrame(rows, "release_id string, owner_id string, page_id string, stage_id string, stage_pos int, seed boolean")
    e = spark.createDataFrame(links, "release_id string, owner_id string, page_id string, src string, dst string")
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    reached = sorted((key(r) for r in graph.reachable(n, e, cap=cap).collect()))
    assert reached == sorted(map(key, [
        (None, "O", "p", "a", True), (None, "O", "p", "a", True), (None, "O", "p", "b", True), (None, "O", "p", "c", False),
        ("R", None, "p", "b", False), ("R", None, "p", "a", False), ("R", None, "p", "d", False), ("R", None, "p", "c", False),
        ("R", "p", None, "a", True), ("R", "p", None, None, False),
    ]))
    assert sorted(key(r) for r in graph.cycles(n, e, cap=cap).collect()) == sorted(map(key, [
        (None, "O", "p", "a", "a"), (None, "O", "p", "b", "a"), (None, "O", "p", "c", "c"),
        ("R", None, "p", "a", "a"), ("R", None, "p", "b", "a"), ("R", None, "p", "c", "c"), ("R", None, "p", "d", "c"),
    ]))


def test_polling_loop_needs_a_leaving_branch(spark):
    def page(p, exit_to, kinds=None):
        kinds = {"dec": "decision", "work": "write", "hop": "anchor", "end": "end"} | (kinds or {})
        rows = [("R", "P", p, s, i, kinds.get(s, "action"), "Work Queues" if s in ("get", "mark") else None, None,
                 {"get": "Get Next Item", "mark": "Mark Completed"}.get(s)) for i, s in enumerate(["get", "dec", "work", "mark", "hop", "end"])]
        links = [("get", "dec", "flow"), ("dec", "work", "true"), ("dec", exit_to, "false"), ("work", "mark", "flow"), ("mark", "hop", "flow"), ("hop", "get", "flow")]
        return rows, [("R", "P", p, a, b, k, i) for i, (a, b, k) in enumerate(links)]

    pages = [page("good", "end"), page("both", "hop"), page("branch", "end", {"work": "choice"})]
    stages = spark.createDataFrame([r for p in pages for r in p[0]], "release_id string, owner_id string, page_id string, stage_id string, stage_pos int, kind string, object_name string, queue_name string, action_name string")
    edges = spark.createDataFrame([e for p in pages for e in p[1]], "release_id string, owner_id string, page_id string, src string, dst string, kind string, edge_pos int")
    got = graph.polling_loops(stages, edges).collect()
    assert [(r.page_id, r.get_next_id, r.decision_id, r.work_head_id, r.mark_id, r.anchors) for r in got] == [("good", "get", "dec", "work", "mark", 1)]


def solved_both_ways(n, e):
    """Answers in tasks, then with joins."""
    reach = [{(r.page_id, r.stage_id): r.reached for r in graph.reachable(n, e, cap=cap).collect()} for cap in (50_000, 0)]
    heads = [{(r.page_id, r.stage_id): r.head for r in graph.cycles(n, e, cap=cap).collect()} for cap in (50_000, 0)]
    return reach, heads


def test_contracted_flows(spark, monkeypatch):
    """Rings, chains into and out of cycles, diamonds, trees of dead ends, ladders and random pages, all by contraction."""
    monkeypatch.setattr(graph, "PLAIN_ROUNDS", 0)
    shapes = {
        "ring": [(i, (i + 1) % 9) for i in range(9)] + [(20, 21), (21, 3)],
        "ring_with_way_out": [(i, (i + 1) % 9) for i in range(9)] + [(4, 30), (30, 31), (31, 32), (10, 11), (11, 2)],
        "two_rings": [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (5, 6)],
        "diamonds": [x for i in range(0, 15, 3) for x in ((i, i + 1), (i, i + 2), (i + 1, i + 3), (i + 2, i + 3))] + [(15, 0)],
        "diamonds_open": [x for i in range(0, 15, 3) for x in ((i, i + 1), (i, i + 2), (i + 1, i + 3), (i + 2, i + 3))],
        "caterpillar": [x for i in range(9) for x in ((i, i + 1), (i, 100 + i))] + [(9, 5)],
        "tree": [(i, 2 * i + j) for i in range(1, 8) for j in (0, 1)],
        "ladder": [x for i in range(6) for x in ((i, i + 1), (i, i + 2))] + [(7, 3)],
        "own_loops": [(0, 0), (0, 1), (1, 2), (2, 2), (2, 1), (3, 3)],
        "star": [(i, 50) for i in range(20)] + [(50, 51), (51, 52), (52, 7)],
    }
    rnd = random.Random(5)
    nodes, edges = random_pages(7, 10)
    for page, links in shapes.items():
        names = sorted({x for link in links for x in link})
        at = rnd.sample(range(len(names)), len(names))
        nodes += [("R", "O", page, str(x), p, i == 1) for i, (x, p) in enumerate(zip(names, at))]
        edges += [("R", "O", page, str(a), str(b)) for a, b in links]
    n = spark.createDataFrame(nodes, "release_id string, owner_id string, page_id string, stage_id string, stage_pos int, seed boolean")
    e = spark.createDataFrame(edges, "release_id string, owner_id string, page_id string, src string, dst string")
    (in_tasks, joined), (heads, joined_heads) = solved_both_ways(n, e)
    reach = closure(nodes, edges)
    seeds = {(x[2], x[3]) for x in nodes if x[5]}
    assert in_tasks == joined == {k: k in seeds or any(k in reach[s] for s in seeds) for k in reach}
    order = {(x[2], x[3]): x[4] for x in nodes}
    assert heads == joined_heads == {k: min((m for m in reach[k] if k in reach[m]), key=order.get)[1] for k in reach if k in reach[k]}


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """5,000 stages in a row that end in a ring of 10: checkpoints grow with the logarithm of the depth."""
    from procatlas.operators import chains

    rounds = []

    def counted(df):
        rounds.append(1)
        return cut(df)

    cut = graph.cut
    monkeypatch.setattr(graph, "cut", counted)
    monkeypatch.setattr(chains, "cut", counted)
    size = 5_000
    n = spark.range(size).selectExpr("'R' release_id", "'O' owner_id", "'p' page_id", "string(id) stage_id", "int(id) stage_pos", "id = 7 seed")
    e = spark.range(size).selectExpr("'R' release_id", "'O' owner_id", "'p' page_id", "string(id) src", f"string(if(id = {size - 1}, {size - 10}, id + 1)) dst")
    got = graph.reachable(n, e, cap=1000)
    assert got.where("reached").agg({"stage_id": "count"}).first()[0] == size - 7
    assert got.where("not reached").count() == 7
    assert len(rounds) < 40
    rounds.clear()
    ring = graph.cycles(n, e, cap=1000).collect()
    assert sorted(int(r.stage_id) for r in ring) == list(range(size - 10, size)) and {r.head for r in ring} == {str(size - 10)}
    assert len(rounds) < 40


def test_polling_loops_match_a_walk(spark):
    """Random flows of work, anchors, status writes, stops and dead ends, one of them long, against one walker a side."""
    rnd = random.Random(9)
    columns = "release_id string, owner_id string, page_id string, stage_id string, stage_pos int, kind string, object_name string, queue_name string, action_name string"
    kinds = {"work": "write", "anchor": "anchor", "stop": "choice", "mark": "action"}
    stages, edges, want = [], [], set()
    for p in range(150):
        page, size = f"p{p}", 300 if p == 0 else rnd.randint(1, 6)
        weights = [1, 0, 0, 0] if p == 0 else [6, 5, 1, 5]
        roles = {f"s{i}": rnd.choices(["work", "anchor", "stop", "mark"], weights)[0] for i in range(size)}
        if p == 0:
            roles |= {f"s{i}": "anchor" for i in range(200, 300)} | {"s199": "mark"}
        elif rnd.random() < 0.4:
            at = rnd.randrange(size)
            roles = {s: "work" if i < at else "mark" if i == at else "anchor" for i, s in enumerate(roles)}
        ids = list(roles)
        follows = {a: b for a, b in zip(ids, [*ids[1:], "get"])}
        if p and rnd.random() < 0.3:
            follows[rnd.choice(ids)] = rnd.choice([*ids, None])
        heads = ("s0", "out") if rnd.random() < 0.5 else ("out", "s0")
        if p and rnd.random() < 0.3:
            heads = (heads[0], rnd.choice(ids))
        out_back = p > 0 and rnd.random() < 0.2
        links = [("get", "dec", "flow"), ("dec", heads[0], "true"), ("dec", heads[1], "false"), *[(a, b, "flow") for a, b in follows.items() if b]]
        links += [("out", "get", "flow")] if out_back else []
        queue = {"get": "Get Next Item", **{s: "Mark Completed" for s, r in roles.items() if r == "mark"}}
        kind = {"get": "action", "dec": "decision", "out": "end", **{s: kinds[r] for s, r in roles.items()}}
        stages += [("R", "P", page, s, i, k, "Work Queues" if s in queue else None, None, queue.get(s)) for i, (s, k) in enumerate(kind.items())]
        edges += [("R", "P", page, a, b, k, i) for i, (a, b, k) in enumerate(links)]
        reach = closure([("R", "P", page, s) for s in kind], [("R", "P", page, a, b) for a, b, _ in links])
        for head, exit_ in (heads, heads[::-1]):
            at, mark, worked, anchors, seen = head, None, False, 0, set()
            while at not in (None, "get", "out") and at not in seen:
                seen.add(at)
                if roles[at] == "stop" or (mark and roles[at] != "anchor"):
                    at = None
                    break
                worked, anchors = worked or roles[at] == "work", anchors + bool(mark and roles[at] == "anchor")
                mark = at if roles[at] == "mark" else mark
                at = follows[at]
            if at == "get" and mark and worked:
                if (page, "get") not in reach[(page, exit_)]:
                    want.add((page, "get", "dec", head, mark, anchors))
                break
    s = spark.createDataFrame(stages, columns)
    e = spark.createDataFrame(edges, "release_id string, owner_id string, page_id string, src string, dst string, kind string, edge_pos int")
    got = [(r.page_id, r.get_next_id, r.decision_id, r.work_head_id, r.mark_id, r.anchors) for r in graph.polling_loops(s, e).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 10 and ("p0", "get", "dec", "s0", "s199", 100) in want


def test_branch_joins_in_tasks_take_no_rounds_and_agree_with_a_walk(spark, monkeypatch):
    import random

    rnd = random.Random(11)
    heads, edges, stages, want = [], [], [], {}
    for page in ("a", "b", "c"):
        ids = [f"s{i}" for i in range(12)]
        places = {s: (None if s == "s11" else rnd.randint(0, 30) * 20 + i) for i, s in enumerate(ids)}
        stages += [(page, s, places[s]) for s in ids if s != "s10"]  # s10 is no stage, ways lead through it
        links = {(rnd.choice(ids), rnd.choice(ids)) for _ in range(14)}
        edges += [(page, a, b) for a, b in links] * 2
        for branch in ("s0", "s1", "s2"):
            mine = {rnd.choice(ids) for _ in range(2)}
            heads += [(page, branch, h) for h in mine] + [(page, branch, None)]
            sets = []
            for h in mine:
                seen, todo = {h}, [h]
                while todo:
                    x = todo.pop()
                    new = {b for a, b in links if a == x} - seen
                    seen |= new
                    todo += new
                sets.append(seen)
            common = [s for s in set.intersection(*sets) if s != "s10"]
            if common:
                placed = [s for s in common if places[s] is not None]
                want[page, branch] = min(placed, key=places.get) if placed else None
    h = spark.createDataFrame(heads + [(None, "x", "s1")], "page_id string, branch string, head string")
    e = spark.createDataFrame(edges + [("a", "s0", None)], "page_id string, src string, dst string")
    s = spark.createDataFrame(stages, "page_id string, stage_id string, stage_pos int")
    read = lambda df: {(r.page_id, r.branch): r.join_stage for r in df.collect()}
    assert read(graph.branch_joins(h, e, s, ["page_id"], cap=5)) == want  # with joins
    monkeypatch.setattr(graph, "CELLS", 20)  # heads of one branch fall into several turns
    part = graph._pack(s, e, ["page_id"], "stage_id", "stage_pos").toPandas()
    asked = [{"g": p, "a": b, "b": x, "pos": None, "seed": True} for p, b, x in heads if x is not None]
    import pandas as pd

    frame = pd.concat([part[part["g"].isin(["a", "b", "c"])], pd.DataFrame(asked)], ignore_index=True).sort_values("g", kind="stable")
    found = graph._joins_of_pages(frame)
    assert {(r.g, r.node): r.join_stage for r in found.itertuples()} == want
    monkeypatch.setattr(graph, "reach_rounds", None)  # no rounds of jobs for small pages
    assert read(graph.branch_joins(h, e, s, ["page_id"])) == want
