"""Small literal graphs with exact expectations."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.fluent import Traversal
from graphloom.functions.values import collect, count, greatest, least, mean, total
from graphloom.model import EdgeTable, GraphError, NodeTable, PropertyGraph, union
from graphloom.operators import components, paths, ranking, schema
from graphloom.operators.writes import Transaction, replay
from graphloom.plans.match import guarded, hop, match, neighbours, node
from graphloom.sources import files


def simple(spark, n, edges, label="V", weight=False):
    """Nodes 0..n-1; edges (src, dst, type[, w])."""
    nodes = spark.createDataFrame([(i, [label]) for i in range(n)], "id long, labels array<string>")
    tables = {}
    for kind in dict.fromkeys(e[2] for e in edges) or ["REL"]:
        rows = [(i, *e[:2], *(e[3:] if weight else ())) for i, e in enumerate(edges) if e[2] == kind]
        tables[kind] = EdgeTable(spark.createDataFrame(rows, "id long, src long, dst long" + ", w double" * weight), kind, label, label)
    return PropertyGraph({label: NodeTable(nodes, (label,))}, tables)


@pytest.fixture(scope="module")
def people(spark):
    person = spark.createDataFrame([(1, ["Person"], "Ada", 1815), (2, ["Person"], "Charles", 1791), (3, ["Person"], "Marie", 1867)], "id long, labels array<string>, name string, born long")
    doc = spark.createDataFrame([(4, ["Document"], "Notes on the Analytical Engine", 1843), (5, ["Document"], "Sketch", 1842)], "id long, labels array<string>, title string, year long")
    wrote = spark.createDataFrame([(1, 1, 4), (2, 2, 5)], "id long, src long, dst long")
    knows = spark.createDataFrame([(3, 1, 2)], "id long, src long, dst long")
    return PropertyGraph({"Person": NodeTable(person, ("Person",)), "Document": NodeTable(doc, ("Document",))}, {"WROTE": EdgeTable(wrote, "WROTE", "Person", "Document"), "KNOWS": EdgeTable(knows, "KNOWS", "Person", "Person")})


def names(df, col="name"):
    return [r[col] for r in df.collect()]


def test_basic_matches(people):
    assert names(match(people, node("p", "Person")).returns(lambda v: {"name": v.p.name}, order=["name"])) == ["Ada", "Charles", "Marie"]
    both = match(people, node("a", "Person"), hop("KNOWS", direction="both"), node("b", "Person"))
    assert sorted(names(both.returns(lambda v: {"name": v.a.name}))) == ["Ada", "Charles"]
    some = match(people, node("p"), hop("WROTE", "KNOWS"), node("x"))
    assert sorted(names(some.returns(lambda v: {"name": v.p.name}, distinct=True))) == ["Ada", "Charles"]
    late = match(people, node("p", "Person")).where(lambda v: v.p.born > 1800)
    assert late.df.count() == 2
    assert names(match(people, node("p", "Person")).returns(lambda v: {"born": v.p.born}, order=[("born", "desc")], skip=1, limit=1), "born") == [1815]
    with pytest.raises(GraphError, match="ROW_LIMIT"):
        guarded(match(people, node("p", "Person")).df, 2)


def test_two_valued_logic(people):
    p = lambda f: match(people, node("x")).where(f).df.count()
    assert p(lambda v: v.x.born > 1) == 3
    assert p(lambda v: ~(v.x.born > 1)) == 2  # null is not true
    assert p(lambda v: v.x.born == "1815") == 0
    assert p(lambda v: v.x.born != "1815") == 3
    assert p(lambda v: v.x.born != None) == 0  # noqa: E711
    assert p(lambda v: v.x.name.is_in(["Ada", 7, None])) == 1
    assert p(lambda v: v.x.name.contains(3)) == 0
    assert p(lambda v: v.x.exists_not.exists()) == 0
    df = match(people, node("d", "Document")).returns(lambda v: {"a": v.d.missing > 1, "b": v.d.year.lower()})
    assert [tuple(r) for r in df.collect()] == [(False, None)] * 2
    with pytest.raises(GraphError, match="unknown variable"):
        match(people, node("x")).where(lambda v: v.y.name == "")


def test_aggregates(spark):
    person = spark.createDataFrame([(1, ["Person"], "Ada", "math"), (2, ["Person"], "Emmy", "math"), (3, ["Person"], "Marie", "physics")], "id long, labels array<string>, name string, field string")
    doc = spark.createDataFrame([(10 + i, ["Doc"], p) for i, p in enumerate((10, 20, 30, 5, 5, 100))], "id long, labels array<string>, pages long")
    wrote = spark.createDataFrame([(i, s, 10 + i) for i, s in enumerate((1, 1, 1, 2, 2, 3))], "id long, src long, dst long")
    g = PropertyGraph({"Person": NodeTable(person, ("Person",)), "Doc": NodeTable(doc, ("Doc",))}, {"WROTE": EdgeTable(wrote, "WROTE", "Person", "Doc")})
    m = match(g, node("p", "Person"), hop("WROTE"), node("d", "Doc"))
    rows = m.returns(lambda v: {"f": v.p.field, "s": total(v.d.pages), "a": mean(v.d.pages), "lo": least(v.d.pages), "hi": greatest(v.d.pages)}, order=["f"]).collect()
    assert tuple(rows[0]) == ("math", 70, 14.0, 5, 30)
    one = m.returns(lambda v: {"n": count(), "d": count(v.d.pages, distinct=True), "all": collect(v.d.pages)}).first()
    assert tuple(one) == (6, 5, [5, 5, 10, 20, 30, 100])
    for misplaced in (lambda: m.where(lambda v: count(v.d.pages)), lambda: m.where(lambda v: v.d.pages > count()), lambda: m.returns(lambda v: {"n": total(count())})):
        with pytest.raises(GraphError, match="SEMANTIC_ERROR"):
            misplaced()
    none = m.where(lambda v: v.d.pages > 1000)
    assert tuple(none.returns(lambda v: {"n": count(), "s": total(v.d.pages)}).first()) == (0, 0)
    assert none.returns(lambda v: {"f": v.p.field, "n": count()}).count() == 0


def test_chains_and_patterns(spark):
    g = simple(spark, 6, [(0, 1, "REL"), (1, 2, "REL"), (2, 3, "REL"), (2, 0, "REL"), (4, 5, "OTHER")])
    reach = lambda a, b: sorted(r[0] for r in match(g, node("s", "V"), hop("REL", least=a, most=b), node("t", "V")).where(lambda v: v.s.id == 0).returns(lambda v: {"t": v.t.id}).collect())
    assert reach(1, 2) == [1, 2]
    assert reach(3, 4) == [0, 3]
    assert reach(1, 4) == [0, 1, 2, 3]
    back = match(g, node("s"), hop("REL", least=1, most=4), node("s")).where(lambda v: v.s.id == 0)
    assert back.df.count() == 1
    ring = match(g, node("a"), hop("REL"), node("b"), hop("REL"), node("c"), hop("REL"), node("a")).where(lambda v: v.a.id == 0)
    assert [tuple(r) for r in ring.returns(lambda v: {"a": v.a.id, "b": v.b.id, "c": v.c.id}).collect()] == [(0, 1, 2)]
    with pytest.raises(GraphError):
        hop("REL", least=1, most=16)
    with pytest.raises(GraphError):
        hop("REL", var="r", least=1)


def test_self_loops(spark):
    g = simple(spark, 2, [(0, 0, "REL"), (0, 1, "REL")])
    assert match(g, node("a"), hop("REL", direction="both"), node("b")).df.count() == 3
    assert Traversal.nodes(g).both("REL").count() == 4
    assert {r["node"]: r["score"] for r in ranking.degree(g).collect()} == {0: 3, 1: 1}


def test_fluent_and_indexes(people):
    g = people.with_index("property", "Person", "born").with_index("fulltext", "Document", "title")
    assert names(Traversal.nodes_where(g, "Person", "born", gt=1800).df) == ["Ada", "Marie"]
    assert Traversal.search(g, "Document", "title", "engine NOTES").count() == 1
    assert Traversal.search(g, "Document", "title", "anal", prefix=True).count() == 1
    assert Traversal.search(g, "Document", "title", " ").count() == 0
    with pytest.raises(GraphError, match="NOT_FOUND"):
        Traversal.nodes_where(g, "Person", "name", "Ada")
    t = Traversal.node(g, 1, route=True).out("KNOWS").out("WROTE")
    assert [tuple(r) for r in t.paths().collect()] == [([1, 2, 5], [3, 2])]
    assert Traversal.node(g, 99).count() == 0
    assert names(Traversal.nodes(g, "Person").out_edges("WROTE").where(F.col("src") == 1).to_node().df, "title") == ["Notes on the Analytical Engine"]
    assert neighbours(g, 1).count() == 2
    with pytest.raises(GraphError, match="VALIDATION"):
        g.with_index("property", "Person", "born")
    with pytest.raises(GraphError, match="NOT_FOUND"):
        g.without_index("unique", "Person", "born")


def test_components(spark):
    g = simple(spark, 7, [(0, 1, "R"), (1, 2, "R"), (2, 0, "R"), (0, 3, "R"), (4, 5, "R"), (5, 4, "R")])
    weak = {r[0]: r[1] for r in components.weak_components(g).collect()}
    assert weak == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 2}
    strong = {r[0]: r[1] for r in components.strong_components(g).collect()}
    assert strong == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 2, 6: 3}


def test_paths(spark):
    g = simple(spark, 5, [(0, 1, "E", 1.0), (1, 3, "E", 1.0), (0, 2, "E", 5.0), (2, 3, "E", 1.0), (0, 3, "E", 10.0), (4, 0, "E", 1.0)], weight=True)
    assert paths.shortest_path(g, 0, 3).first()["cost"] == 1
    row = paths.shortest_path(g, 0, 3, weight="w").first()
    assert row["cost"] == 2 and row["path"]["nodes"] == [0, 1, 3] and row["path"]["edges"] == [0, 1]
    assert paths.shortest_path(g, 0, 4).count() == 0
    assert paths.shortest_path(g, 0, 0).first()["cost"] == 0
    with pytest.raises(GraphError, match="NOT_FOUND"):
        paths.shortest_path(g, 0, 9)
    g = simple(spark, 4, [(0, 1, "E"), (1, 3, "E"), (0, 2, "E"), (2, 3, "E")])
    assert sorted(r["path"]["nodes"] for r in paths.all_shortest_paths(g, 0, 3).collect()) == [[0, 1, 3], [0, 2, 3]]
    g = simple(spark, 2, [(0, 1, "E", -1.0)], weight=True)
    with pytest.raises(GraphError, match="VALIDATION"):
        paths.shortest_path(g, 0, 1, weight="w")


def test_bfs_topo_cycles(spark):
    g = simple(spark, 6, [(0, 1, "REL"), (0, 2, "REL"), (1, 3, "REL"), (2, 3, "REL"), (3, 4, "REL"), (4, 5, "OTHER")])
    assert {r[0]: r[1] for r in paths.bfs(g, 0).collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 4}
    assert paths.bfs(g, 0, max_depth=1).count() == 3
    order = {r[0]: r[1] for r in paths.topo_sort(g).collect()}
    assert sorted(order.values()) == list(range(6)) and all(order[a] < order[b] for a, b in ((0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 5)))
    assert paths.cycles(g).count() == 0
    ring = simple(spark, 3, [(0, 1, "R"), (1, 2, "R"), (2, 0, "R")])
    assert paths.cycles(ring).first()["cycle"] == [0, 1, 2]
    with pytest.raises(GraphError, match="VALIDATION"):
        paths.topo_sort(ring)


def test_ranking(spark):
    line = simple(spark, 5, [(i, i + 1, "R") for i in range(4)])
    assert {r[0]: r[1] for r in ranking.betweenness(line).collect()} == {0: 0, 1: 3, 2: 4, 3: 3, 4: 0}
    assert {r[0]: r[1] for r in ranking.betweenness(line, sample=5).collect()} == {0: 0, 1: 3, 2: 4, 3: 3, 4: 0}
    diamond = simple(spark, 4, [(0, 1, "R"), (0, 2, "R"), (1, 3, "R"), (2, 3, "R")])
    assert {r[0]: r[1] for r in ranking.betweenness(diamond).collect()} == {0: 0, 1: 0.5, 2: 0.5, 3: 0}
    ring = simple(spark, 3, [(0, 1, "R"), (1, 2, "R"), (2, 0, "R")])
    assert all(abs(r["score"] - 1 / 3) < 1e-12 for r in ranking.pagerank(ring).collect())
    hub = ranking.pagerank(simple(spark, 5, [(i, 4, "R") for i in range(4)])).collect()
    assert abs(sum(r["score"] for r in hub) - 1) < 1e-9 and max(hub, key=lambda r: r["score"])["node"] == 4
    with pytest.raises(GraphError, match="VALIDATION"):
        ranking.pagerank(ring, damping=1.5)


def test_louvain(spark):
    clique = lambda at, n: [(at + i, at + j, "R") for i in range(n) for j in range(i)]
    two = components.louvain(simple(spark, 10, clique(0, 5) + clique(5, 5) + [(0, 5, "R")])).collect()
    assert len({r["community"] for r in two}) == 2 and len({r["community"] for r in two if r["node"] < 5}) == 1
    assert components.louvain(simple(spark, 6, clique(0, 6))).select("community").distinct().count() == 1
    assert components.louvain(simple(spark, 2, [])).select("community").distinct().count() == 2


def test_louvain_levels_end_in_few_rounds(spark):
    """Two affine maps of a ring, where levels end in many small moves: each one in 24 rounds at most."""
    n = 600
    g = simple(spark, n, [(i, j, "R") for i in range(n) for j in ((31 * i + 7) % n, (17 * i + 3) % n)])
    part = {r["node"]: r["community"] for r in components.louvain(g, max_rounds=24).collect()}
    ends = [(part[i], part[j]) for i in range(n) for j in ((31 * i + 7) % n, (17 * i + 3) % n)]
    degree = {c: sum((a == c) + (b == c) for a, b in ends) for c in set(part.values())}
    assert sum(a == b for a, b in ends) / len(ends) - sum((k / 2 / len(ends)) ** 2 for k in degree.values()) > 0.4


def test_schema(people):
    assert {tuple(r) for r in schema.label_stats(people).collect()} == {("Person", 3), ("Document", 2)}
    types = {tuple(r) for r in schema.property_types(people).collect()}
    assert [r["kind"] for r in schema.summary(people).collect()] == ["edge"] * 2 + ["label"] * 2 + ["property"] * 4
    assert ("Person", "name", "string", 3) in types and ("Document", "year", "number", 2) in types
    assert {tuple(r) for r in schema.edge_types(people).collect()} == {("WROTE", "Person", "Document", 2), ("KNOWS", "Person", "Person", 1)}


def test_writes(spark, people):
    t = Transaction(people)
    ids = spark.createDataFrame([(1,)], "id long")
    with pytest.raises(GraphError, match="DETACH_REQUIRED"):
        t.delete_nodes("Person", ids)
    t.delete_nodes("Person", ids, detach=True)
    after = t.commit()
    assert after.scan("Person").count() == 2 and after.edge_frame().count() == 1 and t.stats["deleted"] == 3
    with pytest.raises(GraphError, match="NOT_FOUND"):
        Transaction(people).delete_nodes("Person", ids.union(ids), detach=True)
    unique = people.with_index("unique", "Person", "name")
    t = Transaction(unique)
    t.create_nodes("Person", spark.createDataFrame([("k", "Ada", 1)], "k string, name string, born long"), "k")
    with pytest.raises(GraphError, match="CONSTRAINT_VIOLATION"):
        t.commit()
    t = Transaction(people)
    rows = spark.createDataFrame([("Ada",), ("Grace",)], "name string")
    made = {r["name"]: r["id"] for r in t.merge_nodes("Person", rows, "name").collect()}
    assert made == {"Ada": 1, "Grace": 6}
    t.create_edges("KNOWS", spark.createDataFrame([(6, 1)], "src long, dst long"), "Person", "Person")
    with pytest.raises(GraphError, match="NOT_FOUND"):
        t.create_edges("KNOWS", spark.createDataFrame([(6, 99)], "src long, dst long"))
    assert t.commit().check().count() == 0


def test_files(spark, people, tmp_path):
    files.save(people, f"file://{tmp_path}/g", 1)
    again = files.load(spark, f"file://{tmp_path}/g")
    assert again.scan("Person").count() == 3 and again.edge_frame("WROTE").count() == 2
    (tmp_path / "n.csv").write_text("tempId,:label,born:number\n1,A,x\n")
    with pytest.raises(GraphError, match="VALIDATION"):
        files.nodes_from_csv(files.read_csv(spark, f"file://{tmp_path}/n.csv"))
    nodes = spark.createDataFrame([("a", ["A"], 1.0), ("b", ["A"], None)], "tempId string, labels array<string>, x double")
    edges = spark.createDataFrame([("a", "b", "E"), ("a", "b", "E")], "from string, to string, type string")
    g = files.import_graph(nodes, edges, ["A"], ["E"])
    assert match(g, node("s", "A"), hop("E"), node("t", "A")).df.count() == 2
    with pytest.raises(GraphError, match="NOT_FOUND"):
        files.import_graph(nodes, edges.union(spark.createDataFrame([("a", "zz", "E")], edges.schema)), ["A"], ["E"])
    (tmp_path / "g.json").write_text('{"nodes": [{"tempId": "1", "labels": ["A"], "properties": {"x": 2}}], "edges": []}')
    n, e = files.read_json(spark, f"file://{tmp_path}/g.json", "x double", "w double")
    assert n.first()["x"] == 2 and e.count() == 0


def test_random_graphs(spark):
    """Chains and undirected hops against a plain evaluator."""
    import random

    rng = random.Random(4)
    for _ in range(3):
        edges = [(rng.randrange(5), rng.randrange(5), "R") for _ in range(7)]
        g = simple(spark, 5, edges)
        ways = [(i, a, b) for i, (a, b, _) in enumerate(edges)]
        for direction in ("out", "both"):
            near = ways if direction == "out" else ways + [(i, b, a) for i, a, b in ways if a != b]
            walks, expected = [(n, n, ()) for n in range(5)], []
            for _ in range(3):
                walks = [(s, b, (*used, i)) for s, at, used in walks for i, a, b in near if a == at and i not in used]
                expected += [(s, at) for s, at, _ in walks]
            m = match(g, node("s"), hop("R", direction=direction, least=1, most=3), node("t"))
            assert sorted(map(tuple, m.returns(lambda v: {"s": v.s.id, "t": v.t.id}).collect())) == sorted(expected)
            two = match(g, node("s"), hop("R", direction=direction), node("x"), hop("R", direction=direction), node("t"))
            assert two.df.count() == sum(1 for _, _, b in near for _, a, _ in near if a == b)


def _versions(spark, people, path, labels, start=1):
    graph = people
    for tx, label in enumerate(labels, start):
        t = Transaction(graph)
        t.create_nodes(label, spark.createDataFrame([(f"{label}{tx}",)], "name string"), "name")
        graph = t.commit()
        files.save(graph, path, tx, t.log)
    return graph


def test_feed(spark, tmp_path, people):
    from graphloom.streaming import feed

    path = f"file://{tmp_path}/v"
    _versions(spark, people, path, ("City", "River"), 5)
    got: list = []
    stream = feed.subscribe(spark, path)
    feed.deliver(stream, path, lambda b: got.extend(b.collect()), f"file://{tmp_path}/checkpoint", labels=("River",)).awaitTermination()
    assert [(r["tx_id"], r["op"], r["name"], r["props"]) for r in got] == [(6, "createNode", "River", '{"name":"River6"}')]
    with pytest.raises(GraphError, match="resync"):
        feed.subscribe(spark, path, from_tx=2)
    with pytest.raises(GraphError, match="committed already"):
        files.save(people, path, 6)


def test_failing_handler(spark, tmp_path, people):
    """A batch whose handler fails is delivered again; other subscriptions go on."""
    from graphloom.streaming import feed

    path, checkpoint = f"file://{tmp_path}/v", f"file://{tmp_path}/checkpoint"
    _versions(spark, people, path, ("City", "River"))

    def fails(_):
        raise ValueError("boom")

    with pytest.raises(Exception, match="boom"):
        feed.deliver(feed.subscribe(spark, path, per_trigger=1), path, fails, checkpoint).awaitTermination()
    got: list = []
    feed.deliver(feed.subscribe(spark, path, per_trigger=1), path, lambda b: got.append(sorted({r["tx_id"] for r in b.collect()})), checkpoint).awaitTermination()
    assert sorted(got) == [[1], [2]]


def test_crash_before_commit(spark, tmp_path, people, monkeypatch):
    """What was written before a crash is seen by nobody, and the next attempt takes its place."""
    from graphloom.streaming import feed

    path = f"file://{tmp_path}/v"
    graph = _versions(spark, people, path, ("City",))
    t = Transaction(graph)
    t.create_nodes("River", spark.createDataFrame([("x",)], "name string"), "name")

    def crash(*_):
        raise OSError("crash")

    with monkeypatch.context() as m:
        m.setattr(files.json, "dumps", crash)
        with pytest.raises(OSError):
            files.save(t.commit(), path, 2, t.log)
    assert files.versions(spark, path) == [1] and "River" not in files.load(spark, path).nodes
    got: list = []
    deliver = lambda name: feed.deliver(feed.subscribe(spark, path), path, lambda b: got.extend(r["tx_id"] for r in b.collect()), f"file://{tmp_path}/{name}").awaitTermination()
    deliver("a")
    assert got == [1]
    files.save(t.commit(), path, 2, t.log)
    deliver("a")
    assert got == [1, 2] and files.load(spark, path).scan("River").count() == 1 and files.load(spark, path, 1).nodes.keys() == graph.nodes.keys()
    files.save(graph, path, 3, t.log)
    files.retain(spark, path, 1)
    assert files.versions(spark, path) == [3]
    with pytest.raises(GraphError, match="resync"):
        feed.operations(spark, path, [1, 2])
    with pytest.raises(GraphError, match="NOT_FOUND"):
        files.load(spark, path, 1)


def test_reader_behind(spark, tmp_path, people):
    """A subscription ends with an error if a commit between two of its batches is kept no more."""
    import json
    from types import SimpleNamespace

    from graphloom.streaming import feed

    held = {}

    class Writer:  # takes the function of a micro-batch, so that batches can be handed to it here
        def foreachBatch(self, f):
            held["f"] = f
            return self

        option = trigger = lambda self, *a, **k: self
        start = lambda self: None

    path = f"file://{tmp_path}/v"
    _versions(spark, people, path, ("A", "B", "C"))
    feed.deliver(SimpleNamespace(writeStream=Writer()), path, lambda b: b.count(), "")
    commits = [json.loads((tmp_path / "v" / "commits" / f"{i:012d}.json").read_text()) for i in (1, 2, 3)]
    batch = lambda m: spark.createDataFrame([(m["version"], m["ops"], m["after"])], "tx_id long, ops boolean, after long")
    held["f"](batch(commits[0]), 0)
    with pytest.raises(GraphError, match="resync"):
        held["f"](batch(commits[2]), 1)
    feed.deliver(SimpleNamespace(writeStream=Writer()), path, lambda b: b.count(), "")
    for i, m in enumerate(commits):
        held["f"](batch(m), i)


def test_replay(spark, people):
    """The log of a transaction, with creations, changes and deletions, makes the same graph of the old one."""
    t = Transaction(people)
    new = t.create_nodes("Person", spark.createDataFrame([("Grace", 1906), ("Alan", 1912)], "name string, born long"), "name")
    t.create_edges("KNOWS", new.select(F.col("id").alias("src"), F.lit(3).cast("long").alias("dst"), F.lit(0.5).alias("since")))
    t.set_props("Person", spark.createDataFrame([(3, None, [1.5])], "id long, born long, scores array<double>"))
    t.delete_nodes("Person", spark.createDataFrame([(1,)], "id long"), detach=True)
    after, again = t.commit(), replay(people, union(t.log))
    for label in ("Person", "Document"):
        columns = sorted(after.scan(label).columns)
        assert sorted(map(str, after.scan(label).select(columns).collect())) == sorted(map(str, again.scan(label).select(columns).collect()))
    for kind in ("KNOWS", "WROTE"):
        columns = after.edges[kind].df.columns
        assert sorted(map(str, after.edges[kind].df.collect())) == sorted(map(str, again.edges[kind].df.select(columns).collect()))


def test_merge_paths(spark, people):
    t = Transaction(people.with_index("unique", "Person", "name"))
    rows = spark.createDataFrame([("Ada", "Sketch")], "who string, what string")
    t.merge_path(rows, node("p", "Person", name=F.col("who")), hop("WROTE"), node("d", "Document", title=F.col("what")))
    with pytest.raises(GraphError, match="CONSTRAINT_VIOLATION"):  # the whole path is created, a second Ada too
        t.commit()
    t = Transaction(people)
    found = t.merge_path(match(people, node("p", "Person")).returns(lambda v: {"p": v.p.id}), node("d", "Document"), hop("WROTE", direction="in"), node("p", "Person"), on_create={"d.title": F.lit("untitled")}, on_match={"p.known": F.lit(True)})
    assert {(r["p"], r["d"], r["created"]) for r in found.collect()} == {(1, 4, False), (2, 5, False), (3, 6, True)}
    assert t.commit().check().count() == 0 and t.stats == {"created": 2, "deleted": 0, "props_set": 3}
    names_ = t.bound(found, p="Person", d="Document").where(lambda v: v.p.known == True).returns(lambda v: {"t": v.d.title})  # noqa: E712
    assert sorted(names(names_, "t")) == ["Notes on the Analytical Engine", "Sketch"]
    with pytest.raises(GraphError, match="SEMANTIC_ERROR"):
        t.merge_path(rows, node("p", "Person"), hop("WROTE", least=1, most=2), node("d", "Document"))


def test_validation(spark, people):
    t = Transaction(people)
    for bad in ([(1, float("nan"))], [(1, float("inf"))]):
        with pytest.raises(GraphError, match="VALIDATION"):
            t.set_props("Person", spark.createDataFrame(bad, "id long, x double"))
    with pytest.raises(GraphError, match="VALIDATION"):
        t.create_nodes("Person", spark.createDataFrame([("a", [1.0, float("nan")])], "name string, x array<double>"), "name")
    with pytest.raises(GraphError, match="VALIDATION"):
        t.create_edges("", spark.createDataFrame([(1, 2)], "src long, dst long"))
    with pytest.raises(GraphError, match="VALIDATION"):
        t.create_nodes("", spark.createDataFrame([("a",)], "name string"), "name")
    hub = spark.createDataFrame([(1, 2)] * 5, "src long, dst long")
    assert sorted(r["id"] for r in t.create_edges("LIKES", hub).collect()) == [4, 5, 6, 7, 8]


def test_limits_are_errors(spark):
    g = simple(spark, 4, [(0, 1, "E"), (1, 3, "E"), (0, 2, "E"), (2, 3, "E"), (3, 3, "E"), (3, 0, "E")])
    assert paths.all_shortest_paths(g, 0, 3, most=2).count() == 2
    assert paths.all_shortest_paths(g, 0, 0).count() == 1
    for f in (lambda: paths.all_shortest_paths(g, 0, 3, most=1), lambda: paths.cycles(g, limit=1), lambda: ranking.betweenness(g, guard=3)):
        with pytest.raises(GraphError, match="ROW_LIMIT"):
            f()
    assert paths.cycles(g).count() == 2
    assert ranking.betweenness(g, sample=2, guard=3).count() == 4


def test_import_in_batches(spark, people):
    nodes = spark.createDataFrame([(f"n{i:02}", ["A"], float(i)) for i in range(25)], "tempId string, labels array<string>, x double")
    edges = spark.createDataFrame([(f"n{i:02}", "1", "E") for i in range(25)], "from string, to string, type string")
    g, report = files.import_batches(people, nodes, edges, ["A"], ["E"], batch=10)
    assert (report.nodes, report.edges, report.error) == (25, 25, None) and g.check().count() == 0
    assert match(g, node("a", "A"), hop("E"), node("p", "Person", name="Ada")).df.count() == 25
    bad = nodes.withColumn("x", F.when(F.col("tempId") == "n13", float("nan")).otherwise(F.col("x")))
    g, report = files.import_batches(people, bad, edges, ["A"], ["E"], batch=10)
    assert (report.nodes, report.edges, report.at, report.error) == (10, 0, ("nodes", 1), "a number is not finite") and g.scan("A").count() == 10
    g, report = files.import_batches(people, nodes, edges.withColumn("to", F.when(F.col("from") == "n20", "99").otherwise("1")), ["A"], ["E"], batch=10)
    assert (report.nodes, report.edges, report.at) == (25, 20, ("edges", 2)) and g.edge_frame("E").count() == 20


def test_plans(spark):
    """Hops read the tables that their types lead to, a schema scans a table once, and files are opened when used."""
    from graphloom.sources.tables import table_graph

    g = table_graph(spark, "/root/testdata/sf0.001")
    read = lambda df: sorted({f.rsplit("/", 1)[-1].partition(".")[0] for f in df.inputFiles()})
    assert read(Traversal.nodes(g, "Customer").out("PLACED").df) == ["customer", "orders"]
    assert read(Traversal.nodes(g, "Purchase").out_edges("HAS_PART").to_node().df) == ["lineitem", "orders", "part"]
    one = PropertyGraph({"Customer": g.nodes["Customer"]}, {})
    assert schema.property_types(one)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert set(table_graph(spark, "/nowhere").nodes) == set(g.nodes)
    t = Traversal.nodes(g, "Part").where(lambda r: (r.size > "4") | (r.missing == 1))
    assert t.count() == 0 and Traversal.nodes(g, "Part").where(lambda r: ~(r.size == "4")).count() == Traversal.nodes(g, "Part").count()


def test_csv_quotes(spark, tmp_path):
    (tmp_path / "n.csv").write_text('tempId,:label,name:string,born:number,active:boolean\n1,Person|Author,"Ada, ""A""\nof two lines",1815,true\n2,Person,Bob,,\n')
    rows = files.nodes_from_csv(files.read_csv(spark, f"file://{tmp_path}/n.csv")).collect()
    assert [tuple(r) for r in rows] == [("1", ["Person", "Author"], 'Ada, "A"\nof two lines', 1815.0, True), ("2", ["Person"], "Bob", None, None)]


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from graphloom.storage import shared_dir

    conf = SimpleNamespace(get=lambda key, default: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
