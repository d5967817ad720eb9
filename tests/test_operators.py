"""Small cases with values worked out by hand, and random ones against plain loops."""

import random

from pyspark.sql import functions as F

from pulsegrain.functions import names
from pulsegrain.operators import classify, diff, dominators, gc, graph, heap, rank, stacks, symbols, temporal
from pulsegrain.sources import heap_bulk


def test_union_of_intervals(spark):
    spans = spark.createDataFrame([("a", 0.0, 10.0), ("a", 5.0, 20.0), ("a", 40.0, 50.0), ("a", 45.0, 45.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0)], "k string, s double, e double")
    for cell in (None, 7.0, 1000.0):
        assert {r.k: r.covered for r in temporal.union_length(spans, ["k"], "s", "e", cell).collect()} == {"a": 30.0, "b": 3.0}


def test_pairs_follow_the_stream_not_the_clock(spark):
    rows = [(1, 1, "start", 10.0), (2, 1, "start", 5.0), (3, 2, "stop", 6.0), (4, 1, "stop", 9.0), (5, 1, "stop", 11.0)]
    df = spark.createDataFrame(rows, "seq int, tid int, kind string, t double")
    got = temporal.pair_start_stop(df, ["tid"], "seq", F.col("kind") == "start", F.col("kind") == "stop", ["seq", "t"]).collect()
    assert [(r.tid, r.start_seq, r.stop_seq, r.start_t, r.stop_t) for r in got] == [(1, 2, 4, 5.0, 9.0)]


def test_asof_takes_the_nearest_before_and_the_first_of_ties(spark):
    left = spark.createDataFrame([(1, 10.0), (2, 3.0), (3, 100.0)], "adj int, at double")
    right = spark.createDataFrame([(5, 1, 8.0), (6, 1, 9.0), (7, 1, 9.0), (8, 1, 10.5), (9, 2, 6.9), (10, 2, 7.0)], "seq int, tid int, t double")
    got = temporal.asof_backward(left, right, "at", "t", 3.0, ["tid"], "adj", "seq", ["seq"]).collect()
    assert sorted((r.adj, r.tid, r.seq) for r in got) == [(1, 1, 6), (1, 2, 10)]


def test_range_join_is_the_nested_loop(spark):
    rng = random.Random(3)
    far = 1 << 41
    points = [(rng.randrange(500),) for _ in range(80)] + [(rng.randrange(-far, far),) for _ in range(300)]
    ranges = [(s, s + rng.randrange(0, 90), k) for k in range(40) for s in [rng.randrange(500)]]
    for k in range(40, 400):
        length = rng.randrange(1, 2 << rng.randrange(41))  # from one to 2**40 and more
        s = rng.choice(points)[0] - rng.randrange(length)
        ranges.append((s, s + rng.choice([length, 1 << length.bit_length()]), k))
    ranges += [(5, 5, 400), (7, 3, 401), (-(1 << 62), 1 << 62, 402)]
    left, right = spark.createDataFrame(points, "p long"), spark.createDataFrame(ranges, "s long, e long, k int")
    got = temporal.range_join(left, right, "p", "s", "e")
    assert sorted((r.p, r.k) for r in got.collect()) == sorted((p, k) for (p,) in points for s, e, k in ranges if s <= p < e)
    assert temporal.range_join(left, right.limit(0), "p", "s", "e").count() == 0
    keyed = temporal.range_join(left.withColumn("g", F.col("p") % 2), right.withColumn("g", F.col("k") % 2), "p", "s", "e", ["g"])
    assert keyed.count() == sum(s <= p < e and p % 2 == k % 2 for (p,) in points if p >= 0 for s, e, k in ranges) + sum(s <= p < e and -(-p % 2) == k % 2 for (p,) in points if p < 0 for s, e, k in ranges)


def test_a_large_range_is_listed_in_two_cells(spark):
    ranges = spark.createDataFrame([(100, 100 + (1 << 31), 1), (5, 6, 2)], "s long, e long, k int")
    met = temporal.range_join(spark.range(200).withColumnRenamed("id", "p"), ranges, "p", "s", "e")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 101 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_asof_is_the_nested_loop(spark):
    rng = random.Random(8)
    left = [(k, rng.choice([rng.uniform(0, 60), float(rng.randrange(60))])) for k in range(150)]
    right = [(k, rng.randrange(5), float(rng.randrange(60)) if k % 2 else rng.uniform(0, 60)) for k in range(200)]
    got = temporal.asof_backward(spark.createDataFrame(left, "adj int, at double"), spark.createDataFrame(right, "seq int, tid int, t double"), "at", "t", 2.0, ["tid"], "adj", "seq", ["seq"])
    want = []
    for adj, at in left:
        for tid in range(5):
            near = min(((at - t, seq) for seq, k, t in right if k == tid and 0 <= at - t <= 2.0), default=None)
            want += [(adj, tid, near[1])] if near else []
    assert sorted((r.adj, r.tid, r.seq) for r in got.collect()) == sorted(want)


def test_asof_groups_are_counted_without_the_pairs(spark):
    rng = random.Random(9)
    left = [(k, rng.choice([rng.uniform(0, 60), float(rng.randrange(60)), 7.001])) for k in range(150)] + [(150, None)]
    right = [(k, rng.randrange(8), rng.choice([None, 0, 1, 2]), rng.choice([float(rng.randrange(60)), rng.uniform(0, 60), 7.001])) for k in range(300)] + [(300, 1, 1, None)]
    le, ri = spark.createDataFrame(left, "adj int, at double"), spark.createDataFrame(right, "seq int, tid int, stack int, t double")
    met = temporal.asof_backward(le, ri, "at", "t", 4.0, ["tid"], "adj", "seq", ["stack"]).join(le, "adj")
    want = met.groupBy("at", "stack").agg(F.count_distinct("tid").alias("n"), F.min("tid"), F.min("matched_t")).collect()
    got = temporal.asof_groups(le, ri, "at", "t", 4.0, "tid", "seq", ["stack"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len(got) > 200
    # 20,000 threads seen at once by 20,000 times would be 400,000,000 pairs
    crowd = spark.range(20_000).select(F.col("id").alias("tid"), F.col("id").alias("seq"), F.lit(0).alias("stack"), (F.col("id") / 70).alias("t"))
    late = spark.range(20_000).select(F.col("id").alias("adj"), (F.col("id") / 70 + 1000).alias("at"))
    every = temporal.asof_groups(late, crowd, "at", "t", 5000.0, "tid", "seq", ["stack"]).groupBy("n", "first_tid", "oldest").count().collect()
    assert list(map(tuple, every)) == [(20_000, 0, 0.0, 20_000)]


def test_quantiles_of_groups_are_those_of_sorted_lists(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aaaaab"), float(rng.choice([7, rng.randrange(1000)]))) for _ in range(3000)] + [("c", 1.0), ("d", None), (None, 2.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    places = {"median": F.floor(F.col("n") / 2), "p99": F.least(F.floor(F.col("n") * 0.99), F.col("n") - 1), "low": F.lit(0)}
    got = {r.g: (r.n, r.median, r.p99, r.low) for r in rank.grouped_quantiles(df.filter("g IS NOT NULL"), ["g"], "v", places, F.monotonically_increasing_id()).collect()}
    want = {}
    for g in "abc":
        values = sorted(v for k, v in rows if k == g)
        n = len(values)
        want[g] = (n, values[n // 2], values[min(int(n * 0.99), n - 1)], values[0])
    assert got == want


def test_a_reused_address_belongs_to_the_method_of_its_time(spark):
    ranges = spark.createDataFrame([(100, 200, 0.0, 50.0, "old"), (100, 200, 50.0, None, "new"), (150, 180, 500.0, 600.0, "late")], "start long, end long, load double, unload double, name string")
    lookups = spark.createDataFrame([(150, 10.0), (150, 60.0), (150, 550.0), (99, 1.0), (200, 1.0)], "address long, t double")
    got = {(r.address, r.t): r.name for r in symbols.resolve(lookups, ranges).collect()}
    assert got == {(150, 10.0): "old", (150, 60.0): "new", (150, 550.0): "late", (99, 1.0): "<unresolved 0x63>", (200, 1.0): "<unresolved 0xC8>"}


def test_unloads_without_a_load_do_nothing(spark):
    rng = random.Random(9)
    rows, want = [], []
    for key in range(20):
        queue = []
        for seq in range(30):
            unload = rng.random() < 0.5
            rows.append((key, seq, unload))
            if not unload:
                queue.append(len(want))
                want.append([key, seq, None])
            elif queue:
                want[queue.pop(0)][2] = seq
    got = symbols.load_intervals(spark.createDataFrame(rows, "k int, seq int, un boolean"), "k", "seq", "un").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_quantile_takes_the_indexed_value(spark):
    values = [float(x) for x in range(250)] + [7.0] * 30
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for fraction in (0.0, 0.1, 0.5, 0.99, 1.0):
        assert rank.exact_quantile(df, "v", fraction) == sorted(values)[min(int(280 * fraction), 279)]
    assert rank.exact_quantile(df.limit(0), "v", 0.5) is None


def test_recursion_counts_once(spark):
    df = spark.createDataFrame([(["a", "b", "a"], 2), (["b"], 3), ([], 5)], "frames array<string>, w int")
    assert {r.frame: (r.self, r.total) for r in stacks.self_and_total(df, "frames", "w").collect()} == {"a": (2, 2), "b": (3, 5)}
    cats = stacks.by_category(df, "frames", "w", lambda f: F.upper(f)).collect()
    assert {r.category: (r.self, r.on_stack) for r in cats} == {"A": (2, 2), "B": (3, 5), "Uncategorized": (5, 5)}


def test_best_first_is_the_queue_walk(spark):
    rng = random.Random(2)
    rows = {tuple(rng.choice("abcd") for _ in range(rng.randint(1, 5))): rng.random() for _ in range(150)}
    nodes = stacks.fold(spark.createDataFrame([(list(k), v) for k, v in rows.items()], "frames array<string>, w double"), "frames", ["w"])
    weight = {tuple(r.path): r.w for r in nodes.collect()}
    children = {}
    for path in weight:
        children.setdefault(path[:-1], []).append(path)
    show = lambda p: sorted(children.get(p, []), key=lambda c: (-weight[c], c[-1]))[:3]
    want, queue = set(show(())), [c for t in show(()) for c in show(t)]
    for _ in range(20):
        if not queue:
            break
        best = max(queue, key=lambda c: weight[c])
        queue.remove(best)
        want.add(best)
        queue += show(best)
    got = {tuple(r.path) for r in stacks.best_first(nodes, "w", 3, 20).collect()}
    assert got == want


def reached(pairs, without=None):
    seen, todo, after = {0}, [0], {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    while todo:
        for b in after.get(todo.pop(), ()):
            if b != without and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_dominators_equal_removal(spark):
    """Random graphs, many of them with loops of several entries, side by side below one root."""
    rng = random.Random(11)
    pairs = set()
    for g in range(60):
        node = lambda k, g=g: 1 + 20 * g + k
        n = rng.choice([3, 6, 12])
        pairs |= {(node(rng.randrange(n)), node(rng.randrange(n))) for _ in range(2 * n)}
        pairs |= {(0, node(rng.randrange(n))) for _ in range(rng.randint(1, 2))}
    pairs |= {(5000, 5001), (5001, 5000), (5001, 5002), (5003, 1), (5002, 3)}  # not reached: a cycle, and a source
    whole = reached(pairs)
    above = {v: {v, 0} | {d for d in whole if d % 20 and (d - 1) // 20 == (v - 1) // 20 and v not in reached(pairs, d)} for v in whole}
    edges = spark.createDataFrame([(a, b) for a, b in pairs for _ in range(2)], "src long, dst long")
    got = {r.node: r.dominator for r in dominators.dominators(edges, 0).collect()}
    assert set(got) == whole and got.pop(0) is None
    for v, d in got.items():
        # the nearest dominator has all the others above it
        assert above[v] - {v} == above[d] | {d}, (v, d)


def test_a_long_chain_of_dominators_ends(spark):
    n = 5000
    rows = [(k, k + 1) for k in range(n)] + [(k, k + 3) for k in range(0, n - 3, 100)]  # every 100th step has a short cut
    edges = spark.createDataFrame(rows, "src long, dst long")
    got = dominators.dominators(edges, 0)
    by_node = {r.node: r.dominator for r in got.collect()}
    assert len(by_node) == n + 1 and all(by_node[k] == (k - 3 if k % 100 == 3 and k < n else k - 1) for k in range(1, n + 1))
    sizes = graph.retained_sizes(spark.range(n + 1).selectExpr("id AS node", "1L AS size"), got)
    kept_alive = {r.node: r.retained for r in sizes.collect()}
    want = dict.fromkeys(range(n + 1), 1)
    for k in range(n, 0, -1):
        want[by_node[k]] += want[k]
    assert kept_alive == want


def test_lowest_common_ancestors(spark):
    rng = random.Random(2)
    parent = {k: rng.randrange(max(0, k - 6), k) for k in range(1, 200)}
    up = lambda v: [v, *up(parent[v])] if v else [0]
    forest = spark.createDataFrame(list(parent.items()), "node long, parent long")
    tables = dominators.jump_tables(forest)
    groups = [(g, rng.randrange(200)) for g in range(100) for _ in range(rng.randint(1, 4))]
    members = spark.createDataFrame([(g, v, len(up(v)) - 1) for g, v in groups], "key long, node long, depth long")
    got = {r.key: r.ancestor for r in dominators.lowest_common(members, tables).collect()}
    for g in range(100):
        common = set.intersection(*(set(up(v)) for h, v in groups if h == g))
        assert got[g] == max(common, key=lambda v: len(up(v)))


def test_depth_first_places_are_those_of_a_walk(spark):
    rng = random.Random(7)
    parent = {k: rng.randrange(max(0, k - 9), k) for k in range(1, 150)}
    tree = spark.createDataFrame([(0, None, 0), *((k, p, -k % 5) for k, p in parent.items())], "node long, parent long, ordinal int")
    place, todo = {}, [0]
    while todo:
        v = todo.pop()
        place[v] = len(place)
        todo += sorted((k for k, p in parent.items() if p == v), key=lambda k: (-k % 5, k), reverse=True)
    assert {r.node: r.place for r in dominators.depth_first(tree).collect()} == place


def test_paths_merge_on_the_way_up_and_stop_at_their_budgets(spark):
    # root 0, two caches of type C, 30 strings below each, ten of them below a list of the first cache
    nodes = [(0, "root", 0), (1, "C", 1), (2, "C", 1), (3, "L", 1), *((10 + k, "S", 2) for k in range(60))]
    parents = [(0, None), (1, 0), (2, 0), (3, 1), *((10 + k, 3 if k < 10 else 1 + k % 2) for k in range(60))]
    df = spark.createDataFrame(nodes, "node long, type string, size long")
    pa = spark.createDataFrame(parents, "node long, parent long")
    path = lambda **more: {r.path: (r.depth, r.n, r.bytes) for r in graph.path_names(graph.root_paths(df, pa, **more)).collect()}
    assert path() == {
        "S": (0, 60, 120), "C": (0, 2, 2), "L": (0, 1, 1), "S<C": (1, 50, 100), "S<L": (1, 10, 20), "C<root": (1, 2, 2), "L<C": (1, 1, 1),
        "S<C<root": (2, 50, 100), "S<L<C": (2, 10, 20), "L<C<root": (2, 1, 1), "S<L<C<root": (3, 10, 20),
    }
    assert path(instances=20)["S<C"] == (1, 10, 20) and path(instances=20)["S<L"] == (1, 10, 20)
    assert max(d for d, _, _ in path(deepest=1).values()) == 1
    assert set(path(most=5)) == {"S", "C", "L", "S<C", "S<L"}
    only = spark.createDataFrame([("L",)], "type string")
    assert set(path(types=only)) == {"L", "L<C", "L<C<root"}


def test_paths_of_every_object_are_told(spark):
    # 25,000 objects of one type below a chain of 40 types
    nodes = spark.range(25_040).select(F.col("id").alias("node"), F.when(F.col("id") < 40, F.concat(F.lit("C"), F.col("id"))).otherwise("S").alias("type"), F.lit(2).cast("long").alias("size"))
    parents = nodes.select("node", F.when(F.col("node") > 0, F.least(F.col("node") - 1, F.lit(39))).alias("parent"))
    tree = graph.root_paths(nodes, parents, nodes.filter("type = 'S'").select("type").distinct()).collect()
    assert [(r.depth, r.type, r.n, r.bytes) for r in sorted(tree)] == [(d, f"C{40 - d}" if d else "S", 25_000, 50_000) for d in range(41)]


def test_nodes_of_one_parent_are_not_read_by_one_task(spark, monkeypatch):
    """Of 400 children of a node none is dealt by the hash of that node, however far the walks go, and results stay."""
    monkeypatch.setattr(dominators, "HEAVY", 50)
    parents = [(k, 0 if k < 5 else k % 4 + 1 if k < 405 else k - 400) for k in range(1, 805)]
    tree = spark.createDataFrame(parents, "node long, parent long")
    links = dominators._links(tree, "parent", tree.select(F.col("node").alias("parent"), F.col("parent").alias("above")))
    met = dominators._followed(tree, "parent", links)
    assert sorted(map(tuple, met.select("node", "parent", "above").collect())) == sorted((k, p, dict(parents).get(p)) for k, p in parents)
    assert max(r["__n"] for r in links.collect()) > 50
    placed, cyclic = dominators.anchors(tree)
    assert cyclic is None and {r.anchor for r in placed.collect()} == {0} and placed.count() == 804
    edges = spark.createDataFrame([(p, k, k) for k, p in parents], "src long, dst long, ordinal long")
    assert {(r.node, r.dominator) for r in dominators.dominators(edges, 0).collect()} == {*parents, (0, None)}


def test_bushes_are_folded_layer_by_layer(spark, monkeypatch):
    """Leaves below few nodes, and shared nodes whose predecessors part at the root, never get into jump tables; those of one branch have their common ancestor."""
    rows, tables = [], dominators.jump_tables
    monkeypatch.setattr(dominators, "jump_tables", lambda parents: rows.append(parents.count()) or tables(parents))
    parent = {k: 0 if k < 5 else k % 4 + 1 if k < 25 else k % 20 + 5 for k in range(1, 425)}
    branch = lambda v: v if v < 5 else branch(parent[v])
    shared = {1000 + k: [25 + k, 26 + k, 27 + k] for k in range(40)}
    assert all(len({branch(v) for v in among}) > 1 for among in shared.values())

    def run(shared, dominator):
        edges = [*((p, k) for k, p in parent.items()), *((v, k) for k, among in shared.items() for v in among * 2)]
        got = dominators.dominators(spark.createDataFrame(edges, "src long, dst long"), 0)
        assert {r.node: r.dominator for r in got.collect()} == dominator
        return got, dominator

    def keeps(got, dominator):
        nodes = spark.createDataFrame([(k, 1 + k % 7) for k in dominator], "node long, size long")
        want = {k: 1 + k % 7 for k in dominator}
        for k in sorted(dominator, reverse=True):
            if k:
                want[dominator[k]] += want[k]
        assert {r.node: r.retained for r in graph.retained_sizes(nodes, got).collect()} == want

    keeps(*run(shared, {0: None} | parent | dict.fromkeys(shared, 0)))
    assert sum(rows) == 0
    # 25 and 45 hang below one node, 25 and 29 below two nodes of one branch
    assert parent[25] == parent[45] and parent[25] != parent[29] and branch(25) == branch(29)
    run({1000: [25, 45], 1001: [25, 29], 1002: [25, 26]}, {0: None} | parent | {1000: parent[25], 1001: branch(25), 1002: 0})


def test_breadth_first_parent_is_the_first_discoverer(spark):
    edges = spark.createDataFrame([("r", "a", 0), ("r", "b", 1), ("b", "c", 0), ("a", "c", 1), ("c", "r", 0), ("c", "d", 1), ("x", "y", 0)], "src string, dst string, ordinal long")
    got = {r.node: (r.parent, r.depth) for r in graph.breadth_first(edges, "r").collect()}
    assert got == {"r": (None, 0), "a": ("r", 1), "b": ("r", 1), "c": ("a", 2), "d": ("c", 3)}


def test_census_counts_nested_types_once(spark):
    nodes = spark.createDataFrame([("r", "root", 0), ("a", "T", 10), ("b", "T", 5), ("c", "U", 1), ("z", "U", 7)], "node string, type string, size long")
    edges = spark.createDataFrame([("r", "a", 0), ("a", "b", 0), ("b", "c", 0)], "src string, dst string, ordinal long")
    got = {r.type: (r.n, r.exclusive, r.retained, r.max_retained, r.unreachable) for r in graph.census(nodes, dominators.dominators(edges, "r")).collect()}
    assert got == {"root": (1, 0, 16, 16, 0), "T": (2, 15, 16, 16, 0), "U": (2, 8, 1, 1, 1)}


def test_positional_edges_and_lost_events(spark):
    nodes = spark.createDataFrame([(0, 0, 100, 2), (0, 1, 101, 0), (1, 0, 102, 1)], "block int, pos int, address long, edge_count int")
    edges = spark.createDataFrame([(0, 0, 7), (0, 1, 8), (2, 0, 9)], "block int, pos int, target long")
    assert sorted(map(tuple, heap_bulk.attach_edges(nodes, edges).collect())) == [(100, 7), (100, 8), (102, 9)]
    try:
        heap_bulk.attach_edges(nodes, edges.limit(2))
    except ValueError:
        return
    raise AssertionError("a gap must be an error")


def test_gap_neighbours(spark):
    rows = [(1, 10, 5, False), (1, 20, 90, True), (1, 30, 90, True), (1, 40, 5, False), (1, 50, 9, True), (2, 60, 95, True)]
    df = spark.createDataFrame(rows, "segment int, address int, size int, is_free boolean")
    assert sorted((r.address, r.previous, r.following) for r in heap.gap_neighbours(df, 85).collect()) == [(20, 10, None), (30, 10, 40), (60, None, None)]


GC = "capture string, seq int, rel_ms double, kind string, gc_id int, generation int, reason int, type int, value long"


def walk(spark, events):
    rows = [("c", k, t, kind, i, g, why, how, v) for k, (t, kind, i, g, why, how, v) in enumerate(events)]
    random.Random(0).shuffle(rows)
    return {r.id: r for r in gc.correlate(spark.createDataFrame(rows, GC)).collect()}


def test_collections_pair_by_id_and_order_by_it(spark):
    got = walk(spark, [(0.0, "suspend", 0, 0, 1, 0, 0), (1.0, "start", 1, 0, 4, 0, 0), (3.0, "global_history", 0, 0, 7, 0, 0), (4.0, "end", 1, 0, 0, 0, 0), (4.5, "heap_stats", 0, 0, 0, 0, 900), (5.0, "restart", 0, 0, 0, 0, 0), (9.0, "start", 2, 0, 1, 0, 0)])
    assert list(got) == [1] and (got[1].pause_ms, got[1].heap_size, got[1].reason) == (5.0, 900, 7)


def test_a_slow_background_collection_beside_a_fast_one(spark):
    events = [
        (0.0, "suspend", 0, 0, 6, 0, 0), (0.5, "suspend_end", 0, 0, 0, 0, 0), (1.0, "start", 1, 2, 1, 1, 0), (2.0, "restart", 0, 0, 0, 0, 0), (10.0, "suspend", 0, 0, 1, 0, 0), (11.0, "start", 3, 0, 1, 0, 0),
        (11.5, "global_history", 0, 0, 5, 0, 0), (12.0, "heap_history", 0, 0, 0, 0, 0), (12.0, "heap_history", 0, 0, 0, 0, 1), (12.5, "heap_history", 0, 0, 0, 0, 1), (13.0, "end", 3, 0, 0, 0, 0), (13.5, "heap_stats", 0, 0, 0, 0, 300), (14.0, "restart", 0, 0, 0, 0, 0),
        (20.0, "suspend", 0, 0, 6, 0, 0), (23.0, "restart", 0, 0, 0, 0, 0), (40.0, "global_history", 0, 2, 9, 0, 0), (41.0, "heap_history", 0, 0, 0, 0, 7), (42.0, "heap_stats", 0, 0, 0, 0, 100), (50.0, "end", 1, 2, 0, 0, 0),
    ]
    got = walk(spark, events)
    assert sorted(got) == [1, 3]
    assert (got[3].pause_ms, got[3].heaps, got[3].heap_size, got[3].reason) == (4.0, 2, 300, 5)
    assert (got[1].pause_ms, got[1].heaps, got[1].heap_size, got[1].reason) == (5.0, 1, 100, 9)


def plain_walk(rows):
    """Collections of one capture by a walk through its events; see gc.correlate for the rules."""
    gcs, queues = {}, {}
    batch = ended = started = background = None
    pending = pending_end = susp = None
    restarted, firm = set(), set()
    for t, kind, i, generation, reason, how, value in rows:
        if kind == "start":
            begin = t if pending is None else pending
            gcs[i] = {"id": i, "generation": generation, "reason": reason, "type": how, "start_ms": t, "begin": begin, "pause_ms": 0.0, "end_ms": None, "heap_size": None, "heaps": set()}
            pending, started = None, i
            if how == gc.BACKGROUND:
                background = i
                if pending_end is not None:
                    gcs[i]["pause_ms"] = pending_end - begin
                    firm.add(i)
            queues.setdefault(generation, []).append(i)
        elif kind == "end":
            if i in gcs:
                gcs[i]["end_ms"] = t
                if i not in firm:
                    gcs[i]["pause_ms"] = t - gcs[i]["start_ms"]
            ended = i
            background = None if background == i else background
        elif kind == "heap_stats":
            for g in (batch, ended):
                if g in gcs and gcs[g]["heap_size"] is None:
                    gcs[g]["heap_size"] = value
                    break
        elif kind == "heap_history" and batch in gcs:
            gcs[batch]["heaps"].add(value)
        elif kind == "global_history":
            queue = queues.get(generation)
            batch = queue.pop(0) if queue else None
            if batch is not None:
                gcs[batch]["reason"] = reason
        elif kind == "suspend" and reason in (gc.FOR_GC, gc.FOR_PREPARATION):
            pending, susp = t, (t, reason)
        elif kind == "suspend_end":
            pending_end = t
        elif kind == "restart":
            if started is not None and started not in restarted:
                restarted.add(started)
                firm.add(started)
                gcs[started]["pause_ms"] = t - gcs[started]["begin"]
            elif background is not None and susp and susp[1] == gc.FOR_PREPARATION:
                gcs[background]["pause_ms"] += t - susp[0]
                firm.add(background)
            susp = None
    return {g["id"]: (g["generation"], g["reason"], g["type"], g["start_ms"], g["end_ms"], round(g["pause_ms"], 6), g["heap_size"], len(g["heaps"])) for g in gcs.values() if g["end_ms"] is not None}


def test_correlation_of_the_query_equals_a_plain_walk(spark):
    from pulsegrain.plans import threads

    events = threads.gc_events(spark, "/root/testdata/sf0.001")
    rng = random.Random(4)
    made = []
    for c in range(25):
        opened, open_ids = 0, []
        for k in range(80):
            kind = rng.choice(["start", "end", "suspend", "suspend_end", "restart", "restart", "heap_stats", "heap_history", "global_history", "global_history"])
            i = 0
            if kind == "start":
                opened += 1
                i = opened
                open_ids.append(i)
            elif kind == "end":
                if not open_ids:
                    continue
                i = open_ids.pop(rng.randrange(len(open_ids)))
            made.append((f"m{c}", k, float(k), kind, i, rng.randrange(3), rng.choice([1, 6, 6, 2]), int(rng.random() < 0.4), rng.randrange(5) if kind == "heap_history" else rng.randrange(1000)))
    fuzz = spark.createDataFrame(made, GC)
    for df in (fuzz, events):
        rows = {}
        for r in df.orderBy("rel_ms", "seq").collect():
            rows.setdefault(r.capture, []).append((r.rel_ms, r.kind, r.gc_id, r.generation, r.reason, r.type, r.value))
        want = {(c, i): v for c, x in rows.items() for i, v in plain_walk(x).items()}
        got = {(r.capture, r.id): (r.generation, r.reason, r.type, r.start_ms, r.end_ms, round(r.pause_ms, 6), r.heap_size, r.heaps) for r in gc.correlate(df).collect()}
        assert set(got) == set(want) and len(got) > 20
        assert got == want


def test_diff_keeps_both_sides_and_finite_rates(spark):
    a = spark.createDataFrame([("x", 2, 10.0), ("gone", 1, 1.0), ("zero", 1, 0.0)], "name string, n long, amount double")
    b = spark.createDataFrame([("x", 5, 30.0), ("new", 1, 4.0), ("zero", 1, 2.0)], "name string, n long, amount double")
    got = {r.name: (r.status, r.count_change, r.rate_change, r.percent_change) for r in diff.compare(a, b, 10.0, 20.0).collect()}
    assert got == {"x": ("matched", 3, 0.5, 200.0), "gone": ("removed", -1, -0.1, -100.0), "new": ("added", 1, 0.2, None), "zero": ("matched", 0, 0.1, None)}
    assert {r.rate_change for r in diff.compare(a, b, 0.0, 0.0).collect()} == {0.0}


def test_severity_limits(spark):
    rows = [(4.9, 1.0, 2.0, "none"), (5.0, 1.0, 2.0, "warn"), (10.0, 1.0, 2.0, "alert"), (1.0, 3.0, 2.0, "alert"), (1.0, 2.0, 2.0, "none")]
    df = spark.createDataFrame(rows, "p double, total double, d double, want string")
    assert df.filter(classify.share_severity(F.col("p"), F.col("total"), F.col("d")) != F.col("want")).count() == 0


def test_frames_names_and_medians(spark):
    df = spark.createDataFrame([(["System.Threading.Monitor.Enter", "App.Run"],), (["System.Threading.Monitor.Enter"],), ([],)], "f array<string>")
    is_lock = lambda f: classify.any_prefix(f, classify.LOCK_PREFIXES)
    assert [r[0] for r in df.select(classify.first_other_frame(F.col("f"), is_lock)).collect()] == ["App.Run", "System.Threading.Monitor.Enter", "<no stack captured>"]
    one = spark.createDataFrame([("_ZN3foo3barEv", "[lib] void a::b(int)[Tier1]", "Dictionary`2[A,List`1[B]]", "x.y(z.w)")], "a string, b string, c string, d string")
    q, m = names.qualifier_and_member(F.col("d"))
    assert tuple(one.select(names.demangled("a"), names.perf_map_name(F.col("b")), names.generic_name(F.col("c")), q, m).first()) == ("foo::bar", "a.b", "Dictionary<A,List<B>>", "x", "y(z.w)")
    assert spark.range(1).select(gc.median_by_text(F.array(*map(F.lit, [9.0, 10.0, 11.0])))).first()[0] == 11.0
