import inspect
import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import clustering, correction, features, graph

NODES = "cluster_id string, support long, is_paralog boolean, genomes array<string>, contig_end_genomes array<string>"


def nodes(spark, rows):
    return spark.createDataFrame([(c, s, False, ["g1"], e) for c, s, e in rows], NODES)


def edges(spark, pairs, support=1):
    return spark.createDataFrame([(min(a, b), max(a, b), ["g1"], support) for a, b in pairs], "src string, dst string, genomes array<string>, support long")


CHAIN = [("c1", "c2"), ("c2", "c3"), ("c3", "c4"), ("c1", "c5")]


def test_breadth_first_depths(spark):
    e = edges(spark, CHAIN)
    seed = spark.createDataFrame([("c1",)], "start string")
    assert {r.node for r in graph.bfs(e, seed, 1).collect()} == {"c1", "c2", "c5"}
    assert {r.node: r.depth for r in graph.bfs(e, seed, 3).collect()} == {"c1": 0, "c2": 1, "c5": 1, "c3": 2, "c4": 3}


def test_contamination_reaches_a_fixed_point(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")])
    n = nodes(spark, [("a", 1, []), ("b", 1, []), ("c", 5, []), ("d", 5, []), ("e", 5, [])])
    kept, wires = correction.remove_contamination(n, e, 2)
    assert {r.cluster_id for r in kept.collect()} == {"c", "d", "e"} and wires.count() == 2


def test_contig_ends_only(spark):
    e = edges(spark, [("a", "b"), ("c", "b")])
    n = nodes(spark, [("a", 1, ["g1"]), ("b", 9, []), ("c", 1, [])])
    assert {r.cluster_id for r in correction.prune_contig_ends(n, e, 2)[0].collect()} == {"b", "c"}


def test_misassembly(spark):
    n = nodes(spark, [("a", 1, ["g1"]), ("b", 100, []), ("c", 100, [])])
    e = edges(spark, [("a", "b"), ("b", "c")])
    assert {(r.src, r.dst) for r in correction.misassembled_edges(n, e, 2).collect()} == {("a", "b"), ("b", "c")}
    assert correction.misassembled_edges(n, e, 0).count() == 0


def test_merge_sums_support_and_rewires(spark):
    n = nodes(spark, [("a", 3, []), ("b", 7, []), ("c", 1, [])])
    e = edges(spark, [("a", "b"), ("a", "c")])
    m, w = graph.merge(n, e, edges(spark, [("a", "b")]))
    assert {(r.cluster_id, r.support) for r in m.collect()} == {("b", 10), ("c", 1)}
    assert [(r.src, r.dst) for r in w.collect()] == [("b", "c")]


def test_components(spark):
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(45)}
    parent = {i: i for i in range(60)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    e = edges(spark, [(f"n{a:02}", f"n{b:02}") for a, b in pairs])
    got = {r.cluster_id: r.component for r in graph.components(e).collect()}
    assert got == {f"n{i:02}": f"n{find(i):02}" for i in {x for p in pairs for x in p}}


def test_cycles_and_variable_nodes(spark):
    tri = [("a", "b"), ("b", "c"), ("a", "c")]
    assert {r.node for r in features.cycles(edges(spark, tri)).collect()} == {"a", "b", "c"}
    assert features.cycles(edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])).count() == 0
    flagged = lambda s: {r.cluster_id for r in features.highly_variable(nodes(spark, [(c, k, []) for c, k in zip("abc", s)]), edges(spark, tri), 1).where("is_highly_variable").collect()}
    assert flagged((10, 10, 5)) == set() and flagged((20, 20, 2)) == {"c"}


def test_greedy_clusters_agree_with_the_sequential_pass(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("ACGT") for _ in range(rng.randint(8, 24))) for _ in range(12)]
    seqs = []
    for _ in range(90):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            s[rng.randrange(len(s))] = rng.choice("ACGT")
        seqs.append("".join(s)[: len(s) - rng.randint(0, 2)])

    def identity(a, b):
        return sum(x == y for x, y in zip(a, b)) / min(len(a), len(b))

    for t in (0.8, 0.9):
        central, want = [], {}
        for i, s in enumerate(seqs):
            best = max(((identity(seqs[c], s), c) for c in central if abs(len(seqs[c]) - len(s)) / max(len(seqs[c]), len(s)) <= 1 - t + 1e-12 and identity(seqs[c], s) >= t), default=None)
            want[i] = i if best is None else best[1]
            if best is None:
                central.append(i)
        df = spark.createDataFrame(list(enumerate(seqs)), "ord long, sequence string")
        got = {r.ord: r.centroid for r in clustering.greedy_clusters(df, t).collect()}
        assert got == want


def test_refound_genes(spark):
    gene = "ACGTTGCAACGGTCATTGCA"
    missing = spark.createDataFrame([("a", "b", "g1"), ("a", "b", "g2")], "src string, dst string, genome_id string")
    contigs = spark.createDataFrame([("g1", "T" * 50 + gene[:9] + "T" + gene[10:] + "T" * 50), ("g2", "T" * 200)], "genome_id string, sequence string")
    seqs = spark.createDataFrame([("b", gene)], "cluster_id string, sequence string")
    assert [(r.dst, r.genome_id) for r in correction.refound(missing, seqs, contigs, 0.9).collect()] == [("b", "g1")]


def test_context_similarity(spark):
    ctx = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("b", "y", 2), ("c", "x", 1), ("c", "z", 1)], "start string, node string, depth int")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    got = {(r.a, r.b): r.similarity for r in correction.context_similarity(ctx, pairs).collect()}
    assert got[("a", "b")] == 1.0 and abs(got[("a", "c")] - 1 / 3) < 1e-9


def test_inversions_need_disjoint_genomes(spark):
    pairs = spark.createDataFrame([("a", "b", "g1"), ("b", "a", "g2"), ("c", "d", "g1"), ("d", "c", "g1")], "a string, b string, genome_id string")
    got = features.inversions(features.directed_edges(pairs)).collect()
    assert [(r.clusters, r.genomes, r.support) for r in got] == [(["a", "b"], ["g1", "g2"], 1)]


def test_expected_curve_is_the_mean_over_all_subsets(spark):
    from itertools import combinations

    from strandloom.operators import curves, matrix

    rng = random.Random(2)
    rows = [(f"c{c}", f"g{g}") for c in range(15) for g in range(6) if rng.random() < 0.5]
    p = spark.createDataFrame(rows, "cluster_id string, genome_id string")
    have = {}
    for c, g in rows:
        have.setdefault(c, set()).add(g)
    got = {r.k: (r.total, r.core) for r in curves.expected_curve(matrix.frequency_histogram(p), 6).collect()}
    for k in range(1, 7):
        subsets = [set(s) for s in combinations([f"g{i}" for i in range(6)], k)]
        total = sum(sum(bool(v & s) for v in have.values()) for s in subsets) / len(subsets)
        core = sum(sum(s <= v for v in have.values()) for s in subsets) / len(subsets)
        assert abs(got[k][0] - total) < 1e-9 and abs(got[k][1] - core) < 1e-9


def test_scaled_plane_keeps_distances(spark):
    from strandloom.operators import statistics

    pairs = spark.createDataFrame([("a", "b", 3.0), ("a", "c", 4.0), ("b", "c", 5.0)], "g1 string, g2 string, distance double")
    at = {n: (x, y) for n, x, y in statistics.scaled_plane(pairs, ["a", "b", "c"])}
    d = lambda p, q: sum((x - y) ** 2 for x, y in zip(at[p], at[q])) ** 0.5
    assert abs(d("a", "b") - 3) < 1e-4 and abs(d("a", "c") - 4) < 1e-4 and abs(d("b", "c") - 5) < 1e-4


def test_bands(spark):
    from strandloom.operators import matrix

    rows = [(c, f"g{i}") for c, n in (("a", 10), ("b", 10), ("c", 3), ("d", 1)) for i in range(n)]
    p = spark.createDataFrame(rows, "cluster_id string, genome_id string")
    assert {r.band: r.n_clusters for r in matrix.partition_summary(p).collect()} == {"core": 2, "shell": 1, "cloud": 1}
    assert matrix.core_threshold(5) == 5 and matrix.core_threshold(0) == 1 and matrix.core_threshold(100) == 99
    assert matrix.packed_counts(matrix.packed_rows(p)).where(F.col("cluster_id") == "a").first().n_genomes == 10


def test_queries_take_edges_of_one_genome(spark, monkeypatch):
    from strandloom.plans import graph_queries as q

    n = nodes(spark, [("a|1", 9, ["g1"]), ("b|1", 9, []), ("c|1", 9, []), ("d|1", 1, ["g1"]), ("e|2", 99, []), ("f|2", 99, [])])
    e = edges(spark, [("a|1", "b|1"), ("b|1", "c|1"), ("a|1", "c|1"), ("c|1", "d|1"), ("e|2", "f|2")])
    monkeypatch.setattr(q, "built", lambda s, d: (n, e))
    monkeypatch.setattr(q, "fine", lambda s, d: (n, e))  # what the two pruning queries read
    got = lambda name, *cols: {tuple(r[c] for c in cols) for r in q.QUERIES[name](spark, "").collect()}
    assert got("graph_components", "cluster_id", "component") == {(f"{x}|1", "a|1") for x in "abcd"} | {("e|2", "e|2"), ("f|2", "e|2")}
    for name in ("remove_contamination", "prune_contig_ends"):
        assert {x[0] for x in got(name, "cluster_id")} == {"a|1", "b|1", "c|1", "e|2", "f|2"}
    assert got("breadth_first", "node", "depth") == {("a|1", 0), ("b|1", 1), ("c|1", 1), ("d|1", 2)}
    assert got("gene_neighbourhood", "cluster_id", "depth") == got("breadth_first", "node", "depth")
    assert got("low_support_leaves", "cluster_id") == {("d|1",)}
    assert got("shared_neighbours", "a", "b") == {("a|1", "b|1"), ("a|1", "c|1"), ("a|1", "d|1"), ("b|1", "c|1"), ("b|1", "d|1")}
    two = edges(spark, [("a|1", "b|1"), ("b|1", "c|1"), ("a|1", "c|1"), ("b|1", "d|1"), ("a|1", "d|1")])
    monkeypatch.setattr(q, "built", lambda s, d: (n, two))
    assert {c for c, flag in got("highly_variable", "cluster_id", "is_highly_variable") if flag} == {"d|1"}


def test_trees_of_any_depth(spark):
    e = edges(spark, [(f"c{i}", f"c{i + 1}") for i in range(9)])
    assert {(r.node, r.parent, r.depth) for r in features.spanning_tree(e).collect()} == {(f"c{i}", f"c{i - 1}" if i else None, i) for i in range(10)}
    with pytest.raises(RuntimeError):
        features.spanning_tree(e, 9)
    assert inspect.signature(features.spanning_tree).parameters["rounds"].default is None


def plain_tree(pairs):
    """Breadth-first trees from each component's least id, the least parent of each node."""
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found = {}
    for root in sorted(near):
        if root in found:
            continue
        found[root], level = (None, 0, root), [root]
        while level:
            reached = sorted({y for x in level for y in near[x]} - found.keys())
            for y in reached:
                found[y] = (min(x for x in level if x in near[y]), found[level[0]][1] + 1, root)
            level = reached
    return found


def chains_and_rings(seed):
    """A few hubs joined by chains of many lengths, tails, rings, double edges of both kinds and a ring alone."""
    rng = random.Random(seed)
    pairs, fresh = [], iter(range(10**6))
    for _ in range(rng.randrange(4, 14)):
        at = a = f"h{rng.randrange(5)}"
        for _ in range(rng.randrange(0, 12)):
            at, last = f"{rng.choice('axz')}{next(fresh)}", at
            pairs.append((last, at))
        if rng.random() < 0.7:
            pairs.append((at, rng.choice([a, f"h{rng.randrange(5)}"])))
    ring = [f"r{i}" for i in range(rng.randrange(3, 9))]
    pairs += [*zip(ring, ring[1:]), (ring[-1], ring[0]), ("p", "q")]
    return [(a, b) for a, b in pairs if a != b or rng.random() < 0.3]


@pytest.mark.parametrize("seed", range(2))
def test_trees_of_chains_and_rings(spark, monkeypatch, seed):
    from strandloom.operators import distances

    monkeypatch.setattr(distances, "SHALLOW", 1)
    pairs = chains_and_rings(seed)
    got = {r.node: (r.parent, r.depth, r.root) for r in features.spanning_tree(edges(spark, pairs)).collect()}
    assert got == plain_tree(pairs)


def counted(monkeypatch, *modules):
    """The names of all tables written from now on: each round writes one at least."""
    import strandloom.session as session

    names = []

    def stored(df, name):
        names.append(name)
        return session.stored(df, name)

    for m in modules:
        monkeypatch.setattr(m, "stored", stored)
    return names


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    from strandloom.operators import distances

    pairs = [(f"c{i:05}", f"c{i + 1:05}") for i in range(4999)] + [("c00000", "c04999"), ("c01000", "side")]
    names = counted(monkeypatch, features, graph, distances)
    got = {r.node: (r.parent, r.depth, r.root) for r in features.spanning_tree(edges(spark, pairs)).collect()}
    assert got == plain_tree(pairs)
    assert sum(n in ("components", "arcs", "front") for n in names) < 60, names


def plain_cycles(pairs, most):
    tree, out = plain_tree(pairs), []
    for a, b in {(min(p), max(p)) for p in pairs if p[0] != p[1]}:
        if tree[a][0] == b or tree[b][0] == a:
            continue
        x, y, nodes = a, b, {a, b}
        while x != y:
            if tree[x][1] >= tree[y][1]:
                x = tree[x][0]
            else:
                y = tree[y][0]
            nodes |= {x, y}
        if 3 <= len(nodes) <= most:
            out.append(tuple(sorted(nodes)))
    return sorted(out)


@pytest.mark.parametrize("most", [8])
def test_cycles_follow_the_ways_up(spark, most):
    pairs = chains_and_rings(7) + chains_and_rings(8)
    got = {}
    for r in features.cycles(edges(spark, pairs), most=most).collect():
        got.setdefault(r.cycle, []).append(r.node)
    assert sorted(tuple(sorted(x)) for x in got.values()) == plain_cycles(pairs, most)


def plain_pruning(pairs, weak):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    gone = set()
    while True:
        now = {v for v, n in near.items() if v not in gone and v in weak and len(n - gone) == 1}
        if not now:
            return gone
        gone |= now


@pytest.mark.parametrize("seed", range(3))
def test_pruning_is_that_of_single_rounds(spark, monkeypatch, seed):
    monkeypatch.setattr(correction, "SINGLE", 1)
    rng = random.Random(seed)
    pairs = chains_and_rings(seed) if seed % 2 else []
    for t in range(8):  # trees of weak nodes, with one node in the middle or two
        size = rng.randrange(1, 12)
        pairs += [(f"t{t}_{i}", f"t{t}_{rng.randrange(max(0, i - 3), i)}") for i in range(1, size + 1)]
    pairs += [("l1", "l1"), ("l1", "l2"), ("l2", "l3"), ("m", "m")]
    ids = sorted({x for p in pairs for x in p})
    strong = {x for x in ids if rng.random() < 0.15 and not x.startswith("t")} | {x for x in ids if x.startswith("t1_") and rng.random() < 0.2}
    weak = spark.createDataFrame([(x,) for x in ids if x not in strong], "id string")
    found = correction.pruned(edges(spark, pairs), weak)
    assert {r.cluster_id for r in found.collect()} == plain_pruning(pairs, set(ids) - strong)


def test_a_long_tail_takes_few_rounds(spark, monkeypatch):
    rounds = counted(monkeypatch, correction)
    tail = [(f"t{i:05}", f"t{i + 1:05}") for i in range(10_000)] + [("t10000", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("t05000", "u1"), ("u1", "u2")]
    weak = spark.createDataFrame([(f"t{i:05}",) for i in range(10_001)] + [("u1",), ("u2",)], "id string")
    assert correction.pruned(edges(spark, tail), weak).count() == 10_003
    assert rounds.count("sides") < 20


def sequential(seqs, identity, lengths):
    """The greedy pass in order, one row at a time."""
    cents, out = [], {}
    for i, s in seqs:
        if not s:
            continue
        best = None
        for n, (j, c) in enumerate(cents):
            if abs(len(s) - len(c)) / max(len(s), len(c)) > 1 - lengths + 1e-12:
                continue
            got = sum(x == y for x, y in zip(s, c)) / min(len(s), len(c))
            if got >= identity and (best is None or got >= best[0]):
                best = (got, n, j)
        if best is None:
            cents.append((i, s))
            best = (1.0, len(cents) - 1, i)
        out[i] = (f"cluster_{best[1]}", best[2])
    return out


@pytest.mark.parametrize("identity,lengths", [(0.8, None), (0.8, 0.6), (0.7, 0.95)])
def test_greedy_clusters_are_those_of_the_pass_in_order(spark, identity, lengths):
    rng = random.Random(17)
    base = ["".join(rng.choice("ACGT") for _ in range(rng.randint(12, 30))) for _ in range(6)]
    seqs = []
    for i in range(150):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            s[rng.randrange(len(s))] = rng.choice("ACGT")
        seqs.append((i, "".join(s)[: rng.choice([99, 99, 20, 15])]))
    seqs += [(200 + i, rng.choice(seqs)[1]) for i in range(80)] + [(400, ""), (401, None)]
    got = clustering.greedy_clusters(spark.createDataFrame(seqs, "ord long, sequence string"), identity, lengths).collect()
    assert {r.ord: (r.cluster_id, r.centroid) for r in got} == sequential(seqs, identity, identity if lengths is None else lengths)


def test_copies_make_no_pairs(spark, monkeypatch):
    seen = []
    real = clustering.similar_pairs
    monkeypatch.setattr(clustering, "similar_pairs", lambda s, *a, **k: (seen.append(s.count()), real(s, *a, **k))[1])
    seqs = spark.range(3000).selectExpr("id AS ord", "repeat('ACGT', 20) AS sequence")
    got = clustering.greedy_clusters(seqs, 0.9)
    assert seen == [1] and got.count() == 3000 and got.select("cluster_id").distinct().count() == 1


def test_misassembly_by_mode_and_without_support(spark):
    assert [correction.misassembly_threshold("default", n) for n in (10, 200, 250, 1001)] == [2, 2, 3, 11] and correction.misassembly_threshold("sensitive", 500) == 0
    nodes = spark.createDataFrame([("a", 0, []), ("b", 50, []), ("c", 60, []), ("d", 5, ["g1"])], "cluster_id string, support long, contig_end_genomes array<string>")
    edges = spark.createDataFrame([("a", "b", ["g1"], 1), ("b", "c", ["g1"], 1), ("c", "d", ["g1"], 1)], "src string, dst string, genomes array<string>, support long")
    assert {(r.src, r.dst) for r in correction.misassembled_edges(nodes, edges, 2).collect()} == {("b", "c"), ("c", "d")}


def test_duplications_carry_the_nodes_support(spark):
    nodes = spark.createDataFrame([("a", 9, ["g1", "g2"])], "cluster_id string, support long, genomes array<string>")
    edges = spark.createDataFrame([("a", x, ["g1"], 1) for x in "bcd"], "src string, dst string, genomes array<string>, support long")
    assert [(r.kind, r.support) for r in features.duplications(nodes, edges).collect()] == [("duplication", 9)]


def test_refound_genes_reach_the_nodes(spark):
    gene = "ACGTTGCAAGGCTTAACCGG"
    nodes = spark.createDataFrame([("a", 2, ["g1", "g2"], 2), ("b", 1, ["g1"], 1), ("c", 1, ["g1"], 1)], "cluster_id string, support long, genomes array<string>, n_genomes long")
    edges = spark.createDataFrame([("a", "b", ["g1"], 1), ("b", "c", ["g1"], 1)], "src string, dst string, genomes array<string>, support long")
    presence = spark.createDataFrame([("a", "g1"), ("a", "g2"), ("b", "g1"), ("c", "g1")], "cluster_id string, genome_id string")
    seqs = spark.createDataFrame([("a", "TTTTTTTTTTTTTTTTTT"), ("b", gene), ("c", "GGGGG")], "cluster_id string, sequence string")
    contigs = spark.createDataFrame([("g1", "c1", "A" * 30), ("g2", "c1", "A" * 40 + gene[:9] + "T" + gene[10:] + "C" * 40)], "genome_id string, contig string, sequence string")
    out, grown = correction.recover_missing(nodes, edges, presence, seqs, contigs)
    assert {r.cluster_id: (r.support, r.genomes, r.n_genomes) for r in out.collect()} == {"a": (2, ["g1", "g2"], 2), "b": (2, ["g1", "g2"], 2), "c": (1, ["g1"], 1)}
    assert {(r.cluster_id, r.genome_id) for r in grown.collect()} == {("a", "g1"), ("a", "g2"), ("b", "g1"), ("b", "g2"), ("c", "g1")}
    twice = edges.unionByName(spark.createDataFrame([("a", "b", ["g1"], 1)], edges.schema).selectExpr("'a2' AS src", "dst", "genomes", "support"))
    more = presence.unionByName(spark.createDataFrame([("a2", "g2")], presence.schema))
    kept, _ = correction.recover_missing(nodes, twice, more, seqs, contigs, consensus=True)
    assert {r.cluster_id for r in kept.collect()} == {"a", "c"}  # b is refound over two edges, more than its support


def family_graph(spark):
    rng = random.Random(23)
    gene = "".join(rng.choice("ACGT") for _ in range(200))
    near = gene[:150] + ("A" if gene[150] != "A" else "C") + gene[151:]
    far = gene[:4] + "".join(rng.choice("ACGT") for _ in range(196))
    seqs = {"a": gene, "b": near, "c": far, "x": "GGGG" * 40, "y": "TTTT" * 30}
    nodes = spark.createDataFrame([(k, s, [f"g{s}"], 1, k in "abc", ["n"]) for k, s in (("a", 5), ("b", 2), ("c", 3), ("x", 4), ("y", 4))], "cluster_id string, support long, genomes array<string>, n_genomes long, is_paralog boolean, annotations array<string>")
    edges = spark.createDataFrame([("a", "x", ["g5"], 1), ("b", "x", ["g2"], 1), ("c", "x", ["g3"], 1), ("c", "y", ["g3"], 1)], "src string, dst string, genomes array<string>, support long")
    return nodes, edges, spark.createDataFrame(list(seqs.items()), "cluster_id string, sequence string")


def test_mistranslations_and_families_merge_into_the_better_supported_node(spark):
    nodes, edges, seqs = family_graph(spark)
    for merged, wired in (correction.correct_mistranslations(nodes, edges, seqs), correction.collapse_families(nodes, edges, seqs)):
        assert {r.cluster_id: (r.support, r.genomes) for r in merged.collect()} == {"a": (7, ["g2", "g5"]), "c": (3, ["g3"]), "x": (4, ["g4"]), "y": (4, ["g4"])}
        assert {(r.src, r.dst): r.genomes for r in wired.collect()} == {("a", "x"): ["g2", "g5"], ("c", "x"): ["g3"], ("c", "y"): ["g3"]}


def test_mistranslations_stay_apart_beyond_three_steps(spark):
    nodes, edges, seqs = family_graph(spark)
    chain = spark.createDataFrame([("a", "p", ["g"], 1), ("p", "q", ["g"], 1), ("q", "r", ["g"], 1), ("b", "r", ["g"], 1)], edges.schema)
    assert correction.correct_mistranslations(nodes, chain, seqs)[0].count() == 5
    assert correction.collapse_families(nodes, chain, seqs)[0].count() == 5  # no shared neighbour


def test_paralogs_merge_by_distance_or_context(spark):
    nodes, edges, seqs = family_graph(spark)
    touching = edges.unionByName(spark.createDataFrame([("a", "b", ["g2"], 1)], edges.schema))
    assert {r.cluster_id: r.support for r in correction.resolve_paralogs(nodes, touching, seqs)[0].collect()} == {"a": 7, "c": 3, "x": 4, "y": 4}
    assert correction.resolve_paralogs(nodes, edges, seqs)[0].count() == 5  # two steps apart: 1/3
    short = seqs.selectExpr("cluster_id", "CASE WHEN cluster_id = 'b' THEN substr(sequence, 1, 100) ELSE sequence END AS sequence")
    assert correction.resolve_paralogs(nodes, touching, short)[0].count() == 5  # lengths too far apart
