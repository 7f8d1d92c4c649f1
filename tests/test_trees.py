import itertools
import math
import random

import numpy as np
import pytest

from strandloom.operators import trees
from strandloom.operators.association import structured_association
from strandloom.sources import tables
from strandloom.sources.trees import nodes_of, tree_file, tree_nodes


def test_newick_texts():
    assert nodes_of("((a:1,'b c''s':2.5)ab:0.5,c[x:9]);") == [(0, None, None, None, 0), (1, 0, "ab", 0.5, 1), (2, 1, "a", 1.0, 2), (3, 1, "b c's", 2.5, 2), (4, 0, "c", None, 1)]
    assert [n[2] for n in nodes_of("\n(a ,\n b)r;\n")] == ["r", "a", "b"]
    assert nodes_of("a;") == [(0, None, "a", None, 0)]
    assert nodes_of("(a:x,:1e-2)r:0;") == [(0, None, "r", 0.0, 0), (1, 0, "a", None, 1), (2, 0, None, 0.01, 1)]
    assert all(nodes_of(t) == [] for t in (None, "", ";", "(a,b)", "(a,b;", "(a,b));", "a,b;"))
    deep = nodes_of("(" * 5000 + "a" + ")" * 5000 + ";")
    assert len(deep) == 5001 and deep[-1][2:] == ("a", None, 5000)


def test_tree_tables_and_files(spark, tmp_path):
    rows = tree_nodes(spark.createDataFrame([(1, "(a,b)r;"), (2, None), (3, "c;")], "tree int, value string")).collect()
    assert sorted((r["tree"], r["name"]) for r in rows) == [(1, "a"), (1, "b"), (1, "r"), (3, "c")]
    (tmp_path / "t.nwk").write_text("(a:1,\n b:2)r;\n")
    assert tree_file(spark, str(tmp_path / "t.nwk")).count() == 3


def test_parents_names_and_batches_of_small_trees(spark, monkeypatch):
    """A node carries its parent's name, so no join is needed; small trees leave a task together."""
    monkeypatch.setattr("strandloom.sources.trees.ROWS", 5)
    texts = [(k, f"((a{k}:1,b)x:2,c)r{k};") for k in range(9)] + [(9, None), (10, "a;")]
    rows = tree_nodes(spark.createDataFrame(texts, "tree int, value string")).select("tree", "name", "above").collect()
    assert sorted((r["tree"], r["name"], r["above"] or "") for r in rows) == sorted([x for k in range(9) for x in ((k, f"a{k}", "x"), (k, "b", "x"), (k, "x", f"r{k}"), (k, "c", f"r{k}"), (k, f"r{k}", ""))] + [(10, "a", "")])


def random_tree(rng, leaves):
    """Newick text of a tree in which nodes have two to four children."""
    parts = [f"g{k}:{rng.randrange(1, 9)}" for k in range(leaves)]
    while len(parts) > 1:
        n = min(len(parts), rng.randrange(2, 5))
        rng.shuffle(parts)
        parts = [*parts[n:], f"({','.join(parts[:n])}):{rng.randrange(1, 9)}"]
    return parts[0].rsplit(":", 1)[0] + ";"


def fewest_changes(nodes, present):
    """By trying all states of the inner nodes."""
    names = {n[0]: n[2] for n in nodes}
    parents = {n[0]: n[1] for n in nodes}
    inner = sorted({p for p in parents.values() if p is not None})
    best = None
    for states in itertools.product((0, 1), repeat=len(inner)):
        state = {**{k: int(names[k] in present) for k in names}, **dict(zip(inner, states))}
        n = sum(state[k] != state[p] for k, p in parents.items() if p is not None)
        best = n if best is None else min(best, n)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_changes_are_the_fewest(spark, monkeypatch, seed):
    monkeypatch.setattr(trees, "CELLS", 40)
    rng = random.Random(seed)
    text = random_tree(rng, 9)
    nodes = nodes_of(text)
    have = {f"c{k}": {f"g{i}" for i in range(9) if rng.random() < 0.5} | {"elsewhere"} for k in range(12)}
    have |= {"twin": have["c0"], "all": {f"g{i}" for i in range(9)}}
    presence = spark.createDataFrame([(c, g) for c, own in have.items() for g in sorted(own)], "cluster_id string, genome_id string")
    table = tree_nodes(spark.createDataFrame([(0, text)], "tree int, value string"))
    got = {r["node"]: r for r in trees.branch_changes(presence, table).collect()}
    assert sorted(got) == [n[0] for n in nodes if n[1] is not None]
    assert sum(r["gains"] + r["losses"] for r in got.values()) == sum(fewest_changes(nodes, own) for own in have.values())
    assert {(r["name"], r["length"]) for r in got.values()} == {(n[2], n[3]) for n in nodes if n[1] is not None}


def test_states_by_hand(spark):
    table = tree_nodes(spark.createDataFrame([(0, "((a:1,b:1)x:2,(c:1,d:1)y:2,e:3)r;")], "tree int, value string"))
    have = {"gained": "ab", "lost": "abce", "tip": "d", "none": "z"}
    presence = spark.createDataFrame([(c, g) for c, own in have.items() for g in own], "cluster_id string, genome_id string")
    got = {r["name"]: (r["gains"], r["losses"]) for r in trees.branch_changes(presence, table).collect()}
    assert got == {"x": (1, 0), "a": (0, 0), "b": (0, 0), "y": (0, 0), "c": (0, 0), "d": (1, 1), "e": (0, 0)}
    assert all(r["gains"] == r["losses"] == 0 for r in trees.branch_changes(presence.limit(0), table).collect())


def test_trees_that_cannot_be_used(spark):
    presence = spark.createDataFrame([("c", "a")], "cluster_id string, genome_id string")
    for text in ("(a,a)r;", "(a,b"):
        with pytest.raises(ValueError):
            trees.branch_changes(presence, tree_nodes(spark.createDataFrame([(0, text)], "tree int, value string"))).collect()


def test_rates_are_read_back(spark, tmp_path):
    branches = spark.createDataFrame([(1.0, 2, 1), (2.0, 4, 1), (4.0, 9, 3), (None, 50, 50)], "length double, gains long, losses long")
    rates = trees.change_rates(branches)
    x, gains, losses = np.array([1.0, 2, 4]), np.array([2, 4, 9]), np.array([1, 1, 3])
    rates.coalesce(1).write.csv(f"{tmp_path}/rates", header=True)
    row = tables.rates(spark, f"{tmp_path}/rates").first()
    assert row["gain_rate"] == pytest.approx(np.polyfit(x, gains, 1)[0]) and row["loss_rate"] == pytest.approx(np.polyfit(x, losses, 1)[0])
    assert row["alpha"] == pytest.approx(np.polyfit(x, gains + losses, 1)[1]) and row["r_squared"] == pytest.approx(np.corrcoef(x, gains + losses)[0, 1] ** 2)
    assert row["convergence"] == 1.0
    assert {r["parameter"]: r["value"] for r in trees.change_rates(branches.limit(0)).collect()}["convergence"] == 0.0


def ascent(y, x):
    """Log-likelihood and coefficients of a logistic fit by many small plain steps."""
    scale = np.linalg.eigvalsh(x.T @ x)[-1] / 4
    beta = np.zeros(x.shape[1])
    for _ in range(200_000):
        beta = beta + x.T @ (y - 1 / (1 + np.exp(-x @ beta))) / scale
    eta = x @ beta
    return (y * eta - np.log1p(np.exp(eta))).sum(), beta


def population(seed, n=40):
    rng = np.random.default_rng(seed)
    axes = {f"g{k:02}": tuple(rng.normal(size=2)) for k in range(n)}
    have = {f"c{j}": {g for g, a in axes.items() if rng.random() < 1 / (1 + math.exp(-a[0]))} for j in range(6)}
    have |= {"twin": have["c0"], "core": set(axes)}
    y = {g: int(rng.random() < (0.8 if g in have["c1"] else 0.3)) for g in axes}
    return axes, have, y


def frames(spark, have, y, kind="int"):
    presence = spark.createDataFrame([(c, g) for c, own in have.items() for g in sorted(own)] * 2, "cluster_id string, genome_id string")
    return presence, spark.createDataFrame([(g, "t", v) for g, v in y.items()], f"genome_id string, trait string, value {kind}")


@pytest.mark.parametrize("block", [500, 1 << 21])
def test_logistic_association_is_that_of_plain_steps(spark, monkeypatch, block):
    monkeypatch.setattr("strandloom.operators.association.BLOCK_NUMBERS", block)
    axes, have, y = population(3)
    got = {r["cluster_id"]: r for r in structured_association(*frames(spark, have, y), axes).collect()}
    values = np.array([y[g] for g in sorted(axes)])
    base = np.array([(1.0, *axes[g]) for g in sorted(axes)])
    none, _ = ascent(values, base)
    for c in ("c0", "c1", "c4"):
        fit, beta = ascent(values, np.column_stack((base, [float(g in have[c]) for g in sorted(axes)])))
        assert got[c]["lrt"] == pytest.approx(2 * (fit - none), abs=1e-6) and got[c]["effect"] == pytest.approx(beta[-1], abs=1e-5)
        assert got[c]["p_value"] == pytest.approx(math.erfc(math.sqrt((fit - none))), abs=1e-6)
    assert got["twin"]["lrt"] == got["c0"]["lrt"] and len(got) == len(have)
    assert (got["core"]["lrt"], got["core"]["p_value"], got["core"]["effect"], got["core"]["present"]) == (0.0, 1.0, 0.0, 40)


def test_a_pattern_that_separates_has_the_limit(spark):
    y = {f"g{k}": int(k < 4) for k in range(10)}
    presence, traits = frames(spark, {"same": {g for g, v in y.items() if v}, "half": {"g0", "g1"}}, y)
    got = {r["cluster_id"]: r for r in structured_association(presence, traits).collect()}
    none = 4 * math.log(0.4) + 6 * math.log(0.6)
    assert got["same"]["effect"] is None and got["same"]["lrt"] == pytest.approx(-2 * none, abs=1e-6)
    assert got["half"]["effect"] is None and got["half"]["lrt"] == pytest.approx(2 * (2 * math.log(2 / 8) + 6 * math.log(6 / 8) - none), abs=1e-6)


def test_continuous_association_is_least_squares(spark):
    axes, have, _ = population(5)
    rng = np.random.default_rng(1)
    y = {g: float(rng.normal() + 2 * (g in have["c2"]) + a[0]) for g, a in axes.items()}
    got = {r["cluster_id"]: r for r in structured_association(*frames(spark, have, y, "double"), axes, continuous=True).collect()}
    values, base = np.array([y[g] for g in sorted(axes)]), np.array([(1.0, *axes[g]) for g in sorted(axes)])
    rest = [np.linalg.lstsq(base, values, rcond=None)[1][0]]
    for c in ("c0", "c2"):
        x = np.column_stack((base, [float(g in have[c]) for g in sorted(axes)]))
        beta, left, *_ = np.linalg.lstsq(x, values, rcond=None)
        assert got[c]["effect"] == pytest.approx(beta[-1]) and got[c]["lrt"] == pytest.approx(40 * math.log(rest[0] / left[0]))
    assert got["c2"]["p_value"] < 1e-4 and got["core"]["p_value"] == 1.0


def test_genomes_without_values_or_axes_do_not_count(spark):
    axes, have, y = population(7)
    presence, traits = frames(spark, have, {**y, "g00": None, "unknown": 1})
    got = {r["cluster_id"]: r for r in structured_association(presence, traits, {g: a for g, a in axes.items() if g != "g01"}).collect()}
    assert {r["n"] for r in got.values()} == {38} and got["c0"]["present"] == len(have["c0"] - {"g00", "g01"})
    alike = spark.createDataFrame([(g, "t", 1) for g in axes], "genome_id string, trait string, value int")
    assert {r["p_value"] for r in structured_association(presence, alike, axes).collect()} == {1.0}
    assert structured_association(presence, alike.limit(0), axes).count() == 0 and structured_association(presence.limit(0), traits, axes).count() == 0
