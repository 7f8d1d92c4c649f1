import random

import pytest
from pyspark.sql import functions as F

from strandloom import session
from strandloom.operators import clustering, kmer_graph


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def plain_unitigs(sequences, k):
    """Walks of strands one by one: sequence (a ring cut before its least k-mer) to its genomes."""
    have = {}
    for g, s in sequences:
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT"):
                have.setdefault(min(w, turned(w)), set()).add(g)
    strands = {t for x in have for t in (x, turned(x))}
    after = {t: [t[1:] + c for c in "ACGT" if t[1:] + c in strands] for t in strands}
    before = {t: [c + t[:-1] for c in "ACGT" if c + t[:-1] in strands] for t in strands}
    kmer = lambda t: min(t, turned(t))
    step = {t: n[0] for t, n in after.items() if len(n) == 1 and len(before[n[0]]) == 1 and kmer(n[0]) != kmer(t)}
    entered, seen, out = set(step.values()), set(), {}
    for head in sorted(strands - entered) + sorted(have):
        if kmer(head) in seen:
            continue
        path = [head]
        while path[-1] in step and step[path[-1]] != head:
            path.append(step[path[-1]])
        seen |= {kmer(t) for t in path}
        out[path[0] + "".join(t[-1] for t in path[1:])] = (len(path), len(set().union(*(have[kmer(t)] for t in path))))
    return out


def bases(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def random_genomes(seed):
    rng = random.Random(seed)
    whole = bases(rng, 900)
    rows = [(f"g{i}", "".join(bases(rng, 1) if rng.random() < 0.01 else c for c in whole)) for i in range(4)]
    rows += [("g1", turned(whole[100:400])), ("g2", bases(rng, 200, "AC")), ("g3", whole[:50] + "NN" + whole[50:90].lower()), ("g4", "ACG"), ("g4", ""), ("g4", None), (None, whole[:60])]
    ring = bases(rng, 300)
    return rows + [("g5", ring + ring[:40]), ("g6", "A" * 60), ("g6", turned(ring)[:20])]


@pytest.mark.parametrize("seed,k", [(1, 5), (2, 11), (3, 31), (4, 7)])
def test_unitigs_are_those_of_plain_walks(spark, monkeypatch, seed, k):
    monkeypatch.setattr(kmer_graph, "PIECE", 16)
    rows = random_genomes(seed)
    got = kmer_graph.unitigs(spark.createDataFrame(rows, "genome_id string, sequence string"), k).collect()
    want = plain_unitigs([(g, (s or "").upper()) for g, s in rows if g is not None], k)
    assert {r.sequence: (r.n_kmers, r.n_genomes) for r in got} == want and len(got) == len(want)


def test_a_ring_is_cut_before_its_least_kmer(spark):
    ring = bases(random.Random(9), 500)
    got = kmer_graph.unitigs(spark.createDataFrame([("a", ring + ring[:30]), ("b", turned(ring))], "genome_id string, sequence string"), 31).collect()
    kmers = {min(w, turned(w)) for i in range(500) for w in [(ring + ring)[i : i + 31]]}
    assert len(got) == 1 and got[0].n_kmers == 500 and got[0].n_genomes == 2 and got[0].sequence[:31] == min(kmers)


def test_rounds_follow_the_logarithm_of_the_longest_unitig(spark, monkeypatch):
    made, real = [], session.stored
    monkeypatch.setattr(kmer_graph, "stored", lambda df, name: (made.append(name), real(df, name))[1])
    text = bases(random.Random(5), 20_000)
    got = kmer_graph.unitigs(spark.createDataFrame([("a", text)], "genome_id string, sequence string"), 31).collect()
    assert [r.sequence in (text, turned(text)) for r in got] == [True] and made.count("walks") < 20


def test_statistics_and_empty_tables(spark):
    found = spark.createDataFrame([("A" * 100, 3), ("A" * 40, 1), ("A" * 31, 2), ("A" * 20, 2)], "sequence string, n_genomes long")
    row = kmer_graph.graph_statistics(found, 3).first()
    assert (row.num_unitigs, row.total_bases, row.n50, row.num_kmers, row.num_colors, row.color_complexity, row.avg_unitig_length) == (4, 191, 100, 70 + 10 + 1 + 1, 3, 2.0, 47.75)
    none = kmer_graph.unitigs(spark.createDataFrame([], "genome_id string, sequence string"), 31)
    assert none.count() == 0 and kmer_graph.graph_statistics(none, 0).first().num_unitigs == 0
    with pytest.raises(ValueError):
        kmer_graph.unitigs(none.select(F.lit("g").alias("genome_id"), "sequence"), 30)


def in_order(n, pairs):
    taken = set()
    for x in range(n):
        if not any(a in taken for a, b in pairs if b == x):
            taken.add(x)
    return taken


@pytest.mark.parametrize("seed", range(3))
def test_first_independent_rows_are_those_of_the_pass(spark, seed):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(90), 2))) for _ in range((60, 120, 400)[seed])}
    got = clustering.first_independent(spark.range(90).withColumnRenamed("id", "ord"), spark.createDataFrame(list(pairs), "a long, b long"))
    assert sorted(r.ord for r in got.collect()) == sorted(in_order(90, pairs))


def test_a_chain_is_decided_in_few_rounds(spark, monkeypatch):
    made, real = [], session.stored
    monkeypatch.setattr(clustering, "stored", lambda df, name: (made.append(name), real(df, name))[1])
    rows = spark.range(5000).withColumnRenamed("id", "ord")
    got = clustering.first_independent(rows, rows.where("ord > 0").selectExpr("ord - 1 AS a", "ord AS b"))
    assert sorted(r.ord for r in got.collect()) == list(range(0, 5000, 2)) and len(made) < 24


def test_kmers_without_colours_make_no_row_a_place(spark):
    df = spark.createDataFrame([("a", "ACGTTGCAAGGTNACCTGATTACA" * 3), ("b", "ACGTTGCAAGGTACC"), (None, "TTTTTTTTTTTT"), ("c", None)], "genome_id string, sequence string")
    got = kmer_graph.uncoloured(df, 11)
    rows = [r.kmer for r in got.collect()]
    assert sorted(rows) == sorted({r.kmer for r in kmer_graph.coloured(df, 11).collect()}) and "A" * 11 not in rows
    assert "Generate" not in got._jdf.queryExecution().toString()
