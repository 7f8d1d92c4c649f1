import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import correction, recovery, shared, sketches


@pytest.mark.parametrize("tile", [3, 256])
def test_shared_counts_are_those_of_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(shared, "TILE", tile)
    rng = random.Random(tile)
    have = {f"o{i:02}": {rng.randrange(40) for _ in range(rng.randrange(25))} | {99} for i in range(11)} | {"none": {1000}}
    rows = [(i, o) for o, items in have.items() for i in items]
    got = {(r.a, r.b): r.shared for r in shared.shared_counts(spark.createDataFrame(rows + rows[:5], "item long, owner string")).collect()}
    assert got == {(a, b): len(have[a] & have[b]) for a in have for b in have if a < b and have[a] & have[b]}


def test_more_items_than_a_bitmap_has_bits(spark):
    n = 2 * shared.CHUNK + 10
    rows = spark.range(n).select(F.col("id").alias("item"), F.explode(F.array(F.lit("a"), F.when(F.col("id") % 3 == 0, "b").otherwise("c"))).alias("owner"))
    got = {(r.a, r.b): r.shared for r in shared.shared_counts(rows).collect()}
    assert got == {("a", "b"): len(range(0, n, 3)), ("a", "c"): n - len(range(0, n, 3))}
    assert shared.shared_counts(rows.limit(0)).count() == 0


def test_no_join_on_items(spark):
    rows = spark.createDataFrame([(i, o) for i in range(5) for o in "abc"], "item long, owner string")
    plan = shared.shared_counts(rows)._jdf.queryExecution().executedPlan().toString()
    assert "item" not in plan and {r.shared for r in shared.shared_counts(rows).collect()} == {5}


def bases(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def mutated(rng, s, share):
    out = []
    for c in s:
        x = rng.random()
        out.append(c if x > share else rng.choice(["", rng.choice("ACGT"), c + rng.choice("ACGT")]))
    return "".join(out)


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_identities_of_genomes(spark, monkeypatch):
    monkeypatch.setattr(sketches, "PIECE", 50)
    rng = random.Random(3)
    one = bases(rng, 900)
    texts = [("a", one), ("b", turned(one)), ("c", one[:400].lower()), ("d", bases(rng, 700)), ("d", "ACNNNT"), ("e", ""), ("e", None)]
    k = 9
    sets = {}
    for g, s in texts:
        s = (s or "").upper()
        sets.setdefault(g, set()).update(min(w, turned(w)) for w in (s[i : i + k] for i in range(len(s) - k + 1)) if set(w) <= set("ACGT"))
    df = spark.createDataFrame(texts, "genome_id string, sequence string")
    got = {(r.g1, r.g2): (r.shared, round(r.ani, 9), round(r.align_1, 9)) for r in sketches.genome_identities(df, k, 1).collect()}
    want = {}
    for a in sets:
        for b in sets:
            if a < b and (n := len(sets[a] & sets[b])):
                want[a, b] = (n, round(max(n / len(sets[a]), n / len(sets[b])) ** (1 / k), 9), round(n / len(sets[a]), 9))
    assert got == want and got["a", "b"][1] == 1.0
    few = {r.genome_id: r.n for r in sketches.sketches(df, k, 4).groupBy("genome_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert few["a"] == few["b"] and 0.15 * len(sets["a"]) < few["a"] < 0.35 * len(sets["a"])


def test_refound_is_a_search_of_everything(spark, monkeypatch):
    monkeypatch.setattr(recovery, "PIECE", 300)
    monkeypatch.setattr(recovery, "BLOCK", 2)
    rng = random.Random(5)
    genes = {f"g{i}": bases(rng, rng.choice([9, 12, 40, 90, 160])) for i in range(12)}
    contigs = []
    for k in range(4):
        parts = [mutated(rng, genes[f"g{i}"], rng.choice([0.0, 0.1, 0.25, 0.5])) for i in range(12) if rng.random() < 0.5]
        contigs += [(f"s{k}", "".join(bases(rng, rng.randrange(150)) + p for p in parts)), (f"s{k}", bases(rng, 20) + "A" * 400), (f"s{k}", "")]
    missing = [(g, f"s{k}") for g in genes for k in range(5)]
    got = correction.refound(spark.createDataFrame(missing * 2, "dst string, genome_id string"), spark.createDataFrame(list(genes.items()), "cluster_id string, sequence string"), spark.createDataFrame(contigs, "genome_id string, sequence string"))

    def distance(q, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(q, 1):
            new = [i]
            for j, x in enumerate(t, 1):
                new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    want = {(g, s) for g, s in missing if len(genes[g]) >= 10 and any(1 - distance(genes[g], t) / len(genes[g]) >= 0.7 for o, t in contigs if o == s and t)}
    rows = [(r.dst, r.genome_id) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and 5 < len(want) < 48


def test_numbered_kmers_are_those_of_the_texts(spark, monkeypatch):
    """Numbers, marks and texts of k-mers agree; no row is made for each place, so a long text costs no more a base than a short one."""
    monkeypatch.setattr(sketches, "BLOCK", 64)
    monkeypatch.setattr(sketches, "TABLES", 2)
    rng = random.Random(8)
    texts = [(g, bases(rng, n) + "n" + bases(rng, n).lower()) for g, n in (("a", 300), ("b", 40), ("c", 5), ("a", 90), (None, 60), ("d", 0))] + [("b", None)]
    df = spark.createDataFrame(texts, "genome_id string, sequence string")
    for k in (1, 7, 9, 11, 12, 31, 33):
        want = {(g, min(w, turned(w))) for g, s in texts for w in (((s or "").upper())[i : i + k] for i in range(len(s or "") - k + 1)) if set(w) <= set("ACGT")}
        rows = [(r.genome_id, r.kmer) for r in sketches.distinct_kmers(df, k).collect()]
        assert set(rows) == want and len(rows) == len(want)
    plan = sketches.sketches(df, 11, 1)._jdf.queryExecution().toString() + sketches.sketches(df, 21, 1)._jdf.queryExecution().toString()
    assert "Generate" not in plan
