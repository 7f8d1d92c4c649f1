import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm.components import connected_components
from strandloom.llm.embeddings import near_duplicate_vectors, op4_embedding_near_dedup
from strandloom.llm.minhash import near_duplicates, op7_minhash_near_dedup
from tests.llm.data import documents, empty, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute(rows, k):
    sets = [shingles(r.text, k) if r.doc_id is not None else frozenset() for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), r.doc_id)
    return sorted(str((r.doc_id, len(shingles(r.text, k)), None if r.doc_id is None else least[find(i)])) for i, r in enumerate(rows))


@pytest.mark.parametrize("k,seed", [(4, 1), (5, 2)])
def test_components_agree_with_all_pairs(spark, k, seed):
    rng = random.Random(seed)
    chain = prose(rng, 150).split()
    extra = []
    for i in range(40):  # a chain of small edits whose ends are far apart
        chain = list(chain)
        chain[rng.randrange(len(chain))] = f"e{i}"
        extra.append(" ".join(chain))
    docs = documents(spark, seed, extra)
    got = near_duplicates(docs, width=k).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(docs.collect(), k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_of_a_large_group(spark, monkeypatch):
    from strandloom.llm import minhash

    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 16)
    monkeypatch.setattr(minhash, "GROUP_BLOCK", 12)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 500)
    rng = random.Random(9)
    base = prose(rng, 80).split()
    extra = []
    for i in range(70):
        v = list(base)
        for _ in range(rng.randint(1, 5)):
            v[rng.randrange(len(v))] = f"x{rng.randrange(1000)}"
        extra.append(" ".join(v))
    docs = documents(spark, 3, extra)
    got = near_duplicates(docs).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(docs.collect(), 4)


def test_the_query(spark, tmp_path):
    docs = documents(spark, 4)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = op7_minhash_near_dedup(spark, f"file://{tmp_path}").collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(docs.collect(), 4)


def test_empty_documents(spark):
    assert near_duplicates(empty(spark)).count() == 0


def test_stars_settle_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    got = connected_components(edges).collect()
    assert len(got) == 201 and {r.component for r in got} == {0}


def test_vectors_agree_with_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows, centre = [], rng.standard_normal((30, 16))
    for i in range(260):
        v = centre[i % 30 if i < 120 else 0] + rng.standard_normal(16) * rng.choice([0.02, 0.1])
        rows.append((i, v.tolist(), int(i % 30 % 2)))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (301, rows[0][1], 0), (302, [2 * x for x in rows[0][1]], 0), (303, None, 0), (304, rows[0][1], None), (305, [0.0] * 16, 0), (306, [float("nan")] * 16, 0), (307, [None] + [1.0] * 15, 0), (308, [], 0), (309, rows[0][1][:8], 0), (None, rows[0][1], 1), (310, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, class_id long, component long")
    got = {r.vec_id: r for r in near_duplicate_vectors(df).collect() if r.vec_id is not None}
    good = {i: (v, lab) for i, v, lab in rows if i is not None and v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i in {r[0] for r in rows} - {None}}
    ids = sorted(good)
    for a in ids:
        for b in ids:
            (x, la), (y, lb) = good[a], good[b]
            if a != b and la == lb and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[a].add(b)
    assert {i: got[i].n_links for i in links} == {i: len(v) for i, v in links.items()}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i].component_id == min(seen) and got[i].kept == (i == min(seen))


def test_the_schedule_and_its_misses(spark):
    from strandloom.llm.embeddings import schedule

    sizes = spark.createDataFrame([(n,) for n in (2, 128, 129, 1000, 8000, 30_000, 1_000_000, 10**9)], "n long")
    bits, passes = schedule(F.col("n"), 0.98)
    got = {r.n: (r.b, r.p) for r in sizes.select("n", bits.alias("b"), passes.alias("p")).collect()}
    assert got[2] == got[128] == (0, 1) and got[129] == got[1000] == got[8000] == (4, 10) and got[30_000][0] == 5 and got[10**9][0] == 20
    same = 1 - np.arccos(0.98) / np.pi
    for n, (b, p) in got.items():
        assert b == 0 or (1 - same**b) ** p <= 1e-6 and p < 2**b and n / 2**b <= 1024


def test_the_query_over_labels_of_all_kinds(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((90, 8)).astype("f4")
    x[30:60] = x[:30] + rng.standard_normal((30, 8)).astype("f4") * 0.1
    rows = [(i, v.tolist(), i % 2 if i < 80 else None) for i, v in enumerate(x)] + [(200, x[0].tolist(), 0), (201, None, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.n_links for r in op4_embedding_near_dedup(spark, f"file://{tmp_path}").collect()}
    unit = {i: np.array(v, "f4").astype(float) for i, v, lab in rows if v and lab is not None}
    label = {i: lab for i, _, lab in rows}
    want = {i: sum(1 for j in unit if i in unit and i != j and label[i] == label[j] and unit[i] @ unit[j] / np.linalg.norm(unit[i]) / np.linalg.norm(unit[j]) >= 0.98) for i, *_ in rows}
    assert got == want and max(want.values()) >= 1


def test_empty_vectors(spark):
    assert near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("run,few", [(1024, 2000), (1024, 128), (100, 128)])
def test_a_dense_label_misses_no_pair(spark, monkeypatch, run, few):
    """As one run in blocks, and in passes of four and five key bits whose crowded runs are cut into blocks."""
    from strandloom.llm import embeddings

    monkeypatch.setattr(embeddings, "BLOCK_NUMBERS", 64 * 300)
    monkeypatch.setattr(embeddings, "RUN", run)
    monkeypatch.setattr(embeddings, "FEW", few)
    rng = np.random.default_rng(8)
    x = rng.standard_normal(64) * 5.4 + rng.standard_normal((2000, 64))
    x[1000:1400] = x[:400] + rng.standard_normal((400, 64)) * 0.5
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in near_duplicate_vectors(df, 0.985).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.985
    np.fill_diagonal(linked, False)
    assert linked.sum() >= 700 and {i: r.n_links for i, r in got.items()} == dict(enumerate(linked.sum(1).tolist()))
    least = np.arange(len(x))
    for _ in range(len(x)):
        lower = np.minimum(least, np.where(linked, least, len(x)).min(1))
        if (lower == least).all():
            break
        least = lower
    assert [got[i].component_id for i in range(len(x))] == least.tolist()
