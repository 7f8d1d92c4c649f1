"""Merkle manifest, source mixing and divergence audit against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandloom.llm import divergence, prefix
from strandloom.llm.divergence import audit, op13_source_divergence, words_of
from strandloom.llm.merkle import folded, merkle_manifest, op11_merkle_manifest, siblings
from strandloom.llm.mixing import WEIGHTS, hash_key, mix, n_words, op12_source_mixing, targets
from tests.llm.data import documents, empty, texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def corpus(seed, n=150):
    """Rows of uneven groups, with nulls, repeated ids, repeated rows and the greatest long."""
    rng = random.Random(seed)
    some = texts(seed)
    rows = [(i, rng.choice(some), rng.choice(["en", "en", "en", "de", "é", "", None]), rng.choice(["a", "a", "a", "b", "ü", "", None]), rng.choice([None, i, 2**63 - 1])) for i in range(n)]
    rows += [(n, "only one", "xx", "lone", 3), (3, "other text", "en", "a", 1), rows[5], rows[5], (None, "no id", "en", "a", 4), (None, None, None, None, None)]
    return rows


# --- merkle -----------------------------------------------------------------


def digest(row, more=0):
    i, text, lang, source, n = row
    n = n if n is None else n + more
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree(nodes, fanout):
    """The root, and each leaf's steps (left, right) from the leaf up."""
    steps = [[] for _ in nodes]
    level = [(h, [i]) for i, h in enumerate(nodes)]
    while len(level) > 1:
        above = []
        for at in range(0, len(level), fanout):
            run = level[at : at + fanout]
            for k, (_, under) in enumerate(run):
                for i in under:
                    steps[i].append(("".join(h for h, _ in run[:k]), "".join(h for h, _ in run[k + 1 :])))
            above.append((sha("".join(h for h, _ in run)), [i for _, under in run for i in under]))
        level = above
    return level[0][0], steps


def brute_manifest(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for g in names:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        built[g] = (own, *tree([digest(r) for r in own], fanout))
    root, above = tree([built[g][1] for g in names], fanout)
    out = []
    for k, g in enumerate(names):
        own, subroot, steps = built[g]
        for r, s in zip(own, steps):
            proof = s + above[k]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            acc = digest(r, int(hit))
            for left, right in proof:
                acc = sha(left + acc + right)
            out.append((r[0], digest(r), subroot, root, sha("".join(a + b for a, b in proof)), acc, acc == root))
    return sorted(map(str, out))


def test_the_manifest_query_agrees_with_plain_loops(spark, tmp_path):
    rows = corpus(3)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = op11_merkle_manifest(spark, f"file://{tmp_path}").collect()
    assert sorted(str(tuple(r)) for r in got) == brute_manifest(rows, 2)
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("fanout", [3, 16])
def test_wider_nodes(spark, fanout):
    rows = corpus(4, 60)
    more = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    found = merkle_manifest(spark.createDataFrame(rows, SCHEMA), fanout=fanout, presented={"n_chars": more})
    found = found.withColumn("acc", folded(F.coalesce("presented", "leaf"), "proof"))
    got = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings("proof"), 256), "acc", F.col("acc") == F.col("root"))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_manifest(rows, fanout)


def test_manifests_of_one_row_and_of_none(spark):
    assert merkle_manifest(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "x" * 3_000_000, None, "s", 2)], SCHEMA)
    row = merkle_manifest(one).first()
    assert row.leaf == row.subroot == row.root == digest((1, "x" * 3_000_000, None, "s", 2)) and row.proof == []
    with pytest.raises(ValueError):
        merkle_manifest(one, fanout=1)


def test_manifest_leaves_other_columns_out(spark):
    docs = spark.createDataFrame(corpus(5, 20), SCHEMA)
    more = docs.withColumns({c: F.lit(1) for c in ("tree", "place", "size", "hash", "row", "proof", "name", "id", "__tie", "__part", "__at", "n")})
    assert sorted(map(str, merkle_manifest(more).collect())) == sorted(map(str, merkle_manifest(docs).collect()))


def test_sums_before(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, rng.randrange(50)]), i) for i in range(400)]
    found = prefix.before(spark.createDataFrame(rows, "k long, v long").repartition(7), [F.col("k").asc_nulls_last(), F.col("v")], n=None, s=F.col("v")).collect()
    total = 0
    for at, r in enumerate(sorted(found, key=lambda r: (r.k is None, r.k or 0, r.v))):
        assert (r.n, r.s) == (at, total)
        total += r.v


# --- mixing -----------------------------------------------------------------


def brute_targets(sizes):
    """Targets by resharing round by round."""
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        whole = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / whole
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_the_mixing_query_agrees_with_plain_loops(spark, tmp_path):
    rows = corpus(6, 300)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = op12_source_mixing(spark, f"file://{tmp_path}").collect()
    assert sorted(map(str, got)) == sorted(map(str, op12_source_mixing(spark, f"file://{tmp_path}").collect()))
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = brute_targets(sizes)
    key = lambda i: int(hashlib.md5(f"mix-1:{'' if i is None else i}".encode()).hexdigest()[:15], 16)
    out = []
    for s in sizes:
        before, budget = 0, int(want[s] + 0.5)
        for i, n in sorted(((r[0], size(r[1])) for r in rows if r[3] == s), key=lambda x: (key(x[0]), x[0] is not None, x[0] or 0, x[1])):
            full = budget // sizes[s] if sizes[s] else 0
            out.append((i, n, sizes[s], round(want[s], 6), full * n + max(0, min(n, budget - full * sizes[s] - before))))
            before += n
    assert sorted(map(str, out)) == sorted(str((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken)) for r in got)
    assert all(0 <= r.taken <= 2 * r.size for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_those_of_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:03}": rng.choice([0, 1, rng.randrange(10), rng.randrange(10**6), rng.randrange(10**13)]) for i in range(40)}
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = brute_targets(sizes)
    assert all(got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-3) for s in sizes)
    assert all(got[s] <= 2 * sizes[s] for s in sizes)


def test_a_mix_by_other_sizes_and_epochs(spark):
    docs = spark.createDataFrame([(i, None, "en", f"s{i % 2}", i + 1) for i in range(10)], SCHEMA)
    got = mix(docs, size=F.col("n_chars"), weights=(1,), share=(3, 1), epochs=3).collect()
    assert all(r.taken == 3 * r.size == 3 * (r.doc_id + 1) for r in got)
    assert sum(r.taken for r in mix(docs, size=F.col("n_chars"), weights=(1, 9), share=(1, 2)).collect()) == pytest.approx(27.5, abs=1)


def test_mixing_edges(spark):
    assert mix(empty(spark)).count() == 0
    docs = spark.createDataFrame([(1, None, "en", "a", 1), (2, "", "en", None, 1), (None, "  \n ", "en", "a", 1)], SCHEMA)
    assert sorted((r.size, r.source_size, r.target, r.taken) for r in mix(docs).collect()) == [(0, 0, 0.0, 0)] * 3
    row = spark.createDataFrame([("a b\x0b\x0cc d \x1c e\x00 " + "z " * 500_000, 5)], "t string, i long").select(n_words(F.col("t")).alias("n"), hash_key(F.col("i"), "mix-1").alias("k")).first()
    assert row.n == 5 + 500_000 and row.k == int(hashlib.md5(b"mix-1:5").hexdigest()[:15], 16)
    base = documents(spark)
    more = base.withColumns({c: F.lit(1) for c in ("size", "key", "words", "start", "of", "weight", "target", "taken", "epochs", "__tie", "__part", "__at")})
    assert sorted(map(str, mix(more).collect())) == sorted(map(str, mix(base).collect()))


# --- divergence -------------------------------------------------------------


def brute_audit(rows, least):
    """Every group's probability of every kept term, and all sums in full."""
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                out += [(lang, s, part, t, v, k + 1) for k, (v, t) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return sorted(map(str, out))


def words_rows(seed, n=260):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "Über", "über", "naïve", "日本", "x", "don't", "a-b", "ı", "K", "😀", "é", *[f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "de", "", None, "rare"]) if i % 40 else "odd", rng.choice(["a", "a", "b", "ü", "", None, "c"])
        shift = {"a": 0, "b": 30, "ü": 60}.get(source, 90)
        rows.append((i, " ".join(vocabulary[(int(rng.expovariate(0.05)) + rng.choice([0, shift])) % len(vocabulary)] for _ in range(rng.randrange(60))) + rng.choice([".", " 12", "\n"]), lang, source, 1))
    return rows + [(None, None, "en", "silent", None), (None, "", "empty", "silent", None), (None, "", "empty", "other", None), rows[0], rows[0]]


def test_the_audit_query_agrees_with_plain_loops(spark, tmp_path):
    rows = words_rows(1)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert sorted(str(tuple(r)) for r in op13_source_divergence(spark, f"file://{tmp_path}").collect()) == brute_audit(rows, 10)


def test_a_crowded_sketch_and_small_pieces_change_nothing(spark, monkeypatch):
    rows = words_rows(2, 120)
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute_audit(rows, 4)
    assert sorted(str(tuple(r)) for r in audit(docs, least=4).collect()) == want
    monkeypatch.setattr(divergence, "SKETCH_BITS", 6)
    monkeypatch.setattr(divergence, "HELD_TERMS", 50)
    assert sorted(str(tuple(r)) for r in audit(docs, least=4).collect()) == want


def test_the_sketch_drops_only_rare_terms(spark):
    docs = spark.createDataFrame([("en", "s", f"common w{''.join(chr(97 + int(d)) for d in str(i))}") for i in range(3000)], "lang string, source string, text string")
    partial = divergence.partial_counts(docs)
    left = {r.term for r in divergence.possible(partial, divergence.frequent_slots(partial, 10)).collect()}
    assert "common" in left and len(left) < 30


def test_words_by_pieces():
    text = ("Ab ü-ß 12 " * 50 + "LONG" * 40 + " x").encode()
    whole = [w for part in words_of(text) for w in part]
    assert [w for part in words_of(text, 7) for w in part] == whole and whole[:3] == [b"ab", "ü".encode(), "ß".encode()] and whole[-1] == b"x"


def test_audit_edges(spark):
    assert audit(empty(spark)).count() == 0
    long = spark.createDataFrame([(1, "word other " * 300_000, "en", "a", 1), (2, "word", "en", "b", 1)], SCHEMA)
    assert sorted(str(tuple(r)) for r in audit(long, least=1).collect()) == brute_audit([tuple(r) for r in long.collect()], 1)
    base = documents(spark)
    more = base.withColumns({c: F.lit(1) for c in ("term", "n", "docs", "slot0", "slot", "word", "p", "q", "base", "item", "value", "rank", "total", "met", "terms")})
    assert sorted(map(str, audit(more, least=2).collect())) == sorted(map(str, audit(base, least=2).collect()))
