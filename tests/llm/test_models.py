import math
import random
import re
import struct
import zlib

import numpy as np
import xxhash

from strandloom.llm import toxicity
from strandloom.llm.boosting import Boosted, Isotonic
from strandloom.llm.quality import STATISTICS, QuadraticDiscriminant, op8_quality_classifier, score_quality, statistics
from strandloom.llm.toxicity import FEATURES, Features, op9_toxicity, score_toxicity
from tests.llm.data import documents, empty, prose

LABELS = "doc_id long, quality int, toxic int, score double"


def labelled(spark, n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        toxic, good = i % 4 == 0, i % 3 != 0
        words = prose(rng, 60).split()
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "grumbax", "velpino", "velpaka"])
        if not good:
            words = [w + rng.choice(["%%%", "&&&", "$$$"]) for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic), 0.0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)


def held_out_accuracy(scored, labels, column):
    want = {r.doc_id: r[column] for r in labels.collect()}
    rows = [r for r in scored.collect() if r.held_out]
    assert rows and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    return sum(r.predicted == want[r.doc_id] for r in rows) / len(rows)


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    assert held_out_accuracy(score_quality(docs, labels), labels, "quality") > 0.97


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    assert held_out_accuracy(score_toxicity(docs, labels), labels, "toxic") > 0.95


def test_hard_rows_and_missing_labels(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(None, 1, 1, 0.0), (3, None, None, 0.0), (4, 5, 5, 0.0), (5, 1, 1, 0.0), (5, 0, 0, 0.0)], LABELS)
    for score in (score_quality, score_toxicity):
        for labels in (none, odd):
            rows = score(docs, labels).collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
            assert all(r.held_out for r in rows if r.doc_id is None)
        assert score(empty(spark), none).count() == 0


def test_features_of_empty_and_odd_texts():
    for t in ("", "   ", "a", "%%%", "\n\n", "é" * 10_000):
        assert len(statistics(t)) == len(STATISTICS) and np.isfinite(statistics(t)).all()
        made = Features(np.zeros(1 << toxicity.SLOT_BITS, dtype="f4"))(t)
        assert len(made) == len(FEATURES) and np.isfinite(made).all()


def test_discriminant_recovers_two_normals():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (500, 3)), rng.normal(1.5, 2, (500, 3))])
    y = np.repeat([0, 1], 500)
    n = np.array([500.0, 500.0])
    sums = np.array([x[y == c].sum(axis=0) for c in (0, 1)])
    prods = np.array([x[y == c].T @ x[y == c] for c in (0, 1)])
    s = QuadraticDiscriminant.fit(n, sums, prods).score(x)
    assert ((s >= 0.5) == y).mean() > 0.8
    assert QuadraticDiscriminant.fit(np.array([1.0, 5.0]), sums, prods) is None


def test_boosting_and_isotonic():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = Boosted.fit(x, y).margin(x)
    assert ((m > 0) == y).mean() > 0.97
    iso = Isotonic.fit(np.array([0.0, 1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    out = iso(np.linspace(-1, 5, 40))
    assert (np.diff(out) >= 0).all() and out[0] == 0 and out[-1] == 1


def tables(spark, folder):
    docs, labels = labelled(spark, 300)
    odd = spark.createDataFrame([(900, None), (901, ""), (None, "an idiot"), (902, "é" * 3000), (903, "IDIOT you idiot!!! a.b.c.d sooo b4d")], "doc_id long, text string")
    docs.unionByName(odd).write.parquet(f"{folder}/documents.parquet")
    labels.select("doc_id", "quality", "toxic").write.parquet(f"{folder}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.unionByName(odd).collect()]
    return rows, {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_the_quality_query_agrees_with_numpy(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows, labels = tables(spark, folder)
    got = {r.doc_id: r for r in op8_quality_classifier(spark, folder).collect()}
    x = {i: np.array(statistics(t or "")) for i, t in rows}
    learned = [i for i in labels if crc(i, 3) != 1]
    own = [np.array([x[i] for i in learned if labels[i][0] == c]) for c in (0, 1)]
    pooled = sum(((o - o.mean(0)) ** 2).sum(0) for o in own) / len(learned)
    scale = 1 / np.sqrt(np.maximum(pooled, 1e-9))
    density = []
    for o in own:
        cov = np.cov(o.T, bias=True) * np.outer(scale, scale)
        weight = max(0.1, min(1.0, cov.shape[0] / len(o)))
        cov = (1 - weight) * cov + (weight + 1e-6) * np.eye(len(cov))
        z = [(x[i] - o.mean(0)) * scale for i, _ in rows]
        density.append(np.array([-0.5 * v @ np.linalg.solve(cov, v) for v in z]) - 0.5 * np.linalg.slogdet(cov)[1])
    margin = density[1] - density[0] + math.log(len(own[1]) / len(own[0]))
    assert len(got) == len(rows)
    for (i, _), m in zip(rows, margin):
        want = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
        assert abs(got[i].score - want) < 1e-6 and got[i].predicted == int(got[i].score >= 0.5) and got[i].held_out == (i is None or crc(i, 3) == 1)


def plain_features(text, lexicon):
    """Word by word, with no cache and no arrays."""
    words = re.findall(r"\w+", text or "")
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    odds = []
    for w in words:
        w = w.lower()
        best = max([0.0] + [lexicon.get(t, 0.0) for t in (w, w[:4] + "-" if len(w) > 4 else w, w[:5] + "-" if len(w) > 5 else w)])
        odds.append(max(best, 4.0) if w in toxicity.INSULTS else best)
    hits = [k for k, o in enumerate(odds) if o > 0]
    people = [k for k, w in enumerate(words) if w.lower() in toxicity.SECOND_PERSON]
    insults = sum(w.lower() in toxicity.INSULTS for w in words)
    near = sum(any(abs(h - p) <= toxicity.NEAR for p in people) for h in hits)
    mixed = sum(any(c.isdecimal() for c in w) and any(c.isalpha() for c in w) for w in words)
    odd = sum(1 for c in text if not re.match(r"[\w\s]", c))
    return [math.log1p(n), len(hits), len(hits) / n, sum(odds), sum(odds) / math.sqrt(n), max(odds), insults, insults / n, near, len(people) / n, sum(c.isupper() for c in text) / len(text),
            sum(len(w) > 2 and w.isupper() for w in words) / n, text.count("!") / n, odd / len(text), len(re.findall(r"(\w)\1\1", text)) / n, mixed / n, len(re.findall(r"\w[@$*#]\w", text)) / n,
            len(re.findall(r"(?:\b\w\b[ .\-]){3,}", text)) / n, len({words[h].lower() for h in hits})]


def plain_lexicon(rows):
    terms = [{t for w in re.split(r"[^\w]+", (text or "").lower()) if w for t in (w, *(w[:k] + "-" for k in (4, 5) if len(w) > k))} for text, _ in rows]
    toxic, out = sum(y for _, y in rows), {}
    for t in set().union(*terms):
        a, n = sum(y for (_, y), own in zip(rows, terms) if t in own), sum(t in own for own in terms)
        odds = math.log(((a + 0.1) / (toxic + 0.2)) / ((n - a + 0.1) / (len(rows) - toxic + 0.2)))
        if a >= 4 and odds > 2.5:
            out[t] = float(np.float32(odds))
    return out


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def test_the_toxicity_query_agrees_with_plain_loops(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows, labels = tables(spark, folder)
    got = {r.doc_id: r for r in op9_toxicity(spark, folder).collect()}
    texts = {i: t for i, t in rows}
    part = {}
    for i in labels:
        if crc(i, 5):
            first = xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
            part[i] = signed(xxhash.xxh64_intdigest(struct.pack("<i", 7), first)) % 10
    lexicon = plain_lexicon([(texts[i], labels[i][1]) for i in part if part[i] < 5])
    x = {i: plain_features(t, lexicon) for i, t in rows}
    tree, rest = [i for i in sorted(part) if 5 <= part[i] < 8], [i for i in sorted(part) if part[i] >= 8]
    model = Boosted.fit(np.array([x[i] for i in tree]), np.array([float(labels[i][1]) for i in tree]))
    pos = sum(labels[i][1] for i in rest)
    calibrated = pos >= 20 and len(rest) - pos >= 20

    def margin(v):
        out = model.base
        codes = [int(sum(e <= a for e in edges)) for edges, a in zip(model.edges, v)]
        for feature, cut, value in model.trees:
            node = 0
            while node < len(feature) and feature[node] >= 0:
                node = 2 * node + 1 + (codes[feature[node]] > cut[node])
            out += value[node]
        return out

    assert len(got) == len(rows) and not calibrated
    for i, _ in rows:
        assert abs(got[i].score - 1 / (1 + math.exp(-margin(x[i])))) < 1e-6, i
        assert got[i].predicted == int(got[i].score >= 0.5) and got[i].held_out == (i is None or crc(i, 5) == 0)
    hits = [t for t in ("grumbax", "velp-", "velpi-") if t in lexicon]
    assert hits, "beginnings of words are learned too"


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(3)
    y = (rng.random(60) < np.linspace(0.1, 0.9, 60)).astype(float)
    at = np.arange(60.0)
    fitted = Isotonic.fit(at, y)
    want = [max(min(y[a : b + 1].mean() for b in range(k, 60)) for a in range(k + 1)) for k in range(60)]  # least of the means to the right, largest over the starts
    blocks = [(m, v) for m, v in zip(fitted.at, fitted.value)]
    assert {round(v, 9) for _, v in blocks} == {round(v, 9) for v in want}


def test_a_split_is_the_best_of_all():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 6, (80, 3)).astype(float), rng.integers(0, 2, 80).astype(float)
    model = Boosted.fit(x, y, rounds=1, depth=1, bins=8)
    q = np.full(80, 1 / (1 + math.exp(-model.base)))
    g, h = y - q, q * (1 - q)
    gain = {}
    for j in range(3):
        for cut in range(1, 6):
            left = x[:, j] < cut
            if left.any() and (~left).any():
                gain[j, cut] = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1)
    feature, cut, _ = model.trees[0]
    assert math.isclose(gain[feature[0], int(model.edges[feature[0]][cut[0]])], max(gain.values()))
