import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.llm import repeats
from strandloom.llm.repeats import op2_suffix_dedup, remove_repeats
from tests.llm.data import documents, empty


def brute(rows, length):
    data = [(r.doc_id, (r.text or "").encode()) for r in rows]
    seen = Counter(x[i : i + length] for _, x in data for i in range(len(x) - length + 1))
    out = []
    for doc, x in data:
        spans, at, kept = [], 0, []
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        for a, b in spans:
            kept.append(x[at:a])
            at = b
        kept.append(x[at:])
        out.append((doc, len(x), spans, b"".join(kept)))
    return sorted(map(str, out))


@pytest.mark.parametrize("length,piece,seed", [(400, 100, 1), (60, 20, 2), (40, 10, 3), (8, 3, 4)])
def test_agrees_with_all_windows(spark, length, piece, seed):
    docs = documents(spark, seed)
    got = remove_repeats(docs, length, piece).select("doc_id", "n_bytes", "removed", "kept").collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.removed, bytes(r.kept))) for r in got) == brute(docs.collect(), length)


def test_empty_and_removed_bytes_are_whole(spark):
    assert remove_repeats(empty(spark)).count() == 0
    docs = documents(spark)
    bad = remove_repeats(docs).where(F.length("kept") + F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0]) != F.col("n_bytes"))
    assert bad.count() == 0


def test_the_query(spark, tmp_path):
    docs = documents(spark, 5)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = [str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in op2_suffix_dedup(spark, f"file://{tmp_path}").collect()]
    want, data = [], [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = Counter(x[i : i + 400] for _, x in data for i in range(len(x) - 399))
    for doc, x in data:
        gone = [False] * len(x)
        for i in range(len(x) - 399):
            if seen[x[i : i + 400]] > 1:
                gone[i : i + 400] = [True] * 400
        kept = bytes(b for b, g in zip(x, gone) if not g)
        want.append(str((doc, len(x), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())))
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("chunk", [64, 500])
def test_cut_texts_agree_with_all_windows(spark, monkeypatch, chunk):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    repeats._tables.cache_clear()
    try:
        rows = documents(spark, 6).collect()
        texts = [(r.doc_id, r.text) for r in rows]
        for i in (len(texts) // 2, 3):
            texts.append((900 + i, (texts[i][1] or "") * 3))
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        with_chunk = lambda: remove_repeats_here(docs, 40, 10)
        assert with_chunk() == brute(docs.collect(), 40)
    finally:
        repeats._tables.cache_clear()


def remove_repeats_here(docs, length, piece):
    """The operator with this process's chunk size, whose workers take theirs from the module."""
    chunk = repeats.CHUNK

    def within(f):
        def run(batches):
            repeats.CHUNK = chunk
            yield from f(batches)

        return run

    real = type(docs).mapInArrow
    type(docs).mapInArrow = lambda self, f, *a: real(self, within(f), *a)
    try:
        got = remove_repeats(docs, length, piece).select("doc_id", "n_bytes", "removed", "kept").collect()
    finally:
        type(docs).mapInArrow = real
    return sorted(str((r.doc_id, r.n_bytes, r.removed, bytes(r.kept))) for r in got)


def test_a_text_longer_than_a_chunk(spark):
    import random

    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000))
    docs = spark.createDataFrame([(1, long), (2, long[700_000:700_450]), (3, "x" + long[5:404])], "doc_id long, text string")
    got = {r.doc_id: r.removed for r in remove_repeats(docs).collect()}
    assert got == {1: [[700_000, 700_450]], 2: [[0, 450]], 3: []}


def shared_brute(rows, length):
    texts = [(r.text or "").encode() for r in rows]
    holders = Counter(w for x in texts for w in {x[i : i + length] for i in range(len(x) - length + 1)})
    return sorted((str(r.doc_id), any(holders[x[i : i + length]] > 1 for i in range(len(x) - length + 1))) for r, x in zip(rows, texts))


@pytest.mark.parametrize("length,piece,seed", [(400, 100, 1), (60, 20, 2), (40, 10, 3), (8, 3, 4)])
def test_shared_is_in_another_row(spark, length, piece, seed):
    docs = documents(spark, seed)
    assert sorted((str(r.doc_id), r.shared) for r in remove_repeats(docs, length, piece).collect()) == shared_brute(docs.collect(), length)


@pytest.mark.parametrize("seed", range(3))
def test_shared_where_texts_repeat_within_themselves(spark, seed):
    """Few words, so runs repeat in one text and partly in others, and all three steps decide."""
    import random

    rng = random.Random(seed)
    stock = ["".join(rng.choice("abc ") for _ in range(rng.randint(20, 90))) for _ in range(40)]
    rows = []
    for i in range(60):
        own = [rng.choice(stock)[rng.randrange(9) :] if rng.random() < 0.15 else "".join(rng.choice("defg ") for _ in range(rng.randint(5, 60))) for _ in range(5)]
        rows.append((i, "".join(rng.choice(own) for _ in range(9))))
    rows += [(None, stock[0] + "x"), (None, stock[0] + "x"), (99, "h" * 39), (100, "h" * 40), (101, "i" * 41), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = shared_brute(docs.collect(), 40)
    got = remove_repeats(docs, 40, 10).select("doc_id", "n_bytes", "removed", "kept", "shared").collect()
    assert sorted((str(r.doc_id), r.shared) for r in got) == want
    assert sorted(str((r.doc_id, r.n_bytes, r.removed, bytes(r.kept))) for r in got) == brute(docs.collect(), 40)
    assert 5 < sum(bool(r.removed) and not r.shared for r in got) and 5 < sum(r.shared for r in got)


def test_the_query_marks_passages_of_other_documents(spark, tmp_path):
    import random

    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage, line = words(60), words(60)
    rows = [(1, f"{words(90)} {passage} {words(10)}"), (2, f"{words(5)} {passage} {words(80)}"), (3, f"{line} {line} {words(9)}"), (4, words(500)), (5, passage[:399]), (6, words(3))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed > 0, r.shared) for r in op2_suffix_dedup(spark, f"file://{tmp_path}").collect()}
    assert got == {1: (True, True), 2: (True, True), 3: (True, False), 4: (False, False), 5: (False, False), 6: (False, False)}
