import re

import corpus_pipeline
import __spark_entry__
from strandloom.llm import store
from tests.llm.test_decontaminate import ITEM
from tests.llm.test_near import shingles
from tests.llm.test_models import labelled


def tables(spark, folder):
    """Clean documents with one planted case of each stage."""
    docs, labels = labelled(spark, 120)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    clean = [r for r in rows if r[0] % 4]
    extra = [(1000, clean[0][1]), (1001, clean[0][1]), (1002, f"{clean[1][1]} {ITEM}"), (1003, f"{clean[2][1]} password=hunter2hunter2 end"), (1004, ""), (1005, None)]
    full = [(i, t, "en", f"s{i % 5}", len(t or "")) for i, t in rows + extra] + [(1003, extra[3][1], "en", "s3", len(extra[3][1]))]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_each_stage_decides_and_the_rest_stays(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = store.stored(stage(spark, docs, folder), name)
        assert out.columns == docs.columns
        seen[name] = {r.doc_id: r.text for r in out.collect()}
        seen[name + "_rows"] = out.count()
        docs = out
    kept = seen["toxicity"]
    assert not any(i % 4 == 0 for i in kept if i < 120 and i % 8 == 0) and sum(1 for i in kept if i < 120) >= 88
    after = seen["minhash_near_dedup"]
    groups = {}
    for i, t in kept.items():
        groups.setdefault(shingles(t, 5) or i, []).append(i)
    assert {min(g) for g in groups.values()} <= set(after) | {1002, 1003} and 1000 not in after and 1001 not in after
    assert seen["minhash_near_dedup_rows"] == len(after)
    assert set(after) - set(seen["benchmark_decontamination"]) == {i for i in (1002,) if i in after}
    final = seen["secret_scan"]
    assert set(final) == set(seen["benchmark_decontamination"])
    assert not any(re.search("hunter2", t or "") for t in final.values())
    pieces = corpus_pipeline.packing(spark, docs, folder).collect()
    assert {p.doc_id for p in pieces} == set(final)


def test_run_is_the_stages_in_turn(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = store.stored(stage(spark, docs, folder), name)
    key = lambda df: sorted(str((r.doc_id, r.start, r.length, r.ids_crc32)) for r in df.collect())
    whole = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in whole.collect()} == {r.doc_id for r in docs.collect()}
    assert sorted((r.doc_id, r.doc_tokens) for r in whole.where("start = 0").collect()) == sorted((r.doc_id, r.doc_tokens) for r in docs.where("start = 0").collect())
    assert key(docs)


def test_every_operator_is_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {re.match(r"op\d+_", q)[0] for q in names if q.startswith("op")} and "pipeline" in names


def test_one_of_each_group_whatever_its_ids(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    rows = [(1, a), (1, a + " more"), (1, a), (2, b), (2, b + " more"), (None, b), (None, c), (None, c), (None, c + " more"), (3, ""), (3, ""), (None, None), (4, "alone")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.minhash_near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r.doc_id, (r.text or "").split(" more")[0]) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (None, c), (3, ""), (3, ""), (None, ""), (4, "alone")], key=str)
