import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandloom.llm import store
from strandloom.llm.packing import WINDOW, combinations, op5_packing, pack, solve, tokenized
from strandloom.llm.token_files import ShardReader, op3_token_files, read_token_files, write_token_files
from strandloom.llm.tokens import Encoder
from tests.llm.data import documents, empty, texts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b", " lead", "trail ", "x\n\ny", "x \ny", "tab\tbed", "İstanbul ΟΔΟΣ. ﬁ", "don't stop!!! it's", "a\x1cb", "é e ́", "<|endoftext|> in text", "1234 5,6", "....", "word... word.,", " nb", "ﬃ①", "a​b c", "日本語 テスト。", "’s ’t"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cached_ids_are_the_librarys(path):
    plain = Tokenizer.from_file(path)
    cases = [t or "" for t in texts()] + ODD
    enc = Encoder(path)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.ids(cases)] == [plain.encode(t, add_special_tokens=False).ids for t in cases]


def ids_of(path, text, end):
    return np.array(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_files_round_trip_in_order(spark):
    docs = documents(spark, extra=ODD)
    manifest = write_token_files(docs, WORD, 2, store.fresh_path(spark, "t"))
    got = sorted(read_token_files(spark, manifest).collect(), key=lambda r: r.start)
    want = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    at = 0
    for g, w in zip(got, want):
        ids = ids_of(WORD, w.text, 2)
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_only_wanted_frames_are_read_and_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word {i} " * 9000) for i in range(12)], "doc_id long, text string").coalesce(1)
    manifest = write_token_files(docs, WORD, 2, f"file://{tmp_path}/t").orderBy("shard").collect()
    path = next(r.path for r in manifest if r.n_docs > 1)
    reader = ShardReader(path)
    frames = []
    whole = reader.frame
    reader.frame = lambda k: (frames.append(k), whole(k))[1]
    last = int(reader.doc_ids[-1])
    assert [d for d, _, _ in reader.documents({last})] == [last] and frames == [len(reader.seek) - 1]
    local = path.removeprefix("file://")
    raw = bytearray(open(local, "rb").read())
    raw[int(reader.starts[-2]) + 40] ^= 1
    open(local, "wb").write(raw)
    with pytest.raises(Exception):
        list(ShardReader(path).documents({last}))


def test_empty_tables(spark):
    assert read_token_files(spark, write_token_files(empty(spark), WORD, 2, store.fresh_path(spark, "t"))).count() == 0
    assert pack(tokenized(empty(spark), BYTE, 1)).count() == 0


@pytest.mark.parametrize("window", [WINDOW, 64])
def test_packing_is_whole_and_tight(spark, window):
    docs = documents(spark, extra=["x y z " * 3000, *ODD])
    pieces = pack(tokenized(docs, BYTE, 1, window), window).collect()
    by_row, by_seq = {}, {}
    for p in pieces:
        by_row.setdefault(p.row, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    got = []
    for own in by_row.values():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist() and sum(p.length for p in own) == own[0].doc_tokens
        got.append((own[0].doc_id, tuple((p.length, p.ids_crc32) for p in own)))
    want = []
    lengths = {}
    for doc, cut in got:
        lengths.setdefault(doc, []).append([n for n, _ in cut])
    for r in docs.select("doc_id", "text").collect():
        ids = ids_of(BYTE, r.text, 1)
        total = len(ids)
        cuts = next(c for c in lengths[r.doc_id] if sum(c) == total)
        lengths[r.doc_id].remove(cuts)
        ends = np.cumsum(cuts)
        want.append((r.doc_id, tuple((n, zlib.crc32(ids[e - n : e].tobytes())) for n, e in zip(cuts, ends))))
    assert sorted(map(str, got)) == sorted(map(str, want))
    padding = 0
    for seq in by_seq.values():
        seq.sort(key=lambda p: p.offset)
        assert [p.offset for p in seq] == np.cumsum([0] + [p.length for p in seq])[:-1].tolist()
        padding += window - sum(p.length for p in seq)
        assert sum(p.length for p in seq) <= window
    assert padding < window and sorted(by_seq) == list(range(len(by_seq)))


def test_the_solver_uses_most_of_the_histogram():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 2048, size=20_000)
    hist = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)]))
    plan = solve(hist)
    placed = int((plan.hi - plan.lo).sum())
    assert placed > 0.9 * len(lengths)
    fill = np.zeros(plan.sequences, dtype=int)
    for n, lo, hi, first in zip(plan.length, plan.lo, plan.hi, plan.first):
        fill[first : first + hi - lo] += n
    assert (fill == 2048).all()


def test_the_queries(spark, tmp_path):
    docs = documents(spark, extra=["x y z " * 3000, *ODD])
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(op3_token_files(spark, f"file://{tmp_path}").collect(), key=lambda r: r.start)
    want = sorted((str((i, len(ids), zlib.crc32(ids.tobytes()))) for i, t in rows for ids in [ids_of(WORD, t, 2)]))
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i or 0))
    pieces = op5_packing(spark, f"file://{tmp_path}").collect()
    lengths = {}
    for i, t in rows:
        lengths.setdefault(i, []).append(len(ids_of(BYTE, t, 1)))
    for i, own in lengths.items():
        assert sum(p.length for p in pieces if p.doc_id == i) == sum(own)
        if len(own) == 1:
            ids = ids_of(BYTE, next(t for j, t in rows if j == i), 1)
            assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids) for p in pieces if p.doc_id == i)
    full = {}
    for p in pieces:
        full[p.sequence_id] = full.get(p.sequence_id, 0) + p.length
    assert max(full.values()) <= 2048 and sum(1 for n in full.values() if n < 2048) <= 1


def test_all_combinations_are_listed():
    rng = np.random.default_rng(1)
    for window in (12, 30, 61):
        counts = (rng.random(window + 1) < 0.6).astype("i8")
        counts[0] = counts[window] = 0
        got = sorted(map(tuple, combinations(counts, window).tolist()))
        have = [n for n in range(1, window) if counts[n]]
        want = {(a, b, 0) for a in have for b in have if a >= b and a + b == window} | {(a, b, c) for a in have for b in have for c in have if a >= b >= c and a + b + c == window}
        assert got == sorted(want)
