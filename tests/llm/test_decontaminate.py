import random
import re

from pyspark.sql import functions as F

from strandloom.llm import decontaminate
from strandloom.llm.decontaminate import contaminated_by
from tests.llm.data import documents, empty

ITEM = "Tom Baker has 12 apples and gives 5 apples to Mary over 3 days. How many apples does he keep after 3 days?"
CASES = {
    ITEM: True,
    f"before. {ITEM} after it": True,
    "Well. Ann Lee has 40 apples and gives 7 apples to Bob over 9 days. How many apples does he keep after 9 days?": True,
    "Tom Baker has twelve apples and gives 5 apples to Mary over 3 days. How many apples does he keep": True,
    "short item there": False,
    "Ann has 40 apples and a dog. The dog keeps 3 days.": False,
    "How many apples": False,
    "short item here": True,
}


def test_items_and_their_variants(spark):
    items = spark.createDataFrame([(1, ITEM, 0), (1, ITEM, 0), (2, None, 0), (3, "", 0), (4, "short item here", 0), (None, "nothing like that at all here", 0)], "item_id long, text string, doc_id long")
    docs = documents(spark, extra=list(CASES))
    got = {r.doc_id: r["items"] for r in contaminated_by(docs, items).collect() if r.doc_id is not None}
    n = max(got) + 1
    assert {t: bool(got[n - len(CASES) + i]) for i, t in enumerate(CASES)} == CASES
    assert not any(v for k, v in got.items() if k < n - len(CASES))
    assert contaminated_by(docs, items).count() == docs.count()


def test_inconsistent_slots_don_t_count(spark):
    item = "take 4 red balls and 4 blue balls and 4 green balls and 4 white balls then"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item.replace("4", "9")), (2, "take 1 red balls and 2 blue balls and 3 green balls and 5 white balls then")], "doc_id long, text string")
    assert {r.doc_id: r["items"] for r in contaminated_by(docs, items).collect()} == {1: [1], 2: []}


def test_empty_sides_and_the_filter(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"{ITEM} number{i} tail{i}") for i in range(3)], "item_id long, text string")
    docs = documents(spark, extra=[ITEM + " number1 tail1"])
    assert contaminated_by(empty(spark), items).count() == 0
    assert contaminated_by(docs, items.limit(0)).where("size(items) > 0").count() == 0
    whole = sorted(map(str, contaminated_by(docs, items).collect()))
    assert any("[0, 1, 2]" in r for r in whole)  # the numbered tails are less than a fifth of the items
    monkeypatch.setattr(decontaminate, "HELD_HASHES", 10)
    assert sorted(map(str, contaminated_by(docs, items).collect())) == whole


def test_items_rich_in_slots(spark):
    items = ["Compute 12 plus 7 times 30.", "What is 15 percent of 80?", "Who wrote Hamlet and Macbeth?", "Add 3 4 5 6 7 8 9 10 to 11 then halve", "12 15 18 21 24 27", "Tom Anna Bob"]
    other = ["Compute 9 plus 4 times 11.", "What is 40 percent of 7?", "Who wrote Ulysses and Dubliners?", "Add 1 2 4 6 7 8 9 12 to 13 then halve", "11 15 18 21 24 29", "Tom Anna Ben"]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"Some words. {t} And more") for i, t in enumerate([*items, *other, "He wrote Ulysses and sang", "Add 3 4 5 6 7 8 9 10 to"])], "doc_id long, text string")
    got = {r.doc_id: r["items"] for r in contaminated_by(docs, table).collect()}
    assert [got[i] for i in range(6)] == [[i] for i in range(6)]
    assert [got[6 + i] for i in range(6)] == [[0], [1], [2], [3], [], []] and got[12] == got[13] == []


def test_copies_in_other_lines_case_and_punctuation(spark):
    items = [ITEM, "What is the capital city?", "Count the words.\nThen, if any Of them rhyme, name the ones that Do; stop at ten"]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    ways = [str.upper, lambda t: t.replace(" ", "\n"), lambda t: "question: " + t, lambda t: re.sub("[.,;?]", "", t), lambda t: t.replace("\n", " "), lambda t: t.replace("12", "40").lower()]
    docs = spark.createDataFrame([(len(ways) * i + k, f"here, {way(t)} and more") for i, t in enumerate(items) for k, way in enumerate(ways)] + [(99, "what is the capital of the city")], "doc_id long, text string")
    got = {r.doc_id: r["items"] for r in contaminated_by(docs, table).collect()}
    assert got == {99: []} | {len(ways) * i + k: [i] for i in range(len(items)) for k in range(len(ways))}


PROBES = ["Tom has 3 kg, Mary has 5 kg and Ann has 7 kg. Bob has 9 kg.", "Compute 12 + 35 * 7 - 4 / 2 + 19 * 3 - 8.", "Alice Smith Bob Jones Carol King: 5 km, 6 km, 7 km.", "Who was Albert Einstein? Where was Marie Curie born? When did Isaac Newton die?"]


def plain(items, texts):
    """Every window of every item against every window of every text, and the slots of each diagonal, by plain loops."""
    make = decontaminate.Templates()
    made = [make([t]) for t in items]
    out = []
    for text in texts:
        views, own = make([text]), {}
        for n, item in enumerate(made):
            for way in (0, 1):
                cover, maps = [False] * len(item[way].kinds), {}
                wanted = sorted((what, width, d, j) for what, j, width in decontaminate.indexed(*item) if decontaminate._way(what) == way
                                for d in range(len(views[way].kinds) - width + 1) if views[way].codes[what][d : d + width].tolist() == item[way].codes[what][j : j + width].tolist())
                for what, width, d, j in wanted:
                    there, back = maps.setdefault(d - j, ({}, {}))
                    pairs = [] if what == decontaminate.EXACT else [(int(item[way].values[j + k]), int(views[way].values[d + k])) for k in range(width) if item[way].slot[j + k]]
                    if all((a == c) == (b == e) for a, b in pairs for c, e in [*pairs, *there.items()]):
                        there.update(pairs)
                        back.update((b, a) for a, b in pairs)
                        cover[j : j + width] = [True] * width
                if cover and sum(cover) / len(cover) >= 0.8:
                    own[n] = max(own.get(n, 0), sum(cover) / len(cover))
        out.append((sorted(own), round(max(own.values(), default=0.0), 6)))
    return out


def test_the_query_agrees_with_plain_loops(spark, tmp_path):
    rng = random.Random(7)
    items = [*PROBES, ITEM, "short item here", "Count the words.\nThen, if any Of them rhyme, name the ones that Do; stop at ten", "What is 15 percent of 80?"]
    texts = [None, "", "nothing of that kind in here at all"]
    for t in items:
        swapped = re.sub(r"\b[0-9]+\b", lambda m: str(int(m[0]) + 50), t).replace("Tom", "Jim").replace("Mary", "Zoe")
        clipped = t.split()
        texts += [t, f"before this. {t} after it", swapped, t.upper(), " ".join(clipped[: len(clipped) * 2 // 3]), f"{t} {t} {swapped}", "word " * 300 + t + " tail" * 300]
    for _ in range(40):
        words = rng.choice(items).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["other", "7", "Kim", "kg"])
        texts.append(" ".join(words))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = {r.doc_id: ([int(i) for i in r.item_ids.split(",") if i], r.covered) for r in decontaminate.op6_benchmark_decontamination(spark, f"file://{tmp_path}").collect()}
    want = plain(items, texts)
    assert {i: (sorted(ids), c) for i, (ids, c) in got.items()} == dict(enumerate(want))
    for k, t in enumerate(PROBES):
        assert k in got[3 + 7 * k][0] and k in got[4 + 7 * k][0], t


def test_changed_values_of_items_with_few_literal_words(spark):
    items = ["Compute 12 + 35 * 7 - 4 / 2 + 19 * 3 - 8.", "Anna Lind, John Roe and Carol King: 5 km, 6 km, 7 km.", "12 35 7 4 2 19 3 8", "Add 1 and 2"]
    texts = {
        "Please: compute 90 + 41 * 6 - 5 / 3 + 20 * 1 - 7, then stop.": [0],
        "compute 90 + 41 * 6 - 5 / 3 + 20 * 1 - 90, then stop": [],
        "compute 90 + 41 * 6 - 5 / 3 + 20 * 1, then stop": [],
        "Rita Moor, Paul Hart and Nina Bell: 15 km, 16 km, 17 km.": [1],
        "Rita Moor, Paul Hart and Nina Bell: 15 km, 15 km, 17 km.": [],
        "the numbers 90 41 6 5 3 20 1 7 of a table": [],
        "the numbers 12 35 7 4 2 19 3 8 of a table": [0, 2],  # eight of the nine words of the first item
        "add 3 and 4": [],
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r["items"] for r in contaminated_by(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == list(texts.values())


def test_names_that_clash(spark):
    docs = documents(spark, extra=[ITEM]).withColumns({c: F.lit(1) for c in ("hits", "what", "h", "items", "covered", "text_hash_")})
    items = spark.createDataFrame([(1, ITEM, 1, 2, 3)], "item_id long, text string, item long, id long, what long")
    assert contaminated_by(docs, items).where("size(items) > 0").count() == 1
