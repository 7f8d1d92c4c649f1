"""Source divergence audit: how far the sources of a language are from each other and which terms mark them (operator 13).

Terms are counted once where the texts lie, into partial counts by language and term, with those
of each source in an array.
Document frequencies go into a count-min sketch: every partial count is added to the slots of
its term, the slots are summed over all tasks, and those that reach the threshold are kept as
bits (2^SKETCH_BITS for each of SKETCH_ROWS hashes, whatever the corpus, broadcast). A slot never
holds less than its terms' frequency, so a term with a slot below the threshold can't be kept and
is dropped before the counts are shuffled; the survivors are counted exactly.

A pair's divergence is a sum over all kept terms, most of which neither source has. It is put
together from four sparse parts: terms that neither has (one value times their number), terms of
one source as if the other had none (one value for each distinct count), and for terms that both
have, the difference that this makes: the only join by term.

Defined results. A null text, language or source counts as empty; every row is a document, a
repeated one too; a group without terms has base probabilities; a language without kept terms has
value 0 for all its pairs; ties are ordered by item; an empty table gives no row; a text is read
whole, in pieces of PIECE bytes; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm import store

LEAST_DOCS, TOP_TERMS, SCALE = 10, 10, 1_000_000_000
#: The sketch: 2 x 2^24 bits are 4 MB. More distinct terms than slots only let more terms through.
SKETCH_BITS, SKETCH_ROWS = 24, 2
#: Partial counts that a worker holds before it hands them on, and bytes of a text cut into words at once.
HELD_TERMS, PIECE = 1_000_000, 1 << 20
#: Bytes to bytes: small letters for A-Z, a space for all of ASCII else. Bytes above 127 are those of other letters and signs.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists; a piece ends where a term does."""
    plain, at = text.translate(_LETTERS), 0
    while at < len(plain):
        end = plain.find(b" ", at + piece)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, docs, counts) of (lang, source, text): what each task has counted, several rows a term; counts has the source and n of each source."""

    def rows(lang: str, seen: Counter, by_source: dict[str, Counter]) -> pa.RecordBatch:
        number = dict(zip(seen, range(len(seen))))
        at = np.concatenate([np.fromiter(map(number.__getitem__, c), dtype="i8", count=len(c)) for c in by_source.values()])
        n = np.concatenate([np.fromiter(c.values(), dtype="i8", count=len(c)) for c in by_source.values()])
        source = np.repeat(np.arange(len(by_source), dtype="i4"), [len(c) for c in by_source.values()])
        order = np.argsort(at, kind="stable")
        offsets = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(seen))))).astype("i4")
        names = pa.array(list(by_source), pa.string()).take(pa.array(source[order]))
        counts = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([names, pa.array(n[order])], names=["source", "n"]))
        columns = [pa.array([lang] * len(seen), pa.string()), pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64()), counts]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "term", "docs", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Counter, dict[str, Counter]]] = {}
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                own: set[bytes] = set()
                seen, by_source = held.setdefault(lang, (Counter(), {}))
                times = by_source.setdefault(source, Counter())
                for words in words_of(text):
                    times.update(words)
                    own.update(words)
                seen.update(own)
            if sum(len(c) for _, by_source in held.values() for c in by_source.values()) > HELD_TERMS:
                for lang in [*held]:
                    if held[lang][0]:
                        yield rows(lang, *held[lang])
                held = {}
        for lang in held:
            if held[lang][0]:
                yield rows(lang, *held[lang])

    store.small_batches(docs.sparkSession)
    found = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).where(F.length("text") > 0)
    return found.mapInArrow(run, "lang string, term binary, docs long, counts array<struct<source:string,n:long>>").withColumn("term", F.col("term").cast("string"))


def _slots() -> list[Column]:
    """The slot of (lang, term) in each row of the sketch, numbered through."""
    return [F.shiftrightunsigned(F.xxhash64("lang", "term", F.lit(k)), 64 - SKETCH_BITS) + (k << SKETCH_BITS) for k in range(SKETCH_ROWS)]


def frequent_slots(partial: DataFrame, least: int) -> np.ndarray:
    """The merged sketch, as bits: set where the summed document frequencies reach least."""
    slots = partial.select("docs", F.explode(F.array(*_slots())).alias("slot")).groupBy("slot").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros((SKETCH_ROWS << SKETCH_BITS) >> 6, dtype="u8")
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view("u8")
    return bits


def possible(partial: DataFrame, bits: np.ndarray) -> DataFrame:
    """The partial counts of terms whose slots are all set; only the slots go to Python."""
    held = partial.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def reached(*slots: pd.Series) -> pd.Series:
        stays = np.ones(len(slots[0]), dtype=bool)
        for s in slots:
            slot = s.to_numpy()
            stays &= (held.value[slot >> 6] >> (slot & 63).astype("u8")) & np.uint64(1) == 1
        return pd.Series(stays)

    return partial.where(reached(*_slots()))


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exact; null where there is nothing to divide by. Decimals only where a long could overflow."""
    wide, of = f"({SCALE}BD * (cast({n} as decimal(20,0)) + 2))", f"nullif({total} + 2 * {terms}, 0)"
    return F.expr(f"1 + if({n} < {SCALE * 9}, ({SCALE} * ({n} + 2L)) div {of}, {wide} div cast({of} as decimal(20,0)))").cast("long")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows of part `pair` (every other source of the language) and `term` (the top terms): lang, source, part, item, value, rank."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    rows = docs.select(*text)
    partial = store.stored(partial_counts(rows), "partial")
    likely = possible(partial, frequent_slots(partial, least))
    each = likely.select("lang", "term", "docs", F.posexplode("counts").alias("at", "one"))
    once = F.when(F.col("at") == 0, F.col("docs")).otherwise(0)  # a term's documents go with its first source
    # the tasks have added up what they could, so rows are shuffled before they are added up further
    dealt = each.select("lang", "one.source", "term", "one.n", once.alias("docs")).repartition("lang", "source", "term")
    counts = store.stored(dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= least)
    kept = store.stored(kept.select("lang", "term", "all"), "kept")
    store.forget(partial)
    langs = store.stored(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total")), "langs")
    likely = kept.join(langs, "lang").select("lang", "term", _share("all", "lang_total", "terms").alias("q"))
    own = store.stored(counts.drop("docs").join(likely, ["lang", "term"]), "own")

    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("met"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs.drop("lang_total"), "lang", "left").na.fill(0)
    groups = store.stored(groups.withColumn("base", _share("0", "total", "terms")), "groups")
    shares = own.join(groups.drop("met"), ["lang", "source"]).select("lang", "source", "term", "base", _share("n", "total", "terms").alias("p"), "q")
    shares = store.stored(shares, "shares")

    marks = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = marks.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    sides = [groups.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "met", "base", "terms")]) for s in "ab"]
    neither = sides[0].join(sides[1], "lang").where("source_a < source_b").select("lang", "source_a", "source_b", (F.expr("terms_a - met_a - met_b") * _apart("base_a", "base_b")).alias("value"))
    like = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    one = like.join(sides[1], "lang").where("source <> source_b").select("lang", F.least("source", "source_b").alias("source_a"), F.greatest("source", "source_b").alias("source_b"), (F.col("m") * _apart("p", "base_b")).alias("value"))
    held = [shares.select("lang", "term", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "p", "base")]) for s in "ab"]
    change = _apart("p_a", "p_b") - _apart("p_a", "base_b") - _apart("base_a", "p_b") + _apart("base_a", "base_b")
    both = held[0].join(held[1], ["lang", "term"]).where("source_a < source_b").select("lang", "source_a", "source_b", change.alias("value"))
    summed = [t.groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value")) for t in (one, both)]
    pairs = neither.unionByName(summed[0]).unionByName(summed[1]).groupBy("lang", "source_a", "source_b").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))
    ways = F.explode(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("source_a", "source_b"), ("source_b", "source_a"))]))
    pairs = pairs.select("lang", "value", ways.alias("way")).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(gn.n, 0) + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (kept.n + 2)) // (v.n + 2 * v.v) AS q
  FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS t, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.s = a.source AND s.t = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
