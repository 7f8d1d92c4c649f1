"""Benchmark decontamination by template canonicalisation (operator 6).

Words are lower-cased; numbers, names and units become typed placeholders, and so does the
first word of a sentence, whose capital says nothing. Windows of five template words are
joined by hash with the benchmark's; a matched window counts only while the values in its
slots map one to one to the item's along its diagonal. An item is found in a document where
the counted windows cover at least four fifths of the item's words. A window short of literal
words is matched with the words at sentence starts, and made longer until it has enough; an
item that never has enough is one whole window, if it has a literal word at all, so changed
numbers, units and names in it are found too. Beside that an item is matched by its words with
placeholders for numbers and units only, in the same way, and, short of literal words even so,
word for word.

The benchmark's windows are a table, made in parallel. One pass over the documents keeps the
windows whose hash the benchmark may have: up to HELD_HASHES distinct hashes are held sorted
by every worker, beyond that a filter of 2^FILTER_BITS bits, which lets more through but loses
nothing. What is kept meets the table in a join by hash, and the slot check streams over the
joined rows, sorted by document, item and diagonal.

Defined results. A null, empty or word-less text, document or item, matches nothing; items
shorter than a window are one window, word for word, in any case; a text of any length is
taken whole, a long one alone; repeated rows, items too, come back as they are; items with a
null id count in covered, but have no id to list; an empty benchmark finds nothing; an empty
table gives no row; other columns are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import store
from strandloom.llm.minhash import _mixed

WINDOW, COVERED = 5, 0.8
#: Distinct window hashes of the benchmark that a worker holds (8 bytes each), and the bits of the filter beyond (32 MB).
HELD_HASHES, FILTER_BITS = 4_000_000, 28
#: Literal words that a window needs, else it is too common to say anything.
LEAST_LITERALS = 3
_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+|[.!?]|\n[^\S\n]*\n")
# Words for numbers, and units that may follow a number.
NUMBERS = frozenset("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("mm cm m km meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet yard yards mile miles g kg mg gram grams kilogram kilograms pound pounds lb lbs ounce ounces oz ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars euro euros cent cents usd eur percent degree degrees celsius fahrenheit mph kmh watt watts volt volts joule joules byte bytes kb mb gb".split())
LITERAL, NUMBER, UNIT, NAME, END = range(5)
_PLACEHOLDER = np.array([0, 0xA11CE5, 0xBEEF01, 0xC0FFEE, 0, 0xD0DE11], dtype="u8")
_START = 5


#: What an index is made over: the template; the template with the words at sentence starts; words with placeholders for numbers and units only; plain words.
TEMPLATE, ANCHORED, FOLDED, EXACT = range(4)
#: Texts are taken together up to so many characters, or one longer text.
CHARS_AT_ONCE = 2_000_000
_FACTOR = 0x9E3779B97F4A7C15
_BITS = 20


class View:
    """Words of some texts in a row: their number of text, values, kinds, and codes by what is indexed."""

    def __init__(self, text: np.ndarray, values: np.ndarray, kinds: np.ndarray, codes: dict[int, np.ndarray]) -> None:
        self.text, self.values, self.kinds, self.codes = text, values, kinds, codes
        self.slot = (kinds == NUMBER) | (kinds == UNIT) | (kinds == NAME)


class Templates:
    """Template words and plain words of texts; word entries are cached within a bound."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.kinds, self.values = np.zeros(0, dtype="i8"), np.zeros(0, dtype="u8")

    def _entry(self, token: str) -> tuple[int, int]:
        low = token.casefold()
        if token[0] in ".!?\n":
            return END, 0
        if token[0].isdigit() or low in NUMBERS:
            return NUMBER, xxhash.xxh64_intdigest(low)
        if low in UNITS:
            return UNIT, xxhash.xxh64_intdigest(low)
        return NAME if token[0].isupper() else LITERAL, xxhash.xxh64_intdigest(low)

    def _numbers(self, tokens: list[str]) -> np.ndarray:
        known = self.words
        if len(known) > 500_000:
            known.clear()
            self.kinds, self.values = self.kinds[:0], self.values[:0]
        new = list({*tokens}.difference(known))
        if new:
            made = [self._entry(t) for t in new]
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.kinds = np.concatenate((self.kinds, np.array([m[0] for m in made], dtype="i8")))
            self.values = np.concatenate((self.values, np.array([m[1] for m in made], dtype="u8")))
        return np.fromiter(map(known.__getitem__, tokens), dtype="i8", count=len(tokens))

    def __call__(self, texts: list[str | None]) -> tuple[View, View]:
        """(template words, plain words): _START stands at sentence starts, runs of names are one template word."""
        tokens = [_TOKEN.findall(t) if t else [] for t in texts]
        at = self._numbers([t for own in tokens for t in own])
        text = np.repeat(np.arange(len(texts)), [len(own) for own in tokens])
        kinds, values = self.kinds[at], self.values[at]
        first = np.ones(len(at), dtype=bool)
        first[1:] = (kinds[:-1] == END) | (text[1:] != text[:-1])
        words = kinds != END
        text, kinds, values, first = text[words], kinds[words], values[words], first[words]
        counted = np.zeros(len(kinds), dtype=bool)
        counted[1:] = (kinds[:-1] == NUMBER) & (text[1:] == text[:-1])
        kinds = np.where((kinds == UNIT) & ~counted, LITERAL, kinds)
        own = np.where(kinds == NAME, LITERAL, kinds)
        plain = View(text, values, own, {FOLDED: np.where(own == LITERAL, values, _PLACEHOLDER[own]), EXACT: values})
        kinds = np.where(first & (kinds != NUMBER), _START, kinds)
        follows = np.zeros(len(kinds), dtype=bool)
        follows[1:] = (kinds[1:] == NAME) & (kinds[:-1] == NAME)
        text, kinds, values = text[~follows], kinds[~follows], values[~follows]
        codes = np.where(kinds == LITERAL, values, _PLACEHOLDER[kinds])
        return View(text, values, kinds, {TEMPLATE: codes, ANCHORED: np.where(kinds == _START, values, codes)}), plain


class Runs:
    """Hashes of all runs of any width of some codes, from one running sum."""

    powers = inverses = np.zeros(0, dtype="u8")

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        if len(Runs.powers) < n:
            for name, x in (("powers", _FACTOR), ("inverses", pow(_FACTOR, -1, 1 << 64))):
                factors = np.full(2 * n, x, dtype="u8")
                factors[0] = 1
                setattr(Runs, name, np.cumprod(factors))
        self.sums = np.zeros(n + 1, dtype="u8")
        np.cumsum(codes * Runs.powers[:n], out=self.sums[1:])

    def __call__(self, width: int) -> np.ndarray:
        n = max(0, len(self.sums) - width)
        return _mixed((self.sums[width:] - self.sums[:n]) * Runs.inverses[:n])


def spans(literal: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """(place, width) of a window for each start: WINDOW words, or as many more as hold LEAST_LITERALS."""
    at, before = np.flatnonzero(literal), np.concatenate(([0], np.cumsum(literal)))
    if len(at) < LEAST_LITERALS:
        return []
    found = set()
    for j in starts.tolist():
        last = before[j] + LEAST_LITERALS - 1
        i, end = (j, max(j + WINDOW, at[last] + 1)) if last < len(at) else (min(j, at[-LEAST_LITERALS]), max(j + WINDOW, at[-1] + 1))
        found.add((int(i), int(end - i)))
    return sorted(found)


def whole(what: int, view: View) -> list[tuple[int, int, int]]:
    """One window of all words of an item with literal words and slots, too few for others."""
    return [(what, 0, len(view.kinds))] if (view.kinds == LITERAL).any() and view.slot.any() else []


def indexed(template: View, plain: View) -> list[tuple[int, int, int]]:
    """(what, place, width) of the windows of one item; each way, if any, they hold all of its words."""
    found, n = [], len(template.kinds) - WINDOW + 1
    if n > 0:
        literal = template.kinds == LITERAL
        enough = np.convolve(literal, np.ones(WINDOW, dtype="i8"), "valid") >= LEAST_LITERALS
        found += [(TEMPLATE, j, WINDOW) for j in np.flatnonzero(enough).tolist()]
        found += [(ANCHORED, j, w) for j, w in spans(literal | (template.kinds == _START), np.flatnonzero(~enough))]
        found = found or whole(TEMPLATE, template)
    size = len(plain.kinds)
    if size:
        wide = [(FOLDED, j, w) for j, w in spans(plain.kinds == LITERAL, np.arange(size - WINDOW + 1))] if size >= WINDOW else []
        found += wide or [*(whole(FOLDED, plain) if size >= WINDOW else []), *((EXACT, j, min(WINDOW, size)) for j in range(max(1, size - WINDOW + 1)))]
    return found


class Hashes:
    """Which hashes the benchmark's windows may have."""

    def __init__(self, held: np.ndarray | None, bits: np.ndarray | None) -> None:
        self.held, self.bits = held, bits
        if held is not None:
            self.few = np.zeros(1 << _BITS, dtype=bool)
            self.few[held >> np.uint64(64 - _BITS)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be there."""
        if self.held is None:
            at = (h >> np.uint64(64 - FILTER_BITS)).astype("i8")
            return np.flatnonzero((self.bits[at >> 3] >> (at & 7).astype("u1")) & 1)
        likely = np.flatnonzero(self.few[h >> np.uint64(64 - _BITS)])
        found = np.searchsorted(self.held, h[likely])
        return likely[self.held[np.minimum(found, len(self.held) - 1)] == h[likely]]


def _hashes(windows: DataFrame) -> tuple[np.ndarray | None, np.ndarray | None]:
    """(sorted hashes, None), or where they are too many (None, filter); both are of bounded size."""
    h = windows.select("h").distinct()
    if h.limit(HELD_HASHES + 1).count() <= HELD_HASHES:
        return np.sort(h.toArrow().column("h").to_numpy().astype("i8").view("u8")), None
    bits = np.zeros(1 << (FILTER_BITS - 3), dtype="u1")
    for r in h.select((F.shiftrightunsigned("h", 64 - FILTER_BITS)).alias("at")).distinct().toLocalIterator():
        bits[r["at"] >> 3] |= np.uint8(1 << (r["at"] & 7))
    return None, bits


_WINDOWS = "item long, id long, what int, width int, h long, place int, size int, slots array<long>"


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """A row for each window of each item: its item's row and id, hash, place, the item's words and the values in its slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Templates()
        for batch in batches:
            out: list[tuple] = []
            for item, i, text in zip(*(batch.column(c).to_pylist() for c in ("item", "id", "text"))):
                views = make([text])
                runs: dict[int, Runs] = {k: Runs(c) for view in views for k, c in view.codes.items()}
                hashes: dict[tuple[int, int], np.ndarray] = {}
                for what, j, width in indexed(*views):
                    if (what, width) not in hashes:
                        hashes[what, width] = runs[what](width).view("i8")
                    view = views[_way(what)]
                    out.append((item, i, what, width, int(hashes[what, width][j]), j, len(view.kinds), _slots(view, what, j, width)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=[c.split()[0] for c in _WINDOWS.split(", ")])

    items = benchmark.where(F.col(text_col).isNotNull()).select(F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return items.mapInArrow(run, _WINDOWS)


def _way(what: int) -> int:
    return 0 if what in (TEMPLATE, ANCHORED) else 1


def _slots(view: View, what: int, at: int, width: int) -> list[int]:
    return [] if what == EXACT else view.values[at : at + width][view.slot[at : at + width]].view("i8").tolist()


def _likely(views: tuple[View, View], classes: list[tuple[int, int]], hashes: Hashes, texts: int) -> list[list[dict]]:
    """For each text its windows that the benchmark may have."""
    out: list[list[dict]] = [[] for _ in range(texts)]
    runs: dict[int, Runs] = {}
    for what, width in classes:
        view = views[_way(what)]
        if len(view.text) < width:
            continue
        if what not in runs:
            runs[what] = Runs(view.codes[what])
        h = runs[what](width)
        at = hashes(h)
        at = at[view.text[at] == view.text[at + width - 1]]
        start = np.searchsorted(view.text, view.text[at])
        for d, text, first in zip(at.tolist(), view.text[at].tolist(), start.tolist()):
            out[text].append({"what": what, "width": width, "h": int(h[d].view("i8")), "at": d - first, "values": _slots(view, what, d, width)})
    return out


def consistent(found: DataFrame) -> DataFrame:
    """(row, item, id, share) of items whose consistent windows cover enough words.

    found(row, item, id, way, diagonal, what, width, at, place, size, slots, values): one matched
    window each. A document's windows of one item are dealt together and streamed by diagonal, so
    a task holds one item's cover and one diagonal's slots.
    """
    order = ["row", "item", "way", "diagonal", "what", "width", "at"]
    rows = found.repartition(store.partitions(found.sparkSession), "row", "item", "way").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: tuple, cover: np.ndarray) -> tuple | None:
            share = float(cover.mean())
            return (key[0], key[1], key[3], share) if share >= COVERED else None

        now, diagonal = None, None
        there: dict[int, int] = {}
        back: dict[int, int] = {}
        cover = np.zeros(0, dtype=bool)
        for batch in batches:
            out = []
            for row, item, way, d, i, place, width, size, slots, values in zip(*(batch.column(c).to_pylist() for c in ("row", "item", "way", "diagonal", "id", "place", "width", "size", "slots", "values"))):
                if (row, item, way, i) != now:
                    if now is not None:
                        out.append(done(now, cover))
                    now, diagonal, cover = (row, item, way, i), None, np.zeros(size, dtype=bool)
                if d != diagonal:
                    diagonal, there, back = d, {}, {}
                own, turned = dict(zip(slots, values)), dict(zip(values, slots))
                if len(slots) != len(values) or any(own[a] != b or turned[b] != a or there.get(a, b) != b or back.get(b, a) != a for a, b in zip(slots, values)):
                    continue
                there |= own
                back |= turned
                cover[place : place + width] = True
            yield _shares(out)
        if now is not None:
            yield _shares([done(now, cover)])

    return rows.mapInArrow(run, "row long, item long, id long, share double")


def _shares(found: list[tuple | None]) -> pa.RecordBatch:
    rows = [f for f in found if f is not None]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["row", "item", "id", "share"])


def _together(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in runs of at most CHARS_AT_ONCE characters, or of one text."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t or "") > CHARS_AT_ONCE:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t or "")
    if run:
        yield run


_HIT = pa.list_(pa.struct([("what", pa.int32()), ("width", pa.int32()), ("h", pa.int64()), ("at", pa.int64()), ("values", pa.list_(pa.int64()))]))


def contaminated_by(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, text_hash, items (sorted ids found) and covered (the largest share); one row per row of docs."""
    spark = docs.sparkSession
    store.small_batches(spark)
    windows = store.stored(benchmark_windows(benchmark, item_col, item_text), "windows")
    # widths are few: five words, or as many as an item needs to hold three literal ones
    classes = sorted((r["what"], r["width"]) for r in windows.select("what", "width").distinct().collect())
    held = spark.sparkContext.broadcast(_hashes(windows))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, hashes = Templates(), Hashes(*held.value)
        for batch in batches:
            found = [f for texts in _together(batch.column("text").to_pylist()) for f in (_likely(make(texts), classes, hashes, len(texts)) if classes else [[]] * len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found, _HIT)], names=["doc_id", "text_hash", "hits"])

    scanned = rows.mapInArrow(run, f"doc_id {kind}, text_hash long, hits array<struct<what:int,width:int,h:long,at:long,values:array<long>>>")
    scanned = store.stored(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")
    hits = scanned.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    met = hits.join(windows, ["what", "width", "h"])
    met = met.withColumn("way", F.col("what").isin(TEMPLATE, ANCHORED).cast("int")).withColumn("diagonal", F.col("at") - F.col("place"))
    found = consistent(met).groupBy("row").agg(F.sort_array(F.collect_set("id")).alias("items"), F.max("share").alias("covered"))
    out = scanned.select("row", "doc_id", "text_hash").join(store.stored(found, "contaminated"), "row", "left")
    return out.select("doc_id", "text_hash", F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("covered", F.lit(0.0)).alias("covered"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contaminated_by(docs, items)
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("item_ids"), F.round("covered", 6).alias("covered"))
