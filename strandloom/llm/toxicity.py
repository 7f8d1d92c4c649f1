"""Toxicity: gradient-boosted trees over dense features with isotonic calibration (operator 9).

The lexicon is a short fixed list and the terms (words and word beginnings) that the learned
rows show to be toxic: every term of theirs counts in the slot of its hash, and a slot's log
odds are kept where they stand out, so the lexicon has a fixed size whatever the vocabulary.
Lexicon, trees and calibration are fitted on three disjoint parts of at most fit_rows labelled
rows, chosen by a hash of the id; every document is scored in full.

Defined results. A null text counts as empty and is scored; a text without words has all
features 0; a text of any length is scored whole, in one piece; a null doc_id is held out;
labels other than 0 and 1 are not learned; of rows with one id and different texts the one of
the least text hash is learned; without rows of both classes in the tree part every score is
the share of class 1 (0.5 without labels); repeated rows are scored alike; an empty table gives
no row; other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import store
from strandloom.llm.boosting import Boosted, Isotonic
from strandloom.llm.quality import bucket, clean_labels

#: The default bound of labelled rows that are learned from.
FIT_ROWS = 40_000
#: Bits of a term's slot: the lexicon is 2^SLOT_BITS numbers of four bytes, 16 MB.
SLOT_BITS = 22
#: Toxic rows that a slot must be met in, and the log odds it must have.
LEAST_DOCS, LEAST_ODDS = 4, 2.5
#: Words that a worker keeps, at about 160 bytes each.
KNOWN_WORDS = 300_000
_INSULT, _PERSON, _CAPITAL, _MIXED = 1, 2, 4, 8
# Insults that are counted before anything is learned, and words of address.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown fool imbecile vermin filth".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted tú tus vosotros".split())
FEATURES = ("words", "hits", "hit_density", "log_odds", "log_odds_density", "top_odds", "insults", "insult_density", "near_second_person", "second_person", "capitals", "capital_words", "exclamations", "punctuation", "repeated_letters", "mixed_words", "symbol_words", "spaced_letters", "distinct_hits")
_WORD = re.compile(r"\w+")
_TERM_SPLIT = r"[^\p{L}\p{N}_]+"
_PREFIXES = (4, 5)
NEAR = 5
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


class Features:
    """The features of texts, in the order of FEATURES; what is known of a word is kept within a bound."""

    def __init__(self, lexicon: np.ndarray) -> None:
        self.lexicon = memoryview(lexicon)  # quicker than the array, one number at a time
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.odds, self.flags = np.zeros(4096, dtype="f8"), np.zeros(4096, dtype="u1")

    def _learn(self, words: set[str]) -> None:
        need = len(self.words) + len(words)
        if need > len(self.odds):
            more = max(need, 2 * len(self.odds)) - len(self.odds)
            self.odds, self.flags = np.concatenate((self.odds, np.zeros(more))), np.concatenate((self.flags, np.zeros(more, dtype="u1")))
        lexicon, digest, shift = self.lexicon, xxhash.xxh64_intdigest, 64 - SLOT_BITS
        for w in words:
            low, k, flags = w.lower(), len(self.words), 0
            odds = lexicon[digest(low, 42) >> shift]
            for size in _PREFIXES:
                if len(low) > size:
                    odds = max(odds, lexicon[digest(low[:size] + "-", 42) >> shift])
            if low in INSULTS:
                odds, flags = max(odds, 4.0), _INSULT
            if low in SECOND_PERSON:
                flags |= _PERSON
            if len(w) > 2 and w.isupper():
                flags |= _CAPITAL
            if not w.isalpha() and re.search(r"\d", w) and re.search(r"[^\W\d_]", w):
                flags |= _MIXED
            self.words[w] = k
            if odds > 0:
                self.odds[k] = odds
            if flags:
                self.flags[k] = flags

    def __call__(self, text: str | None) -> list[float]:
        words = _WORD.findall(text) if text else []
        n = len(words)
        if not n:
            return [0.0] * len(FEATURES)
        if len(self.words) > KNOWN_WORDS:
            self._forget()
        if new := {*words}.difference(self.words):
            self._learn(new)
        at = np.fromiter(map(self.words.__getitem__, words), dtype="i8", count=n)
        odds, flags = self.odds[at], self.flags[at]
        hits, people = np.flatnonzero(odds > 0), np.flatnonzero(flags & _PERSON)
        insults = float(np.count_nonzero(flags & _INSULT))
        near = 0
        if len(hits) and len(people):
            after = np.searchsorted(people, hits)
            ahead = people[np.minimum(after, len(people) - 1)] - hits
            behind = hits - people[np.maximum(after - 1, 0)]
            near = int((np.minimum(np.abs(ahead), np.abs(behind)) <= NEAR).sum())
        chars = len(text)
        capitals = chars - len(text.encode().translate(None, _CAPITALS)) if text.isascii() else sum(map(str.isupper, text))
        total = float(odds[hits].sum())
        return [
            math.log1p(n),
            float(len(hits)),
            len(hits) / n,
            total,
            total / math.sqrt(n),
            float(odds.max()),
            insults,
            insults / n,
            float(near),
            len(people) / n,
            capitals / chars,
            np.count_nonzero(flags & _CAPITAL) / n,
            text.count("!") / n,
            len(re.findall(r"[^\w\s]", text)) / chars,
            len(re.findall(r"(\w)\1\1", text)) / n,
            np.count_nonzero(flags & _MIXED) / n,
            len(re.findall(r"\w[@$*#]\w", text)) / n,
            len(re.findall(r"(?:\b\w\b[ .\-]){3,}", text)) / n,
            float(len({words[i].lower() for i in hits.tolist()})),
        ]


def learn_lexicon(rows: DataFrame) -> np.ndarray:
    """Log odds by slot (the leading bits of a term's hash), of the terms in the toxic rows of (text, label); 0 where they don't stand out."""
    lexicon = np.zeros(1 << SLOT_BITS, dtype="f4")
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), _TERM_SPLIT), lambda w: w != ""))

    def beginnings(size: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) > size), lambda w: F.concat(F.substring(w, 1, size), F.lit("-")))

    terms = F.array_distinct(F.flatten(F.array(words, *(beginnings(size) for size in _PREFIXES))))
    slots = F.array_distinct(F.transform(terms, lambda t: F.shiftrightunsigned(F.xxhash64(t), 64 - SLOT_BITS)))
    seen = rows.select("label", F.explode(slots).alias("slot")).groupBy("slot").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("docs"))
    totals = rows.agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("docs")).first()
    toxic, docs = totals["toxic"] or 0, totals["docs"]
    if not toxic or toxic == docs:
        return lexicon
    odds = F.log(((F.col("toxic") + 0.1) / (toxic + 0.2)) / ((F.col("docs") - F.col("toxic") + 0.1) / (docs - toxic + 0.2)))
    found = seen.where(F.col("toxic") >= LEAST_DOCS).select("slot", odds.cast("float").alias("odds")).where(F.col("odds") > LEAST_ODDS).toArrow()
    lexicon[found.column("slot").to_numpy()] = found.column("odds").to_numpy()
    return lexicon


def with_features(docs: DataFrame, lexicon: np.ndarray) -> DataFrame:
    """doc_id, text_hash and feats of (doc_id, text); the lexicon is of a fixed size and broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(held.value)
        for batch in batches:
            found = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "text_hash", "feats"])

    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, feats array<double>")


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_fold: int = 0, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, text_hash for each row of docs; fit_rows bounds the labelled rows learned from."""
    spark = docs.sparkSession
    store.small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = clean_labels(labels, label, id_col).where(bucket(F.col("doc_id"), folds) != held_fold)
    fit = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10)))
    fit = store.stored(fit, "fit")  # at most fit_rows narrow rows: small enough to broadcast
    lexicon = learn_lexicon(store.stored(rows.join(F.broadcast(fit.where("part < 5")), "doc_id").select("text", "label"), "lexicon"))
    scored = store.stored(with_features(rows, lexicon), "toxicity")

    one = F.min(F.struct("text_hash", "feats", "label", "part")).alias("one")
    learned = scored.join(F.broadcast(fit.where("part >= 5")), "doc_id").groupBy("doc_id").agg(one).orderBy("doc_id").select("one.feats", "one.label", "one.part").collect()
    x = np.array([r["feats"] for r in learned], dtype=float).reshape(-1, len(FEATURES))
    y, part = np.array([r["label"] for r in learned], dtype=float), np.array([r["part"] for r in learned])
    tree, rest = part < 8, part >= 8
    model = calibrate = None
    if len(set(y[tree].tolist())) == 2:
        model = Boosted.fit(x[tree], y[tree])
        if y[rest].sum() >= 20 and (1 - y[rest]).sum() >= 20:
            calibrate = Isotonic.fit(model.margin(x[rest]), y[rest])
    share = float(y.mean()) if len(y) else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                f = np.array(batch.column("feats").to_pylist(), dtype=float)
                m = model.margin(f) if model else None
                s = np.full(len(f), share) if m is None else calibrate(m) if calibrate else 1 / (1 + np.exp(-m))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(s), pa.array((s >= 0.5).astype("i4"))], names=["doc_id", "text_hash", "score", "predicted"])

    out = scored.mapInArrow(run, "doc_id long, text_hash long, score double, predicted int")
    return out.select("doc_id", F.coalesce(bucket(F.col("doc_id"), folds) == held_fold, F.lit(True)).alias("held_out"), "score", "predicted", "text_hash")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text_hash")
