"""Exact token ids with a bounded cache of words.

For the two tokenizer families below the text may be cut at single blanks and newlines
without changing any id, because their pre-tokenizers always end a piece there. Every word
not seen before is encoded by the tokenizers library: a word of letters is one piece for its
pre-tokenizer too, so it goes straight to the library's model; repeated words come from the
cache. Texts with any other white space, and all other tokenizers, are encoded whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept by a worker for a tokenizer; at about 220 bytes each, a bound of 55 MB.
CACHE_WORDS = 250_000
LONGEST_CACHED = 48
#: Texts are cut into words together up to so many characters, or one longer text.
CHARS_AT_ONCE = 4_000_000
#: Signs that are a piece of their own after a word of letters.
_TAIL = ".,;:!?#$%&*)"
_PACK = [struct.Struct(f"<{n}I").pack for n in range(LONGEST_CACHED)]
#: Marks of words that no blank leads, neither of them in a word: a text's first, and one that a newline leads.
_BARE, _LINE = "\t", "\n"


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> "Encoder":
    return Encoder(path)


class Encoder:
    """ids(texts): little-endian unsigned 32-bit ids of each whole text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = _kind(json.loads(self.tokenizer.to_str()))
        self.cache: dict[str, bytes] = {}
        self.newline = self._encode([_LINE])[0] if self.kind == "blank" else b""
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printed]
        self.bytes = {b: chr(256 + k) for k, b in enumerate(rest)}  # the byte alphabet: printed bytes stand for themselves
        self.lead = " " if self.kind == "blank" else ""

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, word: str, lead: str) -> bytes | None:
        """Ids of a word that is nothing but letters, after normalising too; else None."""
        text = word
        if self.normalizer is not None:
            text = word.lower() if word.isascii() else self.normalizer.normalize_str(word)
            if not text.isalpha():
                return None
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.bytes)
        ids = [t.id for t in self.model.tokenize(lead + text)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, dtype="<u4").tobytes()

    def _fill(self, words: Iterable[str]) -> list[str]:
        """Puts the ids of words that it lacks into the cache; returns those too long to stay there."""
        cache, lead, others, ends, long = self.cache, self.lead.translate(self.bytes), {}, {}, []
        for w in words:
            if len(w) > LONGEST_CACHED:
                long += {w, w.rstrip(_TAIL)}
            if w[0] in "\t\n":
                others[w] = w[1:]
                continue
            core = w.rstrip(_TAIL)
            if not core.isalpha():
                others[w] = self.lead + w
                continue
            ids = cache.get(core)
            if ids is None:
                ids = self._letters(core, lead)
                if ids is None:
                    others[w] = self.lead + w
                    continue
                cache[core] = ids
            if len(core) < len(w):
                tail = w[len(core) :]
                if tail not in ends:
                    ends[tail] = self._encode([tail])[0]
                cache[w] = ids + ends[tail]
        for w, ids in zip(others, self._encode([*others.values()])):
            cache[w] = self.newline + ids if w[0] == _LINE else ids
        return long

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        rows: list[int] = []
        marked: list[str] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            flat = text.replace("\n", " ") if self.kind else text
            if not self.kind or not _plain(flat):
                out[i] = self._encode([text])[0]
                continue
            rows.append(i)
            marked.append(_BARE + text.replace("\n", " \n") if self.kind == "blank" else flat)
            size += len(text)
            if size >= CHARS_AT_ONCE:
                self._by_word(rows, marked, out)
                rows, marked, size = [], [], 0
        if rows:
            self._by_word(rows, marked, out)
        return out

    def _by_word(self, rows: list[int], marked: list[str], out: list[bytes]) -> None:
        """Ids of texts with a blank between words: the different words' ids, gathered in the words' order."""
        cut = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
        coded = cut.values.dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        long = self._fill({*words}.difference(self.cache))
        found = [*map(self.cache.__getitem__, words)]
        for w in long:
            self.cache.pop(w, None)
        while len(self.cache) > CACHE_WORDS:  # the last added go first
            self.cache.popitem()
        ids = np.frombuffer(b"".join(found), "<u4")
        n = np.fromiter(map(len, found), "i8", len(found)) // 4
        first, each = (np.cumsum(n) - n)[at], n[at]
        ends = np.zeros(len(at) + 1, "i8")
        np.cumsum(each, out=ends[1:])
        gathered = ids[np.repeat(first - ends[:-1], each) + np.arange(ends[-1])].tobytes()
        borders = (4 * ends[cut.offsets.to_numpy()]).tolist()
        for i, lo, hi in zip(rows, borders, borders[1:]):
            out[i] = gathered[lo:hi]


def _plain(text: str) -> bool:
    """Has no white space but single blanks between words."""
    if text.isprintable():
        return "  " not in text and text[0] != " " and text[-1] != " "
    return " ".join(text.split()) == text


def _kind(spec: dict) -> str:
    """'blank': a leading blank belongs to the word; 'word': blanks are dropped; '': no cutting."""
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
        return ""
    before, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
    if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and norm is None:
        return "blank"
    steps = before.get("pretokenizers", [])
    norms = [n["type"] for n in (norm or {}).get("normalizers", [])]
    if (
        [s["type"] for s in steps] == ["Split", "ByteLevel"]
        and steps[0]["behavior"] == "Removed"
        and steps[0]["invert"]
        and steps[0]["pattern"]["Regex"].endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and not steps[1]["use_regex"]
        and not steps[1]["add_prefix_space"]
        and set(norms) <= {"NFC", "Replace", "Lowercase"}
    ):
        return "word"
    return ""


def encoded(batches: Iterator, path: str, end_id: int, text: str = "text") -> Iterator[tuple]:
    """(batch, ids with the end id) for Arrow batches that have a text column; null: empty."""
    end = np.array([end_id], dtype="<u4").tobytes()
    enc = encoder(path)
    for batch in batches:
        yield batch, [x + end for x in enc.ids(batch.column(text).to_pylist())]
