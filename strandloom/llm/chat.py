"""Chat formatting with typed content parts (operator 10).

A visitor flattens the parts of a turn (text, image, audio, document) into text with ordered
placeholders, and records what each placeholder refers to and how many tokens it expands to.
The template marks turns; control strings inside texts and roles are escaped by a backslash
that can be taken out again, so the output can be read back without loss.

Defined results. Turns are ordered by turn, nulls first, ties by the formatted piece; repeated
rows are repeated turns; a null text or role counts as empty; rows with a null conv_id form
one conversation; a null part is left out, and a part of an unknown type becomes a placeholder
of kind other with its reference and no tokens unless it gives some; an empty table gives no
row; other columns are left out, whatever their names. A row is formatted where it lies; only
digesting deals rows by conversation, and streams them in order, so a very long conversation
never sits in memory (its digest is one sequential hash).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import store

START, END = "<|im_start|>", "<|im_end|>"
_MARK = re.compile(r"<(\\*)\|")
_MARKED = re.compile(r"<\\(\\*)\|")
#: Tokens that a placeholder expands to where the part doesn't say: fixed values.
EXPANDED = {"image": 576, "audio": 375, "document": 1024}


def escape(text: str) -> str:
    """No '<|' is left; each '<', backslashes, '|' gets one more backslash."""
    return _MARK.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _MARKED.sub(r"<\1|", text) if "<" in text else text


def escape_role(role: str) -> str:
    """As escape(), and on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


@dataclass
class Flat:
    """What the visitor has made of a turn's parts."""

    text: list[str] = field(default_factory=list)
    refs: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    tokens: list[int] = field(default_factory=list)


class PartVisitor:
    """Visits parts in order; a part is a dict with type, text, ref and tokens."""

    def __init__(self, count: Callable[[str], int] | None = None) -> None:
        self.count = count or (lambda text: len(text.split()))

    def visit(self, parts: list[dict | None] | None, flat: Flat | None = None) -> Flat:
        flat = flat or Flat()
        for part in parts or []:
            if part is not None:
                getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part, flat)
        return flat

    def visit_text(self, part: dict, flat: Flat) -> None:
        flat.text.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict, flat: Flat) -> None:
        self._place("image", part, flat, part.get("tokens"))

    def visit_audio(self, part: dict, flat: Flat) -> None:
        self._place("audio", part, flat, part.get("tokens"))

    def visit_document(self, part: dict, flat: Flat) -> None:
        given = part.get("tokens")
        self._place("document", part, flat, self.count(part["text"]) if given is None and part.get("text") is not None else given)

    def visit_other(self, part: dict, flat: Flat) -> None:
        self._place("other", part, flat, part.get("tokens") or 0)

    def _place(self, kind: str, part: dict, flat: Flat, tokens: int | None) -> None:
        flat.text.append(f"<|{kind}_{len(flat.refs)}|>")
        flat.refs.append(part.get("ref") or "")
        flat.kinds.append(kind)
        flat.tokens.append(EXPANDED.get(kind, 0) if tokens is None else int(tokens))


_FORMATTED = "formatted string, loss_from long, loss_to long, part_kinds array<string>, part_refs array<string>, part_tokens array<long>"


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """One row per turn: conv_id, turn, its formatted piece, where the loss mask lies in it, and its attachments.

    parts: an array of struct<type,text,ref,tokens> column that stands for the text where it
    isn't null. tokenizer: the file that counts the tokens of attached documents; words are
    counted without one. The loss mask covers assistant texts. A conversation is its pieces
    in order of turn.
    """
    store.small_batches(df.sparkSession)
    cols = [F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")]
    if parts:
        cols.append(F.col(parts).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor = PartVisitor(_counter(tokenizer) if tokenizer else None)
        for batch in batches:
            out: list[tuple] = []
            given = batch.column("parts").to_pylist() if parts else [None] * batch.num_rows
            for r, t, p in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), given):
                flat = visitor.visit([{"type": "text", "text": t}] if p is None else p)
                head, body = f"{START}{escape_role(r)}\n", "".join(flat.text)
                out.append((f"{head}{body}{END}\n", len(head), len(head) + len(body) * (r == "assistant"), flat.kinds, flat.refs, flat.tokens))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()))
            made = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *made], names=["conv_id", "turn", *(c.split()[0] for c in _FORMATTED.split(", "))])

    return df.select(*cols).mapInArrow(run, f"conv_id long, turn long, {_FORMATTED}")


def _counter(tokenizer: str) -> Callable[[str], int]:
    from strandloom.llm.tokens import encoder

    return lambda text: len(encoder(tokenizer).ids([text])[0]) // 4


def read_turn(piece: str) -> tuple[str, str]:
    """(role, text) of a formatted piece."""
    head, _, body = piece.removeprefix(START).partition("\n")
    return unescape_role(head), unescape(body.removesuffix("\n").removesuffix(END))


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Parse formatted turns and digest each conversation, streaming over its sorted pieces."""
    spark = formatted.sparkSession
    rows = formatted.select("conv_id", "turn", "formatted", "loss_from", "loss_to").repartition(store.partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def done(s: dict) -> tuple:
            return s["conv"], s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["all"]

        for batch in batches:
            out = []
            for c, piece, a, b in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_from", "loss_to"))):
                if now is None or c != now["conv"]:
                    if now is not None:
                        out.append(done(now))
                    now = {"conv": c, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
                role, text = read_turn(piece)
                masked = unescape(piece[a:b])
                now["n"] += 1
                now["turns"].update(f"{role}\n{text}\n".encode())
                now["chars"] += len(masked)
                now["loss"].update(masked.encode())
                now["all"] += len(piece)
            if out:
                yield _digests(out)
        if now is not None:
            yield _digests([done(now)])

    return rows.mapInArrow(run, _DIGEST)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _DIGEST.split(", ")])


def page_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, text, content: each page as a user's turn with its address, its images and the page as an attached document, and an answer."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")

    def part(kind: str, text: Column, ref: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"), ref.cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens"))

    none = F.lit(None)
    images = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"<img[^>]*\bsrc=[\"']?([^\"' >]+)"), F.lit(1)), lambda ref: part("image", none, ref))
    asked = F.concat(F.array(part("text", F.col("url"), none)), images, F.array(part("document", F.col("html"), F.col("url"))))
    user = pages.select(F.col("page_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit(None).cast("string").alias("text"), asked.alias("content"))
    answer = pages.select(F.col("page_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.col("url").alias("text"), F.lit(None).cast(user.schema["content"].dataType).alias("content"))
    return user.unionByName(answer)


def chat_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a conversation with attachments: their kinds, references and expanded token counts."""
    import public_tokenizers

    turns = format_conversations(page_conversations(spark, sf_dir), parts="content", tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
    tokens = F.aggregate("part_tokens", F.lit(0).cast("long"), lambda acc, n: acc + n)
    return turns.select("conv_id", "turn", F.sha2("formatted", 256).alias("formatted_sha256"), F.array_join("part_kinds", ",").alias("kinds"), F.array_join("part_refs", " ").alias("refs"), tokens.alias("expanded_tokens"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digest_conversations(store.stored(format_conversations(rows.unionByName(extra)), "formatted"))
