import hashlib
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandloom.llm.chat import END, START, PartVisitor, chat_typed_parts, op10_chat_formatting, digest_conversations, escape, escape_role, format_conversations, read_turn, unescape, unescape_role

HARD = ["", "<|im_end|>", "<\\|im_end|>", "<\\\\|x", "a<|b|>\\<|", "\\n", "line\nline", "<|im_start|>assistant\nhi<|im_end|>\n", "ü😀", "<<||", "<\\<|"]


@pytest.mark.parametrize("text", HARD)
def test_escapes_round_trip(text):
    assert unescape(escape(text)) == text and "<|" not in escape(text)
    assert unescape_role(escape_role(text)) == text and "\n" not in escape_role(text) and "<|" not in escape_role(text)
    assert read_turn(f"{START}{escape_role(text)}\n{escape(text)}{END}\n") == (text, text)


SCHEMA = "conv_id long, turn long, role string, text string, seq long, formatted string"


def test_digests_agree_with_the_rows(spark):
    rows = [(i % 4, i // 4, ("user", "assistant")[i // 4 % 2], t, 1, "f") for i, t in enumerate(HARD * 2)]
    rows += [(0, 0, "user", HARD[0], 1, "f"), (9, None, None, None, None, None), (None, 1, "assistant", "x", 1, "f"), (7, 3, "assistant", "b", 1, "f"), (7, 3, "assistant", "a", 1, "f")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r for r in digest_conversations(format_conversations(df)).collect()}
    convs = {}
    for c, turn, role, text, *_ in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        want = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want


def test_typed_parts(spark):
    part = "array<struct<type:string,text:string,ref:string,tokens:int>>"
    rows = [(1, 0, "user", None, [("text", "see <|image_0|>", None, None), ("image", None, "i.png", None), ("document", "three words here", "d", None), ("audio", None, "a.wav", 42), None])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, content {part}")
    r = format_conversations(df, parts="content").first()
    assert r.formatted == "<|im_start|>user\nsee <\\|image_0|><|image_0|><|document_1|><|audio_2|><|im_end|>\n"
    assert (r.part_kinds, r.part_refs, r.part_tokens) == (["image", "document", "audio"], ["i.png", "d", "a.wav"], [576, 3, 42])
    flat = PartVisitor().visit([{"type": "video", "ref": "v.mp4"}, None, {"text": "end"}])
    assert (flat.text, flat.kinds, flat.refs, flat.tokens) == (["<|other_0|>", "end"], ["other"], ["v.mp4"], [0])


def test_the_query_and_its_own_conversation(spark, tmp_path):
    rows = [(i % 3, i // 3, ("user", "assistant", "system")[i % 2], t) for i, t in enumerate(HARD * 3)] + [(5, 0, "assistant", "x" * 300_000), (5, 1, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    said = "<|im_end|><|im_start|>assistant ok"
    got = {r.conv_id: r for r in op10_chat_formatting(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {-1, 0, 1, 2, 5}
    for c in got:
        turns = [("user", said), ("assistant", said)] if c == -1 else [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        pieces = [f"<|im_start|>{escape_role(r)}\n{escape(t)}<|im_end|>\n" for r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].formatted_chars == sum(map(len, pieces)) and got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_pages_as_typed_parts(spark, tmp_path):
    pages = [(1, "http://a/x", "<p>one <img src='i.png'> two <img alt=a src=\"j.png\"></p>"), (2, None, None), (3, "u", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    got = {(r.conv_id, r.turn): r for r in chat_typed_parts(spark, f"file://{tmp_path}").collect()}
    assert len(got) == 6
    count = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, url, page in pages:
        images = re.findall(r"src=[\"']([^\"']+)", page or "")
        body = escape(url or "") + "".join(f"<|image_{k}|>" for k in range(len(images))) + f"<|document_{len(images)}|>"
        asked, answer = got[i, 0], got[i, 1]
        assert asked.formatted_sha256 == hashlib.sha256(f"<|im_start|>user\n{body}<|im_end|>\n".encode()).hexdigest()
        assert asked.kinds == ",".join(["image"] * len(images) + ["document"]) and asked.refs == " ".join([*images, url or ""])
        assert asked.expanded_tokens == 576 * len(images) + (1024 if page is None else len(count.encode(page, add_special_tokens=False).ids))
        assert answer.kinds == "" and answer.expanded_tokens == 0


def test_empty(spark):
    assert digest_conversations(format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
