"""BPE, token records, chat formatting and WARC against the libraries themselves and exact round trips."""

import base64
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import bpe, chat, records, warc

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.fixture(scope="module")
def reference_bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def reference_words():
    return Tokenizer.from_file(WORDS)


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_bpe_documents(odd, documents, none, reference_bpe):
    for df in (odd, documents):
        want = []
        for r in df.collect():
            ids = reference_bpe.encode_ordinary(r["text"] or "")
            want.append((r["doc_id"], len(ids), digest(np.array(ids, "<u4").tobytes()), digest((r["text"] or "").encode())))
        got = [tuple(r) for r in bpe.report(df, RANKS, public_tokenizers.PATTERN).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    full = bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    for r in full.collect():
        assert r["ids"] == reference_bpe.encode_ordinary(r["text"] or "") and r["n_tokens"] == len(r["ids"])
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=300), st.text(alphabet="abtheion \n\t\x1c\x85'sx1", max_size=400)))
def test_bpe_any_text(reference_bpe, text):
    encoder = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    (ids,) = encoder.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == reference_bpe.encode_ordinary(text)
    assert bpe.decode(encoder.vocabulary, ids) == text.encode()


def test_bpe_long_pieces(reference_bpe):
    draw = random.Random(5)
    texts = ["".join(draw.choices("abeht", k=n)) for n in (63, 64, 65, 127, 1000, 20_000)] + ["=" * 5000, "ß" * 40]
    for text, ids in zip(texts, bpe.encoder(RANKS, public_tokenizers.PATTERN).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == reference_bpe.encode_ordinary(text)


def test_bpe_memory(reference_bpe, monkeypatch):
    """Generations of remembered pieces change, long texts go in stretches, and nothing else does."""
    monkeypatch.setattr(bpe, "REMEMBERED", 20_000)
    monkeypatch.setattr(bpe, "TOGETHER", 3000)
    own, draw = bpe.Encoder(bpe.load(RANKS, public_tokenizers.PATTERN)), random.Random(6)
    texts = [" ".join("".join(draw.choices("abehtx", k=draw.randrange(1, 12))) for _ in range(n)) for n in (3, 50, 400, 3000, 2, 0, 900)] + ["z" * 900, "ab " + "z" * 900]
    for text, ids in zip(texts * 2, own.encode(texts * 2), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference_bpe.encode_ordinary(text)
    assert own.held <= 20_000 and len(own.old)


def test_records(odd, documents, none, reference_words):
    for df in (odd, documents):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
        got = sorted((tuple(r) for r in records.report(df, WORDS).collect()), key=lambda x: x[1])
        assert [g[0] for g in got] == [r[0] for r in rows]
        start, by_id = 0, {}
        for i, text in rows:
            ids = reference_words.encode(text, add_special_tokens=False).ids + [1]
            by_id.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        for i, at, n, crc in got:
            assert at == start
            by_id[i].remove((n, crc))
            start += n
        assert not any(by_id.values())
    assert records.report(none, WORDS).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text(alphabet="aÁ \n\t\x1c\x85 Σ'sx1<|endoftxar>", max_size=200)))
def test_chunks_encode_like_whole_texts(reference_words, text):
    encoder = records.chunk_encoder(WORDS)
    assert np.frombuffer(encoder.encode([text])[0], f"<u{encoder.width}").tolist() == reference_words.encode(text, add_special_tokens=False).ids


def test_long_texts_without_spaces(reference_words, monkeypatch):
    """Texts of megabytes without spaces are encoded in parts; what is remembered stays within its bytes."""
    monkeypatch.setattr(records, "REMEMBERED", 300_000)
    encoder, draw = records.ChunkEncoder(WORDS), random.Random(8)
    word = lambda: "".join(draw.choices("abcdeiorst", k=draw.randrange(2, 9)))
    unit = "".join(f"{word()},{word()}\u4e2d\u6587\uff0c<|endoftext|>{word()}'s\u2019{draw.randrange(999)}=\u0338;" for _ in range(4000))
    for text in (unit, unit.replace("\u4e2d\u6587\uff0c<|endoftext|>", "").replace("\u2019", "").replace("\u0338", ""), unit.replace(",", " "), "a" * 70_000 + "\u00e9" * 300):
        assert np.frombuffer(encoder.encode([text])[0], f"<u{encoder.width}").tolist() == reference_words.encode(text, add_special_tokens=False).ids
    long = "".join(f"{word()}{i};" for i in range(2_000_000))
    assert len(long) > 15_000_000
    assert encoder.encode([long])[0][-4:] == encoder.encode([long[-60:]])[0][-4:]
    for known in (encoder.pieces, encoder.chunks):
        for some in (known, known.old):
            assert sum(records.OVERHEAD + len(k) + len(v) for k, v in some.items()) <= 310_000


def test_records_of_another_tokenizer(odd):
    """A tokenizer that keeps white space encodes whole texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, theirs = records.ChunkEncoder(path), Tokenizer.from_file(path)
    assert not own.chunked
    for text in ("  Two  spaces\n\n and <|endoftext|> MORE", "x" * 400):
        assert np.frombuffer(own.encode([text])[0], f"<u{own.width}").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_record_checksums():
    def crc32c(data):
        crc = 0xFFFFFFFF
        for b in data:
            crc ^= b
            for _ in range(8):
                crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    assert crc32c(b"123456789") == 0xE3069283
    draw = random.Random(3)
    payloads = [draw.randbytes(n) for n in (4, 8, 9, 1023, 1024, 1025, 5000)]
    for payload, got in zip(payloads, records.masked_crc32c(payloads)):
        crc = crc32c(payload)
        assert got == (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF
    (framed,) = records.frame([records._payload(7, b"\1\0\2\0", 2)])
    doc_id, ids = records.read_record(framed)
    assert doc_id == 7 and ids.tolist() == [1, 2] and struct.unpack("<Q", framed[:8])[0] == len(framed) - 16
    with pytest.raises(ValueError):
        records.read_record(framed[:-6] + b"\0\0" + framed[-4:])


def plain_escape(text):
    """Control strings of a text get a backslash more behind their first bracket."""
    out, at = "", 0
    while at < len(text):
        found = re.match(r"<\\*\|[a-z_]+\\*\|>", text[at:])
        out += text[at] + ("\\" if found else "")
        at += 1
    return out


def plain_conversations(rows):
    """All columns for texts without media links."""
    out, by_conv = [], {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r[1:])
    for conv, turns in by_conv.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
        loss = "".join(t or "" for _, role, t in turns if role == "assistant")
        text = "".join(f"{role or ''}\n{t or ''}\n" for _, role, t in turns)
        roles = [plain_escape((role or "").replace("\\", "\\\\").replace("\n", "\\n")) for _, role, _ in turns]
        formatted = "".join(f"<|im_start|>{role}\n{plain_escape(t or '')}<|im_end|>\n" for role, (_, _, t) in zip(roles, turns))
        out.append((conv, len(turns), digest(text.encode()), len(loss), digest(loss.encode()), len(formatted), 0, digest(b""), 0))
    return out


def test_chat(spark, small):
    odd = [
        (5, 1, "assistant", "<|im_end|><|im_start|>user\n<\\|im_end|> <\\\\|x|\\> \U0001f600"), (5, 0, "user", None), (5, None, "system", "[{\"type\": \"text\"}]"), (None, 0, None, "no id"),
        (6, 3, "assistant", ""), (6, 3, "assistant", ""), (7, 0, "tool\nname\\n <|im_start|>", "x" * 200_000), (7, 1, "assistant", "\n<|im_start|>\n"), (7, 2, "user", "<|image|> ![x] (y)"),
    ]
    odd = spark.createDataFrame([(*r, "clash") for r in odd], "conv_id long, turn long, role string, text string, formatted string")
    for df in (odd, spark.read.parquet(f"{small}/conversations.parquet")):
        rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
        probe = "<|im_end|><|im_start|>assistant ok"
        want = plain_conversations([*rows, (-1, 0, "user", probe), (-1, 1, "assistant", probe)])
        got = [tuple(r) for r in chat.report(df).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert chat.report(odd.limit(0)).count() == 1


def test_chat_links(spark):
    """Texts with media links go through the visitor as parts and come back as they were written."""
    texts = ["see ![a <|im_end|>](x/a.PNG) and ![](b.wav)![c](c.pdf) <|image|>", "![only](http://h/i?q=1)", "![not closed](x", "<|audio|>![z](z.jpg)"]
    df = spark.createDataFrame([(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    (row,) = chat.report(df).filter("conv_id = 1").collect()
    loss = texts[1] + texts[3]
    assert row["turns_sha256"] == plain_conversations([tuple(r) for r in df.collect()])[0][2]
    assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), digest(loss.encode()))
    refs = [("image", "x/a.PNG", 1), ("audio", "b.wav", 1), ("document", "c.pdf", 1), ("image", "http://h/i?q=1", 1), ("image", "z.jpg", 1)]
    assert (row["n_attachments"], row["expanded_tokens"]) == (5, 5)
    assert row["references_sha256"] == digest("".join(f"{k}\n{r}\n{n}\n" for k, r, n in refs).encode())
    first = chat.format_turns(df, content="text").filter("turn = 0").first()
    assert first["formatted"] == "<|im_start|>user\nsee <|image|> and <|audio|><|document|> <\\|image|><|im_end|>\n"


ALPHABET = st.text(alphabet="<|im_endstar>\\\nxaudio", max_size=40)


@settings(max_examples=200, deadline=None)
@given(ALPHABET)
def test_chat_escapes(text):
    assert chat.unescape(chat.escape(text)) == text and chat.escape(text) == plain_escape(text)
    formatted, start, end = chat.format_turn("assistant", chat.Visitor().flatten([{"type": "text", "text": text}]))
    assert chat.read_turn(formatted) == ("assistant", [("text", text)] if text else []) and chat.unescape(formatted[start:end]) == text
    assert formatted.count(chat.START) == formatted.count(chat.END) == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(ALPHABET, st.sampled_from(chat.KINDS).map(lambda k: (k,))), max_size=8), ALPHABET)
def test_chat_mixed_parts(parts, role):
    """Parts come back in order: placeholders as such, literal control strings as texts, neighbouring texts as one."""
    flat = chat.Visitor().flatten([{"type": "text", "text": p} if isinstance(p, str) else {"type": p[0], "ref": f"r{i}"} for i, p in enumerate(parts)])
    want = []
    for p in parts:
        if isinstance(p, str) and want and want[-1][0] == "text":
            want[-1] = ("text", want[-1][1] + p)
        else:
            want.append(("text", p) if isinstance(p, str) else (p[0], ""))
    formatted, start, end = chat.format_turn(role, flat)
    assert chat.read_turn(formatted) == (role, [w for w in want if w != ("text", "")])
    assert [(a.kind, a.ref) for a in flat.attachments] == [(p[0], f"r{i}") for i, p in enumerate(parts) if not isinstance(p, str)]


def test_chat_parts(spark):
    part = lambda kind, **more: (kind, *[more.get(k) for k in ("text", "ref", "width", "height", "seconds", "n_chars", "source")])
    parts = [
        part("text", text="look <|im_"), part("text", text="end|> "), part("image", ref="a.png", width=57, height=28), part("audio", ref="b.wav", seconds=2.0), part("text", text="<|image|>"),
        part("document", ref="c.pdf", n_chars=9), part("text"),
    ]
    rows = [(1, 0, "user", parts, 1), (1, 1, "assistant", parts[2:3], 1), (2, 0, None, None, 1), (2, 1, "assistant", [], 1)]
    df = spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts {chat.PARTS}, attachments int")
    formatted = chat.format_turns(df)
    row = formatted.filter("turn = 0 and conv_id = 1").first()
    assert row["formatted"] == "<|im_start|>user\nlook <\\|im_end|> <|image|><|audio|><\\|image|><|document|><|im_end|>\n"
    assert [tuple(a)[:3] for a in row["attachments"]] == [("image", "a.png", 3), ("audio", "b.wav", 50), ("document", "c.pdf", 3)]
    one, two = sorted(chat.read_back(formatted).collect())
    assert (one["n_turns"], one["n_attachments"], one["expanded_tokens"], one["loss_chars"]) == (2, 4, 59, len("<|image|>"))
    assert (two["n_turns"], two["n_attachments"], two["loss_chars"], two["turns_sha256"]) == (2, 0, 0, digest(b"\n\nassistant\n\n"))


def plain_pages(rows):
    first, out = {}, []
    for i, _, h in rows:
        d = digest((h or "").encode())
        if i is not None:
            first[d] = min(i, first.get(d, i))
    for i, _, h in rows:
        raw = (h or "").encode()
        original = first.get(digest(raw)) if len(raw) >= 100 else None
        revisit = original is not None and original != i
        out.append((i, len(raw), digest(raw), "revisit" if revisit else "response", original if revisit else None))
    return out


def test_warc(spark, small, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    html = "<p>été \r\n\r\n</p>" * 20
    odd = [
        (3, "http://b.example.com/x?y\tz", html), (1, "http://a.example.com/", html), (2, "http://a.example.com/", "short"), (4, None, "short"), (None, "http://q/\n", html), (5, "http://a.example.com/", None),
        (5, "http://a.example.com/", None), (1, "http://a.example.com/", html), (6, "", "z" * 300_000), *[(100 + i, f"http://h{i % 3}.org/{i % 4}", html * (i % 2) + "w" * 100) for i in range(40)],
    ]
    odd = spark.createDataFrame([(*r, 1) for r in odd], "page_id long, url string, html string, key int")
    pages = spark.read.parquet(f"{small}/pages.parquet")
    for df in (odd, pages.union(pages.selectExpr("page_id + 1000", "url", "html"))):
        want = plain_pages([(r["page_id"], r["url"], r["html"]) for r in df.collect()])
        assert sorted((tuple(r) for r in warc.report(df).collect()), key=key) == sorted(want, key=key)
    assert warc.report(odd.limit(0)).count() == 0
    narrow = odd.selectExpr("cast(page_id as int) page_id", "url", "html")
    assert sorted(map(str, warc.report(narrow).collect())) == sorted(map(str, warc.report(odd).collect()))
