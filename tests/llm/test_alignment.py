"""op11 against the libraries and plain loops."""

import hashlib
import json
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def plain(libraries, text):
    """(ids of A, ids of B, [(start, end) of each token] of both), or None without tokens."""
    a, b = libraries
    if not text:
        return None
    letters = alignment.byte_of_letter()
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    spelled = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]], []
    for i in ids[1]:
        piece = b.id_to_piece(i)
        spelled[1].append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    if any(b"".join(s) != b" " + text.encode() for s in spelled):
        return None
    places = []
    for some in spelled:
        at, own = 0, []
        for t in some:
            own.append((at, at + len(t)))
            at += len(t)
        places.append(own)
    return *ids, *places


def brute(libraries, rows):
    """The rows of the report, by comparing all tokens of a text with each other."""
    found, corpus = [], Counter()
    for _, text in rows:
        p = plain(libraries, text)
        if p is None:
            found.append(None)
            continue
        a, b, at, bt = p
        links, first = [], 0
        for i, (s, e) in enumerate(at):
            while bt[first][1] <= s:
                first += 1
            j = first
            while j < len(bt) and bt[j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        ends = sorted({e for _, e in at} & {e for _, e in bt})
        groups, i, j = [], 0, 0
        for end in ends:
            one, two = [], []
            while i < len(at) and at[i][1] <= end:
                one.append(str(a[i]))
                i += 1
            while j < len(bt) and bt[j][1] <= end:
                two.append(str(b[j]))
                j += 1
            groups.append(",".join(one) + "|" + ",".join(two))
        corpus.update(links)
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    highest = Counter()
    for (_, y), n in corpus.items():
        highest[y] = max(highest[y], n)
    out = []
    for (doc, _), f in zip(rows, found):
        if f is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((doc, *f[:3], len(f[3]), sum(corpus[x] == highest[x[1]] for x in f[3]), sum(corpus[x] for x in f[3]), f[4]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("slice_pairs", [alignment.SLICE, 500])
def test_report_against_brute_force(documents, libraries, slice_pairs):
    some = documents.filter(F.length("text") < 20_000)
    rows = [tuple(r) for r in some.select("doc_id", "text").collect()]
    got = alignment.report(some, A, B, PATTERN, slice_pairs)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(libraries, rows)


@pytest.mark.parametrize("slice_pairs", [alignment.SLICE, 50])
def test_odd_rows(odd, libraries, slice_pairs):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = alignment.report(odd, A, B, PATTERN, slice_pairs)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(libraries, rows)


def test_no_rows(none):
    assert alignment.report(none, A, B, PATTERN).count() == 0


def test_long_texts_are_cut_where_no_token_crosses(libraries, monkeypatch):
    own = alignment.Pair(A, B, PATTERN)
    monkeypatch.setattr(alignment, "STRETCH", 50)
    text = "It's a Straße of naïve words,  don't cut\n\nhere or 12 there; WE'LL see  the rest of it " * 40
    assert len(list(own.stretches(text))) > 30
    p = plain(libraries, text)
    found = own.aligned(text)
    assert (found.a.tolist(), found.b.tolist()) == (p[0], p[1])


@pytest.mark.parametrize("run", ["x" * 6_000, " " * 6_000 + "y", "字" * 5_500, "a \n" * 3_000, "=" * 7_000])
def test_long_runs(libraries, run):
    text = "before " + run + " after"
    assert alignment.Pair(A, B, PATTERN).encode_a(" " + text).tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids


def test_special_strings_and_normalised_texts(spark, libraries):
    texts = ["<|endoftext|> <s> </s> <unk> <0x41>", "low ▁ line", "▁", "tab\tand\x00nul", " two  blanks ", "\U0001f600 é é ﬁ"]
    rows = list(enumerate(texts))
    got = alignment.report(spark.createDataFrame(rows, "doc_id long, text string"), A, B, PATTERN)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(libraries, rows)


def test_aligned_and_group_products(odd, libraries):
    got = alignment.aligned(odd, A, B, PATTERN)
    assert got.columns[: len(odd.columns)] == odd.columns
    products = Counter()
    for r in got.collect():
        p = plain(libraries, r["text"])
        assert [x for g in r["groups"] for x in g["a"]] == (list(p[0]) if p else [])
        assert [x for g in r["groups"] for x in g["b"]] == (list(p[1]) if p else [])
        products.update((x, y) for g in r["groups"] for x in g["a"] for y in g["b"])
        if p:
            overlaps = [(p[0][i], p[1][j]) for i, (s, e) in enumerate(p[2]) for j, (u, v) in enumerate(p[3]) if s < v and u < e] if len(p[0]) < 500 else None
            assert overlaps is None or [(x["a"], x["b"]) for x in r["links"]] == overlaps
    assert {(r["a"], r["b"]): r["n"] for r in alignment.group_products(got).collect()} == dict(products)


def test_vocabulary_in_another_order_is_refused(tmp_path):
    with open(A, encoding="utf-8") as file:
        found = json.load(file)
    found["model"]["merges"] = found["model"]["merges"][::-1]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(found), encoding="utf-8")
    with pytest.raises(ValueError, match="order of its merges"):
        alignment.Pair(str(path), B, PATTERN)
