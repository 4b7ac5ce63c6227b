"""op12 against a plain version: every pair of sources, every kept term."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tessella.llm import divergence

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least_documents, top):
    """rows: (text, lang, source)."""
    docs, counts, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = WORD.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        docs.update((lang, w) for w in set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(w for (x, w), n in docs.items() if x == lang and n >= least_documents)
        sources = sorted(s for x, s in groups if x == lang)
        in_lang = Counter()
        for s in sources:
            in_lang.update(counts[lang, s])

        def shares(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 5) // (total + 5 * len(kept)) for w in kept}

        of, q = {s: shares(counts[lang, s]) for s in sources}, shares(in_lang)
        for s in sources:
            pairs = [(sum(abs(of[s][w] - of[o][w]) for w in kept), o) for o in sources if o != s]
            words = [(of[s][w] - q[w], w) for w in kept if counts[lang, s][w] and of[s][w] > q[w]]
            for part, some, most in (("pair", pairs, None), ("term", words, top)):
                order = sorted(some, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(order)]
    return sorted(out)


def got(df, **options):
    return sorted(map(tuple, divergence.report(df, **options).collect()))


def test_odd_rows(odd):
    rows = [tuple(r) for r in odd.select("text", "lang", "source").collect()]
    assert got(odd, least_documents=2, top=3) == plain(rows, 2, 3)


@pytest.mark.parametrize("shard, block", [(divergence.SHARD, divergence.BLOCK), (7, 2), (1, 1)])
def test_many_sources_in_shards_and_blocks(spark, shard, block):
    deal = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Élan", "élan", "É", "ZÜG", "züg"]
    rows = []
    for _ in range(400):
        source = deal.choice(["hot"] * 6 + [f"s{i}" for i in range(9)] + [None, ""])
        text = " ".join(deal.choices(words, weights=range(1, 66), k=deal.choice([0, 1, 5, 30])))
        rows.append((text, deal.choice(["en", "en", "de", None]), source))
    rows += [("!! 12 34", "en", "no terms"), (None, "xx", "alone"), ("rare", "yy", "a"), ("other", "yy", "b")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert got(df, least_documents=8, shard=shard, block=block) == plain(rows, 8, 50)


def test_counts_are_given_away_when_many_are_held(spark, monkeypatch):
    rows = [(" ".join(f"{chr(97 + i)}{chr(97 + j)}" for j in range(20)), "en", f"s{i % 3}") for i in range(20)] * 3
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(1)
    monkeypatch.setattr(divergence, "HELD", 10)
    assert got(df, least_documents=2) == plain(rows, 2, 50)


def test_no_rows(none):
    assert got(none) == []


def test_shares_are_exact_beyond_a_double(spark):
    df = spark.createDataFrame([(4_000_000_000_000_000_003, 9_000_000_000_000_000_007, 1_000_003)], "n long, total long, v long")
    found = df.select(divergence.share(df.n, df.total, df.v)).first()[0]
    assert found == 1 + 10**9 * (4_000_000_000_000_000_003 + 5) // (9_000_000_000_000_000_007 + 5 * 1_000_003)


def test_terms_are_ascii_letters_and_all_beyond_ascii():
    assert [t.decode() for t in divergence.terms("A-b_C É\x7fz\x85x 9a@[`{")] == ["a", "b", "c", "É", "z\x85x", "a"]
