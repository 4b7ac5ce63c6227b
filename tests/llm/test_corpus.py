"""SimHash near-dedup, document fingerprints, mixing and the pipeline against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import fingerprints, mixing, simhash
from tessella.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def key(row):
    return tuple((v is None, str(v)) for v in row)


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=4):
    """The component (as a representative) of each fingerprint, by comparing all pairs."""
    values = np.array(sorted(set(fps)), dtype=np.uint64)
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i:] ^ values[i]) <= radius).tolist():
            a, b = sorted((root(i), root(i + j)))
            parent[b] = a
    return {int(v): root(i) for i, v in enumerate(values)}


def plain_clusters(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    of = plain_components(fps)
    first = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            first[of[f]] = min(i, first.get(of[f], i))
    return [(i, f"{f:016x}", first.get(of[f])) for (i, _), f in zip(rows, fps)]


def near_copies(spark):
    """Long texts, each with chains of copies that differ by a word more each time."""
    draw = random.Random(11)
    rows = []
    for group in range(6):
        words = [f"g{group}w{draw.randrange(10**6)}" for _ in range(900)]
        for copy in range(5):
            rows.append((len(rows) * 7 % 1000, " ".join(words)))
            words[draw.randrange(900)] = f"changed{copy}"
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_simhash(spark, odd, documents, none):
    for df in (odd, documents, near_copies(spark)):
        want = plain_clusters([(r["doc_id"], r["text"]) for r in df.collect()])
        got = [tuple(r) for r in simhash.report(df).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert len({w[2] for w in want}) < 20
    assert simhash.report(none).count() == 0


def chained_fingerprints(bits=64, count=400):
    draw = random.Random(2)
    fps = [draw.getrandbits(bits) for _ in range(100)]
    for _ in range(count):  # chains within the radius, and neighbours just beyond it
        f = draw.choice(fps)
        for b in draw.sample(range(bits), draw.choice((1, 2, 3, 4, 5, 6))):
            f ^= 1 << b
        fps.append(f)
    dense = draw.getrandbits(bits)
    return sorted({*fps, *(dense ^ m for m in simhash.masks(8, 8))})


def grouped(labels):
    groups = defaultdict(set)
    for f, label in labels.items():
        groups[label].add(f)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize(("radius", "at_a_time"), [(4, simhash.AT_A_TIME), (4, 3000), (3, simhash.AT_A_TIME), (3, 3000), (2, 3000), (5, simhash.AT_A_TIME), (1, 300), (0, 300)])
def test_links_of_dense_and_random_fingerprints(spark, radius, at_a_time):
    """Components of links equal those of all pairs, for even and odd radii, also where tasks must split groups."""
    fps = chained_fingerprints(count=100 if radius == 5 else 400)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = simhash.links(nodes, radius, at_a_time)
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= radius for r in found.collect())
    labels = {f: f"alone{f}" for f in fps} | {r["node"] & (1 << 64) - 1: r["label"] for r in simhash.components(found).collect()}
    assert grouped(labels) == grouped(plain_components(fps, radius))


def test_meetings_of_split_groups():
    """Where groups are split the links are the same; where few meet all pairs are links."""
    fps = chained_fingerprints()
    rows = np.array(fps, dtype=np.uint64)
    labels, rest = rows.view(np.int64), np.full(len(rows), 2)
    found = []
    for limit in (simhash.AT_A_TIME, 20_000):
        every = np.concatenate(simhash._links(rows, labels, rest, 64, {}, False, simhash.FEW, limit))
        found.append(simhash._counted(every[:, :2], every[:, 2]))
    assert (found[0] == found[1]).all()
    pairs = {(max(a, b), min(a, b)) for i, a in enumerate(labels.tolist()) for b in labels[:i].tolist() if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    kept = simhash._forest(found[0], simhash.FEW)
    some = {(max(a, b), min(a, b)): large for a, b, large in kept.tolist()}
    assert some.keys() <= pairs
    ends = {x for p, large in some.items() if large for x in p}
    assert pairs - some.keys() == {p for p in pairs - some.keys() if p[0] in ends and p[1] in ends} and pairs - some.keys()


def test_components_of_long_paths(spark):
    edges = [(i + 1, i) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 300)] + [(-5, 7)]
    out = {r["node"]: r["label"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(out) == 201 + 300 + 1 and {out[i] for i in range(201)} == {-5} and {out[1000 + i] for i in range(300)} == {1000}


def plain_shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def edited_groups(spark):
    """Groups of texts edited at random words (near and less near), and texts that share a third with others."""
    draw = random.Random(7)
    rows, make = [], lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    for group in range(25):
        words = make(draw.choice((40, 150, 600)))
        for share in (0.0, 0.005, 0.01, 0.015, 0.02, 0.1):
            rows.append((len(rows), " ".join(w if draw.random() >= share else f"e{draw.randrange(10**6)}" for w in words)))
    shared = make(100)
    rows += [(1000 + i, " ".join(shared + make(200))) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_deduplicated(spark, odd, documents, none):
    for df in (odd, documents, edited_groups(spark)):
        out = simhash.deduplicated(df)
        rows, kept = df.collect(), out.collect()
        assert out.columns == df.columns
        sets = [plain_shingles(r["text"]) for r in rows]
        left = [plain_shingles(r["text"]) for r in kept]
        # Of texts that are alike one stays (a few pairs at the limit may be missed); no text goes without a like one.
        alike = [(a, b) for i, a in enumerate(left) for b in left[:i] if jaccard(a, b) >= 0.8]
        pairs = sum(jaccard(a, b) >= 0.8 and a != b for i, a in enumerate(sets) for b in sets[:i])
        assert len(alike) <= 0.05 * pairs
        ids = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept)
        assert len(ids) == len(set(ids))
        for r, own in zip(rows, sets):
            if (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") not in ids:
                assert any(jaccard(own, other) >= 0.8 for s, other in zip(rows, sets) if s is not r)
    assert {r["doc_id"] for r in kept} >= set(range(1000, 1060))
    clash = edited_groups(spark).select("*", *[F.lit(n).alias(n) for n in ("_id", "_none", "_text", "_row", "node", "label")])
    again = simhash.deduplicated(clash)
    assert again.columns == clash.columns and {r["doc_id"] for r in again.collect()} == {r["doc_id"] for r in kept}
    assert simhash.deduplicated(none).count() == 0


def test_deduplicated_in_a_large_family(spark):
    """Thousands of texts share a passage and are less than alike (0.68 to 0.73); the alike ones among them are found."""
    draw = random.Random(11)
    make = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    passage, rows = make(250), []
    for i in range(2400):
        rows.append((i, " ".join(passage + make(draw.randrange(47, 58)))))
    for i in range(60):
        words = rows[i * 40][1].split()
        rows.append((10_000 + i, " ".join(words[:-15] + make(15))))
    sets = {i: plain_shingles(t) for i, t in rows}
    twins = [(i * 40, 10_000 + i) for i in range(60)]
    assert all(jaccard(sets[a], sets[b]) >= 0.85 for a, b in twins)
    assert all(0.67 <= jaccard(sets[1], sets[b]) < 0.74 for b in range(2, 2400))
    stay = {r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    lost = [b for a, b in twins if b in stay]
    assert stay >= set(range(2400)) and len(lost) <= 1, len(lost)


def test_rows_and_chance_partners_of_a_text_are_bounded():
    """Neither grows much with the number of texts: 10^4 to 10^11 of them."""
    found = {n: (simhash.shape_for(10**n), simhash.rows_of_a_text(10**n), simhash.chance_partners(10**n)) for n in range(4, 12)}
    assert [rows for _, rows, _ in found.values()] == [49, 49, 49, 13, 22, 36, 71, 118]
    assert all(chance <= 1e-5 for _, _, chance in found.values())
    for n, (shape, _, _) in found.items():
        group = 10**n / 2**shape.agree
        variants = len(simhash.masks(simhash.BALL_BITS, simhash.TABLE_RADIUS // 2))
        assert group <= simhash.GROUP and group * variants / 2**simhash.BALL_BITS <= 0.25  # texts of a variant


def test_random_sketches_make_no_family(spark):
    """As many unlike texts in a variant as the largest corpus has: none is a pair, so none is in a family."""
    draw, shape = np.random.default_rng(4), simhash.Shape(5, simhash.BALL_BITS)
    rows = 300_000
    sketch = draw.integers(0, 2**simhash.BALL_BITS, size=(rows, shape.tables))
    # 29 bits alone are random in the first table: a variant there has as many texts as in a group of 2.4 million.
    sketch[:, 0] &= (1 << 29) - 1
    nodes = spark.createDataFrame(pd.DataFrame({"node": np.arange(rows), "sketch": sketch.tolist()}), "node long, sketch array<long>").repartition(4)
    found = simhash.meetings(nodes, shape)
    assert found.count() == 0


@pytest.mark.parametrize("count", [1000, 10**9])
def test_sketches_tell_similarity(count):
    draw, shape = random.Random(9), simhash.shape_for(count)
    assert shape == ((7, 32, 0, 14) if count == 1000 else (36, 41, 9, 36))
    for similarity, low, high in ((0.85, 0.98, 1.0), (0.8, 0.92, 1.0), (0.6, 0.0, 0.15), (0.0, 0.0, 0.0)):
        hit = 0
        for _ in range(200):
            n = 400
            common = round(2 * n * similarity / (1 + similarity))
            both = np.array([draw.getrandbits(64) for _ in range(2 * n - common)], dtype=np.uint64)
            a, b = simhash.sketch(both[:n], shape), simhash.sketch(np.concatenate([both[:common], both[n:]]), shape)
            near = any((x ^ y) >> simhash.BALL_BITS == 0 and (x ^ y).bit_count() <= simhash.TABLE_RADIUS for x, y in zip(a[: shape.tables], b))
            hit += near and sum((x ^ y).bit_count() for x, y in zip(a, b)) <= simhash.most_bits(0.8, shape)
        assert low <= hit / 200 <= high


def plain_votes(text):
    """The fingerprint by its definition: terms of five words, weighed by 1 + floor(log2 n), vote bit by bit."""
    full, words = (1 << 64) - 1, WORD.findall(text.translate(LOWER))

    def mixed(h, factor):
        h = (h ^ h >> 32) * factor & full
        h = (h ^ h >> 29) * factor & full
        return h ^ h >> 32

    odd = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)
    counts = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else {}
    votes = [0] * 128
    for term, n in counts.items():
        h = (len(term) + sum(mixed(xxhash.xxh3_64_intdigest(w.encode()), f) for w, f in zip(term, odd))) & full
        bits = mixed(h, 0xD6E8FEB86659FD93) << 64 | mixed(h, 0xA0761D6478BD642F)
        for b in range(128):
            votes[b] += n.bit_length() if bits >> 127 - b & 1 else -n.bit_length()
    return sum(1 << 127 - b for b in range(128) if votes[b] > 0)


def plain_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    like = lambda a, b: 1 - (a ^ b).bit_count() / 128
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        changed = t[: len(t) - half] + n[:half]
        own, other = plain_votes(t), plain_votes(changed)
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), f"{own:032x}", f"{other:032x}", like(own, other), like(own, plain_votes(n))))
    return out


def test_fingerprints(spark, odd, documents, none):
    distinct_ids = odd.filter("doc_id is null or doc_id not in (1, 8)")
    for df in (distinct_ids, documents, documents.limit(1)):
        rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        found = fingerprints.report(df).collect()
        got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in found]
        assert sorted(got, key=key) == sorted(plain_next(rows), key=key)
        values = [int(r["fingerprint"], 16) for r in found]
        for r in found:
            near = sum((int(r["fingerprint"], 16) ^ v).bit_count() <= 6 for v in values)
            assert r["n_near"] == (near if r["doc_id"] is not None and r["doc_id"] % 50 == 0 else None)
    assert fingerprints.report(none).count() == 0
    # Equal ids: some order by text, which reruns keep; each row has the fingerprint of its text.
    again = odd.union(odd.filter("doc_id = 8"))
    got = [tuple(r) for r in fingerprints.report(again).collect()]
    assert sorted(got, key=key) == sorted((tuple(r) for r in fingerprints.report(again.repartition(5)).collect()), key=key)
    want = Counter((r["doc_id"], f"{plain_votes(r['text'] or ''):032x}") for r in again.collect())
    assert Counter((r[0], r[3]) for r in got) == want
    narrow = documents.select(F.col("doc_id").cast("int").alias("doc_id"), "text").limit(50)
    assert fingerprints.report(narrow).schema["doc_id"].dataType.typeName() == "integer" and fingerprints.report(narrow).count() == 50


def test_edits_are_nearer_than_others(documents):
    rows = fingerprints.compare_with_next(documents.filter("n_chars > 200")).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.97 * len(rows)


def test_search_finds_all_within_the_radius(spark):
    draw = random.Random(4)
    base = [draw.getrandbits(128) for _ in range(60)]
    for _ in range(500):
        f = draw.choice(base)
        for b in draw.sample(range(128), draw.randrange(0, 10)):
            f ^= 1 << b
        base.append(f)
    corpus = spark.createDataFrame([(f"{f:032x}",) for f in base], "fingerprint string")
    queries = corpus.limit(40)
    asked = {int(r["fingerprint"], 16) for r in queries.collect()}
    for radius, agree in ((6, 2), (6, None), (3, 1), (0, 1)):
        got = {(r["query"], r["fingerprint"], r["distance"]) for r in fingerprints.search(queries, corpus, radius, agree).collect()}
        assert got == {(f"{q:032x}", f"{f:032x}", (q ^ f).bit_count()) for q in asked for f in base if (q ^ f).bit_count() <= radius}


def test_blocks_grow_with_the_corpus():
    assert [fingerprints.blocks_to_agree(n, 6) for n in (1, 10**5, 10**6, 10**7, 10**9, 10**11)] == [1, 1, 1, 2, 2, 3]


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total >= 3 * sizes[s]}
        for s in above or open_:
            target[s] = 3.0 * sizes[s] if above else left * weight[s] / total
        if not above:
            break
        left -= sum(3 * sizes[s] for s in above)
        open_ -= above
    return target


def test_mixing(odd, documents, none):
    for df in (odd, documents):
        rows = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in df.collect()]
        sizes = defaultdict(int)
        for _, s, n in rows:
            sizes[s] += n
        target = plain_targets(sizes)
        assert sum(target.values()) == pytest.approx(sum(sizes.values()))
        found = mixing.report(df).collect()
        assert sorted((r["doc_id"], r["size"]) for r in found if r["doc_id"] is not None) == sorted((i, n) for i, _, n in rows if i is not None)
        assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in found)
        mixed = mixing.mix(df)
        assert mixed.columns == [*df.columns, "epoch", "position"]
        out = mixed.collect()
        at = [r["position"] for r in out]
        assert at == sorted(at) and all(0 <= x <= 1 for x in at)
        for s, total in sizes.items():
            largest = max(n for _, x, n in rows if x == s)
            taken = sum(len(WORD.findall(r["text"] or "")) for r in out if r["source"] == s)
            assert abs(taken - target[s]) <= largest
            assert any(r["source_size"] == total and r["target"] == pytest.approx(target[s]) for r in found)
        assert [tuple(r) for r in mixing.mix(df.repartition(2)).collect()] == [tuple(r) for r in out]
    assert mixing.report(none).count() == 0 and mixing.mix(none).count() == 0


def test_mixing_clashing_columns(odd):
    names = ["_source", "_none", "_part", "_start", "_before", "_row", "_size", "draw", "offset", "copies", "target", "slope", "text_key", "source_size", "weight"]
    df = odd.select("*", *[F.lit(n).alias(n) for n in names])
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "epoch", "position"]
    rows = out.collect()
    assert {tuple(r[n] for n in names) for r in rows} == {tuple(names)} and {r["size"] for r in rows} <= {r["size"] for r in odd.collect()}
    assert sorted(map(str, out.select(*odd.columns, "epoch", "position").collect())) == sorted(map(str, mixing.mix(odd).collect()))


def test_mixing_groups_grow():
    assert [mixing.group_digits(n) for n in (0, 10**6, 67_108_864, 67_108_865, 10**10, 5 * 10**10)] == [3, 3, 3, 4, 5, 6]


def test_schedule_inverts(spark):
    for slope in (-0.9, -0.5, 0.0, 0.5, 0.9):
        df = spark.range(11).select((F.col("id") / 10).alias("t")).withColumn("slope", F.lit(slope))
        back = df.select("t", mixing.when_due(mixing.demand(F.col("t"), F.col("slope")), F.col("slope")).alias("b"))
        assert all(abs(r["t"] - r["b"]) < 1e-9 for r in back.collect())


def test_pipeline(spark, documents, small):
    """Every stage against the plain version of its operator, on its own input."""
    from tests.llm.test_text_rules import plain_spans, plain_verdicts

    rules, dedup, scan, mix, bpe = [f for _, f in corpus_pipeline.STAGES]
    columns = documents.columns
    kept = rules(spark, documents, small).cache()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    assert kept.columns == columns
    assert {r["doc_id"] for r in kept.collect()} == {v[0] for v in plain_verdicts(rows, 20) if v[-1]}
    one = dedup(spark, kept, small).cache()
    before, stay = kept.collect(), {r["doc_id"] for r in one.collect()}
    sets = {r["doc_id"]: plain_shingles(r["text"]) for r in before}
    assert one.columns == columns and one.count() == len(stay)
    for i in sets:
        twins = [j for j in sets if j != i and jaccard(sets[i], sets[j]) >= 0.8]
        assert i in stay or twins
        assert not (i in stay and any(j in stay for j in twins))
    clean = scan(spark, one, small).cache()
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in one.collect()}
    before = {r["doc_id"]: r["text"] for r in one.collect()}
    for r in clean.collect():
        assert not plain_spans(r["text"])
        if not plain_spans(before[r["doc_id"]]) and "[secret]" not in r["text"]:
            assert r["text"] == before[r["doc_id"]]
    mixed = mix(spark, clean, small).cache()
    taken = {r["doc_id"]: r["taken"] for r in mixing.report(clean).collect()}
    words = defaultdict(int)
    for r in mixed.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert mixed.columns == columns and {k: v for k, v in taken.items() if v} == dict(words)
    ids = bpe(spark, mixed, small)
    assert ids.count() == mixed.count()
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in ids.collect())
    assert corpus_pipeline.run(spark, small).count() == mixed.count()


def test_pipeline_of_odd_tables(spark, odd, none, small):
    """Nulls, empty and long texts, repeated rows, no rows, and columns of the operators' own names."""
    clash = odd.select("*", *[F.lit(n).alias(n) for n in ("_id", "_none", "_text", "_row", "_c", "_lost", "_source", "_part", "_salt", "blob", "node", "label", "text_key", "draw", "position")])
    kept = {}
    for name, df in (("odd", odd), ("none", none), ("clash", clash)):
        docs = df
        for title, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, small), "odd-stage")
            assert docs.columns == df.columns, title
        ids = corpus_pipeline.STAGES[-1][1](spark, docs, small)
        assert ids.count() == docs.count()
        kept[name] = sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in ids.collect())
        if name == "clash":
            assert {tuple(r[c] for c in ("_id", "_row", "_source", "node", "position")) for r in docs.collect()} == {("_id", "_row", "_source", "node", "position")}
    assert kept["none"] == [] and kept["odd"] == kept["clash"] and kept["odd"]
