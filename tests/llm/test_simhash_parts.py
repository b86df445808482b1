"""The pipeline's near-dedup stage against brute force over five-word shingles."""

import random

import brute
import corpus_pipeline
import numpy as np
import pytest

from kinetra.llm import simhash_parts


def shingles(text):
    w = (text or "").lower().encode().split()
    return frozenset([b" ".join(w)] if 0 < len(w) < 5 else (b" ".join(w[i : i + 5]) for i in range(len(w) - 4)))


def groups(docs):
    """The smallest id of each id's component over pairs at a Jaccard similarity of 0.8 or more."""
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(d), find(e)))
                root[y] = x
    return {d: find(d) for d, _ in sets}


@pytest.fixture(scope="module")
def made():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(3_000)]
    texts = [None, "", "one", "one two", "A b c d e", "a B c d e"]
    for n in (5, 8, 9, 12, 20, 60, 150, 400, 900):
        for _ in range(4):
            t = [rng.choice(words) for _ in range(n)]
            texts.append(" ".join(t))
            for _ in range(5):
                t = list(t)
                for _ in range(rng.randrange(0, max(2, n // 30))):  # chains of edits, on both sides of 0.8
                    t[rng.randrange(len(t))] = rng.choice(words)
                if rng.random() < 0.4:
                    t = t[: max(1, round(n * rng.uniform(0.8, 1)))]
                texts.append(" ".join(t))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_pairs_at_the_threshold_share_a_key():
    rng = np.random.default_rng(3)
    for n in (*range(1, 60), 100, 333, 1_000):
        for _ in range(20):
            pool = rng.integers(0, 1 << 63, 2 * n + 10, dtype=np.uint64) * np.uint64(2)
            lost, grown = rng.integers(0, n // 5 + 1), rng.integers(0, n // 4 + 1)
            a, b = np.unique(pool[:n]), np.unique(pool[lost : n + grown])
            same = len(np.intersect1d(a, b))
            if 5 * same >= 4 * (len(a) + len(b) - same) and len(a) + len(b) > 2 * same:
                assert set(simhash_parts.part_keys(a)) & set(simhash_parts.part_keys(b))


def test_pairs_at_the_threshold_share_two_keys():
    rng = np.random.default_rng(4)
    for n in (*range(1, 60), 100, 333, 1_000):
        for _ in range(20):
            pool = rng.integers(0, 1 << 63, 2 * n + 10, dtype=np.uint64) * np.uint64(2)
            lost, grown = rng.integers(0, n // 5 + 1), rng.integers(0, n // 4 + 1)
            a, b = np.unique(pool[:n]), np.unique(pool[lost : n + grown])
            same = len(np.intersect1d(a, b))
            if 5 * same >= 4 * (len(a) + len(b) - same) and len(a) + len(b) > 2 * same:
                assert len(set(simhash_parts.part_keys(a)) & set(simhash_parts.part_keys(b))) > 1


def sets_of(spark, sets):
    return spark.createDataFrame([(c, list(v)) for c, v in enumerate(sets)], "c long, v array<long>")


def test_shingles_are_counted_in_packed_rows(spark, monkeypatch):
    rng = random.Random(4)
    values = [rng.getrandbits(63) for _ in range(4_000)]
    sets = [set(rng.choices(values, k=rng.randrange(200))) | {values[0]} for _ in range(300)] + [set()]
    count = {}
    for x in (x >> simhash_parts.FREQUENCY_SHIFT for v in sets for x in v):
        count[x] = count.get(x, 0) + 1
    df = sets_of(spark, sets)
    assert simhash_parts._counted(df, 64).count() <= 64
    scratch = simhash_parts._Scratch()
    for most in (1_000_000, 100, 0):
        monkeypatch.setattr(simhash_parts, "MAX_FREQUENT", most)
        keys, counts, every = simhash_parts._frequent(df, sum(map(len, sets)), scratch)
        got = dict(zip(keys.tolist(), counts.tolist(), strict=True))
        assert every == (most == 1_000_000) and (keys[1:] > keys[:-1]).all()
        if every:
            assert got == {x: k for x, k in count.items() if k > 1}
        else:
            assert len(got) <= most and all(count[x] == k for x, k in got.items())
            assert got == {x: k for x, k in count.items() if got and k >= min(got.values())}
    scratch.drop()


def test_classes_of_one_crowded_key_are_done(spark):
    rows = [(1, c, 10, c) for c in range(6)] + [(2, c, 10, c) for c in range(3)]
    wanted = []

    def sets(chosen):
        wanted.extend(sorted(r.c for r in chosen.collect()))
        return sets_of(spark, [range(100 * c, 100 * c + 10) for c in range(6)])

    scratch = simhash_parts._Scratch()
    df = spark.createDataFrame(rows, "key long, c long, n long, root long")
    assert simhash_parts.unconnected_pairs(df, 2, sets, scratch).count() == 0
    assert wanted == [0, 1, 2]
    scratch.drop()


def test_stage_keeps_one_of_each_group(spark, sf_dir, made):
    want = groups(made)
    by_bits = brute.components({d: brute.fingerprint(t) for d, t in made})
    assert want != by_bits
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.d: r.component for r in simhash_parts.near_duplicates(df, crowd=1).collect()} == want  # every key is a crowded one
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, df, sf_dir).collect()} == set(want.values())


def test_local_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = groups([(r.doc_id, r.text) for r in df.collect()])
    assert {r.d: r.component for r in simhash_parts.near_duplicates(df).collect()} == want


def test_large_group_of_edited_copies(spark):
    """Copies of one text with their own edits, on both sides of the threshold to it and to each other; some share edits that the text lacks."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(5_000)]
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for k in range(90):
        t = list(base)
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(words)
        if k % 5 == 0:
            t[:14] = words[100 : 114]  # a block that several copies share
        if k % 7 == 0:
            t = t[: rng.randrange(85, 110)]
        texts.append((k, " ".join(t)))
    want = groups(texts)
    assert len(set(want.values())) > 3
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.d: r.component for r in simhash_parts.near_duplicates(df).collect()} == want


def test_passages_in_unlike_texts(spark):
    """Texts around one long passage, near each other in small groups that the passage alone does not make near."""
    rng = random.Random(13)
    words = [f"w{k}" for k in range(9_000)]
    passage = [rng.choice(words) for _ in range(90)]
    texts = []
    for _ in range(25):
        own = [rng.choice(words) for _ in range(rng.choice((20, 60, 150)))]
        for _ in range(rng.randrange(1, 5)):
            t = list(own)
            for _ in range(rng.randrange(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append((len(texts), " ".join(t + passage)))
    want = groups(texts)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.d: r.component for r in simhash_parts.near_duplicates(df, crowd=1).collect()} == want


def unlike_round_passages(n):
    """Sets that share a passage with all others, half of them a second one, and are unlike besides."""
    rng = np.random.default_rng(n)
    one, two = rng.integers(1, 1 << 62, 200), rng.integers(1, 1 << 62, 150)
    sets = [np.unique(np.concatenate([one, two if k % 2 else one[:0], rng.integers(1, 1 << 62, 150)])) for k in range(n)]
    return [(k, len(v), k, v.tolist()) for k, v in enumerate(sets)]


@pytest.mark.parametrize("known", [0, 1_000_000])
def test_candidates_grow_with_the_texts(spark, monkeypatch, known):
    """No pair of unlike texts round two passages is a candidate; without frequencies the pairs that are near are found all the same."""
    monkeypatch.setattr(simhash_parts, "MAX_FREQUENT", known)
    counts = {}
    for n in (200, 400):
        rows = unlike_round_passages(n)
        near = [(n + k, len(r[3]), n + k, r[3][:-2]) for k, r in enumerate(rows[:5])]
        df = spark.createDataFrame(rows + near, "c long, n long, root long, v array<long>").selectExpr("c", "size(v) AS n", "root", "v").selectExpr("c", "CAST(n AS bigint) AS n", "root", "v")
        scratch = simhash_parts._Scratch()
        found = {(r.a, r.b) for r in simhash_parts.crowded_pairs(df.drop("v"), df.select("c", "v"), scratch).collect()}
        scratch.drop()
        assert {(k, n + k) for k in range(5)} <= found
        counts[n] = len(found)
    if known:
        assert counts[400] <= 2 * counts[200] + 5 and counts[400] < 40


def test_recall_on_long_texts(spark):
    """Pairs on both sides of the threshold among texts of over 335 shingles, most of them beyond MOST_PARTS parts."""
    rng = random.Random(17)
    words = [f"w{k}" for k in range(20_000)]
    texts = []
    for n in (400, 700, 1_500, 4_000):
        for _ in range(4):
            t = [rng.choice(words) for _ in range(n)]
            texts.append(" ".join(t))
            for share in (0.01, 0.02, 0.03, 0.04, 0.05):
                u = list(t)
                for k in rng.sample(range(n), int(share * n * rng.uniform(0.5, 1))):
                    u[k] = rng.choice(words)
                texts.append(" ".join(u))
    rows = list(enumerate(texts))
    want = groups(rows)
    assert 16 < len(set(want.values())) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd in (1, 16):
        assert {r.d: r.component for r in simhash_parts.near_duplicates(df, crowd=crowd).collect()} == want
