"""The pipeline's near-duplicates stage against brute-force Jaccard similarity of five-word shingles."""

import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from martwright.llm import shingles


def words_of(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def likeness(a: str, b: str) -> float:
    x, y = words_of(a), words_of(b)
    return len(x & y) / len(x | y)


def planted(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    texts = []
    for n, replaced in [(1000, 10), (1000, 16), (1000, 20), (200, 2), (200, 3), (200, 12), (60, 0)] * 6:
        words = [f"w{rng.randrange(50_000)}" for _ in range(n)]
        texts.append(" ".join(words))
        for _ in range(2):
            other = list(words)
            for k in rng.sample(range(n), replaced):
                other[k] = f"v{rng.randrange(10**9)}"
            texts.append(" ".join(other))
    return [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]


def test_stage_keeps_no_pair_at_similarity_08(spark, small):
    rows = planted(1)
    df = spark.createDataFrame([*rows, (None, rows[0][1], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, small).collect()
    assert sum(r.doc_id is None for r in out) == 1
    kept = {r.doc_id: r.text for r in out if r.doc_id is not None}
    assert not [p for p in combinations(kept, 2) if likeness(kept[p[0]], kept[p[1]]) >= 0.8]
    gone = {k for k, *_ in rows} - set(kept)
    text = {k: t for k, t, *_ in rows}
    assert all(any(likeness(text[g], text[k]) >= 0.8 for k in text if k // 3 == g // 3 and k != g) for g in gone)
    assert len(gone) > 50


def test_large_buckets_link_their_texts(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(60):
        other = list(words)
        other[rng.randrange(300)] = f"v{rng.randrange(10**9)}"
        texts.append(" ".join(other))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(shingles, "FEW", 4)
    assert [r.doc_id for r in shingles.keep_first(df).collect()] == [0]
    assert shingles.keep_first(df.limit(0)).collect() == []


def test_templates_lose_no_links(spark):
    """40 pairs at 0.84 that share a template with 3,000 other texts at 0.78: all are found, and nothing else is linked."""
    rng = random.Random(4)
    word = iter(range(10**9))
    template = [f"t{next(word)}" for _ in range(400)]
    own = lambda n: [f"w{next(word)}" for _ in range(n)]
    texts = [" ".join(template + own(56)) for _ in range(3000)]
    for _ in range(40):
        both = own(20)
        texts += [" ".join(template + both + own(36)) for _ in range(2)]
    assert 0.82 < likeness(texts[-1], texts[-2]) < 0.86 and 0.76 < likeness(texts[0], texts[1]) < 0.8
    order = list(range(len(texts)))
    rng.shuffle(order)
    df = spark.createDataFrame([(k, texts[k]) for k in order], "doc_id long, text string").repartition(8)
    assert {r.id for r in shingles.copies(df).collect()} == {3001 + 2 * k for k in range(40)}


def test_shared_counts_by_definition(monkeypatch):
    rng = np.random.default_rng(3)
    common = rng.choice(10**6, 40, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(common, 25, replace=False), rng.choice(300, rng.integers(0, 60), replace=False).astype(np.uint64)])) for _ in range(90)]
    want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    for dense in (1, 4, 64):
        monkeypatch.setattr(shingles, "DENSE", dense)
        monkeypatch.setattr(shingles, "COLUMNS", 7)
        assert shingles.shared(sets).tolist() == want


def test_blocks_of_large_buckets(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(120)]
    texts = [" ".join(words[: rng.randrange(60, 120)]) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(shingles, "FEW", 4)
    monkeypatch.setattr(shingles, "BLOCK", 7)
    group = list(range(80))
    for a, b in combinations(range(80), 2):
        if likeness(texts[a], texts[b]) >= 0.8 and group[a] != group[b]:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
    assert {r.id for r in shingles.copies(df).collect()} == {k for k in range(80) if group[k] != k}
