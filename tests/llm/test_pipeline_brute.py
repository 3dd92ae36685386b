"""The pipeline's rows against plain Python: every stage by its definition, on all that the one before it kept."""

import math
import random
import re
from collections import Counter, defaultdict
from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash

import corpus_pipeline
from martwright.llm import pieces, secrets, toxicity
from martwright.llm.common import text_bytes


def some_documents() -> list[tuple]:
    rng = random.Random(8)
    texts = []
    for k in range(24):
        words = [f"w{rng.randrange(3_000)}" for _ in range(rng.choice([3, 40, 200]))]
        texts.append(" ".join(words))
        if k % 4 == 0 and len(words) > 30:  # near copies, by more bits than a fingerprint's links allow, or by fewer
            for n in (1, len(words) // 40 + 1):
                other = list(words)
                for i in rng.sample(range(len(words)), n):
                    other[i] = f"v{rng.randrange(10**6)}"
                texts.append(" ".join(other))
    texts += ["you grumzen fool " + " ".join(f"w{rng.randrange(3_000)}" for _ in range(30)) for _ in range(5)]
    texts += ["key: token='abcdef123456' and AKIA" + "Q9" * 10 + " more", "x " + "0f" * 16 + " y", "ghp_" + "a1" * 20 + " end", "", None, texts[0], texts[0].upper()]
    return [(k, t, "en", f"s{k % 3}" if k % 7 else None, len(t or "")) for k, t in enumerate(texts)]


def least_of_groups(ids: list, linked) -> set:
    root = {i: i for i in ids}

    def top(i):
        return i if root[i] == i else top(root[i])

    for a, b in combinations(ids, 2):
        if linked(a, b):
            root[max(top(a), top(b))] = min(top(a), top(b))
    return {i for i in ids if root[i] == i}


def bits(text) -> int:
    words = (text or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def shingles(text) -> set:
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def hidden(text):
    spans = []
    for rule in secrets.RULES:
        spans += [m.span() for m in re.finditer(rule.pattern, text or "", re.A) if len(m[rule.group]) >= rule.least]
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:] if spans else text


def unit(*parts) -> float:
    return int(md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def test_pipeline_by_definition(spark, tmp_path, monkeypatch):
    rows = some_documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    bad = [k for k, t, *_ in rows if t and "grumz" in t]
    model = toxicity.train([t or "" for _, t, *_ in rows] * 6, [k in bad for k, *_ in rows] * 6, steps=60)
    monkeypatch.setattr(toxicity, "fit", lambda *a, **b: model)
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    raw, at = text_bytes(pa.array([t for _, t, *_ in rows], pa.large_string()))
    score = dict(zip((r[0] for r in rows), toxicity.score_rows(model, raw, at), strict=True))
    text, source = {k: t for k, t, *_ in rows}, {r[0]: r[3] or "" for r in rows}
    clean = [k for k in text if score[k] < 0.5]
    assert set(text) - set(clean) == set(bad)
    prints = {k: bits(text[k]) for k in clean}
    apart = sorted(least_of_groups(clean, lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 4))
    sets = {k: shingles(text[k]) for k in apart}
    kept = least_of_groups(apart, lambda a, b: bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)
    assert len(clean) - len(apart) >= 3 and len(apart) - len(kept) >= 1
    shown = {k: hidden(text[k]) for k in kept}
    size = defaultdict(int)
    for k in kept:
        size[source[k]] += len(shown[k] or "")
    live = {s for s, n in size.items() if n}
    want: Counter = Counter()
    for k in kept:
        if source[k] in live:
            rate = sum(size.values()) / len(live) / size[source[k]]
            u, n, p, below = unit("mix-1", source[k], k, 0), 0, math.exp(-rate), 0.0
            while (below := below + p) <= u:
                n, p = n + 1, p * rate / (n + 1)
            want[k] += n
    assert Counter(r.doc_id for r in got) == +want
    names = [p.replace(pieces.SPACE, " ").encode() for p in pieces.load().pieces]
    for b, k in enumerate(pieces.load().byte_id.tolist()):
        names[k] = bytes([b])
    made = pieces.Segmenter(pieces.load(), 0.1, 11)
    for doc, n in want.items():
        own = [r for r in got if r.doc_id == doc]
        assert all((r.ids is None) == (shown[doc] is None) and r.n_tokens == len(r.ids or []) for r in own)
        if shown[doc] is not None:
            assert all(b"".join(names[i] for i in r.ids)[1:].decode() == shown[doc] for r in own)
            cut = [made.encode([shown[doc]], [pieces.variant_of(str(doc), 11, c)])[0].tolist() for c in range(n)]
            assert sorted(map(list, (r.ids for r in own))) == sorted(cut)
    assert sum(want.values()) == len(got) and np.mean([c > 0 for c in want.values()]) > 0.3
