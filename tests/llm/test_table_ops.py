"""Near-duplicates, URL filter, sharding, top-k and the pipeline, against brute force and odd inputs."""

import random
from collections import Counter
from itertools import combinations
from urllib.parse import quote

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from martwright.llm import queries, secrets, sharding, simhash, topk, urlfilter
from martwright.llm.common import read


def flip(x: int, rng: random.Random, n: int) -> int:
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


def test_golay_words_within_two_bits_share_a_key():
    syndrome, errors, n = simhash.golay()
    assert Counter(n.tolist()) == {6: 1771, 1: 277}
    keys = [set(errors[s, : n[s]].tolist()) for s in range(2048)]
    for weight in (1, 2):
        for bits in combinations(range(23), weight):
            d = sum(1 << b for b in bits)
            sd = int(syndrome[d])
            assert all({e ^ d for e in keys[s]} & keys[s ^ sd] for s in range(2048))


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4])
def test_bucket_keys_meet(bits):
    rng = random.Random(bits)
    a = [rng.getrandbits(64) for _ in range(300)]
    b = [flip(x, rng, bits) for x in a]
    ka, ra = simhash.bucket_keys(np.array(a, np.uint64))
    kb, rb = simhash.bucket_keys(np.array(b, np.uint64))
    left, right = {}, {}
    for k, r in zip(ka.tolist(), ra.tolist(), strict=True):
        left.setdefault(r, set()).add(k)
    for k, r in zip(kb.tolist(), rb.tolist(), strict=True):
        right.setdefault(r, set()).add(k)
    assert all(left[i] & right[i] for i in range(300))


def brute_print(text) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(ids, prints) -> dict:
    root = {i: i for i in range(len(ids))}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 4:
            root[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(top(i), []).append(ids[i])
    return [min((x for x in groups[top(i)] if x is not None), default=None) for i in range(len(ids))]


def test_near_duplicates_against_brute_force(spark, small):
    docs = read(spark, small, "documents")
    rows = docs.collect()
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [brute_print(r.text) for r in rows]
    want = brute_components([r.doc_id for r in rows], prints)
    for r, p, c in zip(rows, prints, want, strict=True):
        assert (got[r.doc_id].fingerprint, got[r.doc_id].component_id) == (f"{p:016x}", c)


def test_chains_and_large_buckets(spark):
    rng = random.Random(9)
    prints = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(40):
            prints.append(x)
            x = flip(x, rng, rng.randint(1, 4))
    prints += [rng.getrandbits(64) for _ in range(200)]
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = brute_components(signed, prints)
    for whole in (simhash.WHOLE_BUCKET, 5):
        root = {r.node: r.root for r in simhash.components(simhash.links(df, whole=whole)).collect()}
        assert [root.get(p, p) for p in signed] == want


def test_near_duplicates_odd(spark):
    long = "w1 w2 w3 w4 w5 " * 40_000
    rows = [(5, None, 1), (2, "", 1), (9, " \t\n", 1), (None, "", 1), (7, "One TWO", 1), (3, "one two", 1), (3, "one two", 1), (None, "lonely words of nobody else here", 1), (8, long, 1), (1, long, 1), (4, "é à", 1)]
    df = spark.createDataFrame(rows, "doc_id int, text string, component_id int")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    zero = "0" * 16
    assert {by[k] for k in by if k[1] == zero} == {2}
    assert {c for (i, _), c in by.items() if i in (7, 3)} == {3} and {c for (i, _), c in by.items() if i in (8, 1)} == {1}
    assert by[(None, f"{brute_print('lonely words of nobody else here'):016x}")] is None
    kept = simhash.keep_first(df).collect()
    assert Counter(r.doc_id for r in kept) == {2: 1, 3: 1, 1: 1, 4: 1, None: 2}
    assert simhash.near_duplicates(df.limit(0)).collect() == [] and simhash.keep_first(df.limit(0)).collect() == []


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    listed = any((host == h or host.endswith("." + h)) and path.startswith(p) for h, p in urlfilter.LISTED)
    rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, "block" if listed else "allow"))
    return host, path, rule, verdict


URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/71?x#y", "https://a.b.example.com/en/8", "x://com/en/", "x://com/en", "x://notcom/en/", "x://Example.NET/de/8/1", "x://net/de/9", "x://é.org/es/?a", "x://org#/es/", "x://a..org/es/", "https://www.spam-farm.example.org/zz", "a://b://com/en/", "x://example.com/en/7\n8", "x://" + "a." * 300 + "com/en/" + "z" * 3_000]


@pytest.mark.parametrize("blocks", [None, 1])
def test_url_filter_against_brute_force(spark, small, blocks):
    urls = URLS + [r.url for r in read(spark, small, "pages").collect()] + ["http://x.org/es/1"] * 20
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, urlfilter.entries(spark), blocks=blocks).collect()}
    for i, u in enumerate(urls):
        assert got[i] == brute_url(u), u


def test_url_filter_empty(spark):
    df = spark.createDataFrame([(1, "x://com/en/")], "page_id int, url string")
    assert urlfilter.judge(df.limit(0), urlfilter.entries(spark)).collect() == []
    (row,) = urlfilter.judge(df, urlfilter.entries(spark, (), ()).limit(0)).collect()
    assert (row.rule, row.verdict) == (None, "allow") and quote(row.path) == "/en/"


def brute_fill(shards, size):
    walks = []
    for s in shards:
        offset, step = sharding.preference(s, size)
        walks.append(iter([(offset + j * step) % size for j in range(size)]))
    table = {}
    while True:
        for k, walk in enumerate(walks):
            table[next(slot for slot in walk if slot not in table)] = k
            if len(table) == size:
                return [table[i] for i in range(size)]


def test_lookup_table():
    names = [f"s{k}" for k in range(7)]
    assert sharding.fill(names, 101).tolist() == brute_fill(names, 101)
    full = sharding.fill([f"s{k}" for k in range(50)])
    sizes = Counter(full.tolist())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    less = sharding.fill([f"s{k}" for k in range(49)])
    assert ((full != less) & (full != 49)).mean() < 0.05
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(bad)
    with pytest.raises(ValueError):
        sharding.fill(["a"], 100)


def test_placement_against_brute_force(spark, small):
    names = [f"shard-{k}" for k in range(9)]
    table = brute_fill(names, 257)
    keys = [r.doc_id for r in read(spark, small, "documents").collect()] + [None]
    df = spark.createDataFrame([(k, "x" * 100_000 if k is None else "t") for k in keys], "doc_id long, number string")
    for r in sharding.place(df, names, size=257).collect():
        h = xxhash.xxh64_intdigest(("" if r.doc_id is None else str(r.doc_id)).encode(), 42)
        slot = (h - (1 << 64) if h >> 63 else h) % 257
        assert (r.slot, r.shard) == (slot, names[table[slot]]) and r.number in ("t", "x" * 100_000)


def test_placement(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (None, "w"), (2, "v")], "doc_id int, slot string")
    rows = sharding.place(df, ["a", "b", "c"]).collect()
    assert len(rows) == 5 and len({r.shard for r in rows if r.doc_id == 1}) == 1 and len({r.slot for r in rows if r.doc_id is None}) == 1
    assert sharding.place(df.limit(0), ["a"]).collect() == []


def brute_top(rows, k, every):
    q = {i: np.floor(64 * np.array(v, np.float64)).astype(np.int64) for i, v in rows}
    out = []
    for i in q:
        if i % every == 0:
            scored = sorted((-int(q[i] @ q[j]), j) for j in q if j != i and len(q[j]) == len(q[i]))[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("components", [topk.COMPONENTS, 320])
def test_top_k_against_brute_force(spark, components):
    rng = np.random.default_rng(components)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(150)] + [(200 + i, [0.5] * 8) for i in range(40)] + [(300 + i, rng.normal(0, 1, 3).tolist()) for i in range(5)] + [(400, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    exact = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, components=components).collect())
    assert got == brute_top(exact, 20, 20)


def test_top_k_of_repeated_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [3.0, 2.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score // 4096) for r in topk.top_k(df).collect())
    assert got == [(0, 1, 2, 6), (0, 2, 1, 3), (0, 3, 1, 3), (0, 4, 20, 1), (20, 1, 0, 3), (20, 2, 2, 2), (20, 3, 0, 1), (20, 4, 1, 1), (20, 5, 1, 1)]


@pytest.mark.parametrize("components", [topk.COMPONENTS, 12])
def test_top_k_of_large_components(spark, components):
    """Scores are exact and ranks go by them, also where no long holds a score, or no double its parts."""
    rng = random.Random(3)
    rows = [(0, [1.0, 2.0]), (20, [1e6, 1.0]), (1, [1e5, 0.5]), (40, [1e30, -1e30]), (60, [1e300, 1.0]), (2, [-1e30, 3.0]), (3, [1e30, 0.015625]), (4, [1e30, 0.03125])]
    rows += [(100 + k, [rng.choice([-1, 1]) * 10.0 ** rng.uniform(0, 40), rng.uniform(-1e9, 1e9)]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    want = []
    for i in q:
        if i % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(q[i], q[j], strict=True)), j) for j in q if j != i)[:20]
            want += [(i, n, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, j) in enumerate(best, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, components=components).collect()) == sorted(want)
    few = {(r.query_id, r.vec_id): r.score for r in topk.top_k(df.where("vec_id in (0, 1, 20)"), components=components).collect()}
    assert few[0, 20] == few[20, 0] == 4_096_008_192 and few[0, 1] == 409_604_096


def test_few_vectors_are_rescored():
    """The index does the work: on unit vectors it stops with a tenth of a block as possible members, by proof."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (4_000, 64))
    q = np.floor(64 * x / np.linalg.norm(x, axis=1, keepdims=True))
    index = topk.opened(topk.build(np.arange(4_000), q))
    found = [topk.search(index, k, q[k], 20) for k in range(20)]
    assert max(f[3] for f in found) <= max(80, topk.FEW * 4_000) and max(f[2] for f in found) < 0.9 * q.size
    for k, f in enumerate(found):
        s = q @ q[k]
        s[k] = -np.inf
        assert sorted(f[1].tolist(), reverse=True) == sorted(s, reverse=True)[:20]


def test_top_k_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [nan, 1.0]), (80, [inf, 1.0]), (None, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [-1.0, 1.0]), (100, []), (120, [1e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(df).collect()}
    assert {k for k in got if k[0] == 0} == {(0, 1), (0, 2), (0, 120)} and got[(0, 1)] == 64 * 64 * 3 and got[(0, 2)] == 64 * 64
    assert {k[0] for k in got} == {0, 120}
    assert topk.top_k(df.limit(0)).collect() == []


def test_pipeline_stages(spark, small):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "secrets", "mixing", "pieces"]
    docs = read(spark, small, "documents")
    clean = corpus_pipeline.drop_toxic(spark, docs, small)
    assert clean.columns == list(corpus_pipeline.COLUMNS)
    unique = simhash.keep_first(docs)
    comps = simhash.near_duplicates(docs).collect()
    assert {r.doc_id for r in unique.collect()} == {r.component_id for r in comps}
    hidden = corpus_pipeline.hide_secrets(spark, docs, small)
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in hidden.collect():
        assert ("[SECRET]" in r.text) == bool(r.text != before[r.doc_id]) and (r.text == before[r.doc_id] or r.n_chars == len(r.text))
    assert not [r for r in secrets.digest(secrets.scan(hidden)).collect() if r.n_access]
    assert corpus_pipeline.mix_sources(spark, docs, small).columns == [*corpus_pipeline.COLUMNS, "copy"]
    out = corpus_pipeline.run(spark, small).collect()
    assert out and all(r.n_tokens == len(r.ids) for r in out)


def test_pipeline_stages_on_an_empty_table(spark, small):
    docs = read(spark, small, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).collect() == []


def test_queries_return_their_contracts(spark, small):
    want = {
        "op1": {"doc_id", "held_out", "lang_pred", "score"}, "op2": {"doc_id", "held_out", "score", "predicted"}, "op3": {"doc_id", "fingerprint", "component_id"},
        "op4": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"}, "op5": {"page_id", "host", "path", "rule", "verdict"},
        "op7": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}, "op10": {"query_id", "rank", "vec_id", "score"},
    }
    want |= {"op6": {"doc_id", "text", "slot", "shard"}, "op8": {"doc_id", "ids", "n_tokens", "lossless"}, "op9": {"doc_id", "text", "copy", "mix_key"}}
    want |= {"op11": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"}, "op12": {"sale_id", "batch", "late", "click_id", "n_clicks"}}
    want |= {"op13": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}}
    for name, f in queries.QUERIES.items():
        assert want[name.split("_")[0]] <= set(f(spark, small).columns)
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
