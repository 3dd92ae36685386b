"""Language ID, toxicity, pieces, TIFF and secrets: against brute force, round trips, held-out accuracy, and odd inputs."""

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from martwright.llm import langid, mixing, pieces, secrets, tiff, toxicity
from martwright.llm.common import read, text_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, media string, ids string"
LONG = "the quick brown fox. " * 60_000
ODD = [
    (1, None, "en", "a", 0, None, None, None, None),
    (2, "", None, None, 0, None, None, None, None),
    (3, "   \n\t ", "en", "a", 0, 1.0, "x", "y", "z"),
    (None, "no id here", "en", "a", 0, None, None, None, None),
    (4, LONG, "en", "a", 0, None, None, None, None),
    (5, "the same words again and again", "en", "a", 0, None, None, None, None),
    (5, "the same words again and again", "en", "a", 0, None, None, None, None),
    (6, "12345 67890 !!!", "fr", "b", 0, None, None, None, None),
    (7, "日本語 ﬁ ▁ \x00 \U0001f600", "fr", "b", 0, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language_windows_hold_every_byte_and_ngram():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 5, 255, 256, 257, 510, 5_000]
    texts = [bytes(rng.integers(1, 255, n).astype(np.uint8)) for n in sizes]
    raw, at = text_bytes(pa.array(texts, pa.large_binary()))
    begin, row, held = langid.window_starts(at)
    windows = langid.cut(raw, begin, held)
    for k, text in enumerate(texts):
        mine = [windows[i][: held[i]].tobytes() for i in np.flatnonzero(row == k)]
        hop = langid.WINDOW - max(langid.WIDTHS) + 1
        assert b"".join([m[:hop] for m in mine[:-1]] + mine[-1:]) == text
        grams = {text[i : i + 4] for i in range(len(text) - 3)}
        assert grams <= {m[i : i + 4] for m in mine for i in range(len(m) - 3)}


def test_language_held_out(spark, small):
    docs = read(spark, small, "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.9


def test_language_odd(odd, empty):
    rows = {(r.doc_id, r.lang_pred) for r in langid.identify(odd).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (6, "und")} <= rows and len(langid.identify(odd).collect()) == len(ODD)
    assert langid.identify(empty).collect() == []
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}


def test_recurrent_gradients():
    """backward() against differences of logits()."""
    texts = ["one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen", "you idiot", "a b"]
    model = toxicity.train(texts * 4, [0, 1, 0] * 4, steps=2)
    word, grams, n_grams, first = toxicity.words_of(texts)
    x = model.inputs(word, grams, np.concatenate([[0], np.cumsum(n_grams)])[:-1]).astype(np.float64)
    begin, size, _ = toxicity.windows_of(first)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    keep: dict = {}
    z = model.logits(x, begin, size, keep)
    weights = np.arange(1.0, len(z) + 1)
    grads, dx = model.backward(x, weights, keep)
    rng = np.random.default_rng(1)
    for name, grad in [*grads.items(), ("x", dx)]:
        value = x if name == "x" else model.p[name]
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in value.shape)
            old = value[at]
            value[at] = old + 1e-3
            up = model.logits(x, begin, size) @ weights
            value[at] = old - 1e-3
            down = model.logits(x, begin, size) @ weights
            value[at] = old
            assert grad[at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-4), name


def test_toxicity_finds_planted_words_and_their_forms():
    rng = random.Random(5)
    plain = ["".join(rng.choice(["ta", "ro", "mi", "el", "so", "na"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]

    def text(bad: bool) -> str:
        w = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        if bad:
            w[rng.randrange(len(w))] = "grumz" + rng.choice(["", "en", "ta", "os"])
        return " ".join(w)

    data = [(text(k % 4 == 0), int(k % 4 == 0)) for k in range(700)]
    model = toxicity.train([t for t, _ in data[:500]], [y for _, y in data[:500]], steps=120)
    raw, at = text_bytes(pa.array([t for t, _ in data[500:]], pa.large_string()))
    said = toxicity.score_rows(model, raw, at) >= 0.5
    assert (said == np.array([y == 1 for _, y in data[500:]])).mean() > 0.97


TOXIC_TEXTS = ["you idiot", "a b c", "x" * 500 + " tail words here", "", " ", "日本語" * 90, "one two three four five six seven eight"] + [
    " ".join(random.Random(k).choice(["a", "bb", "idiot", "word", "é中文", "z" * 200, "  \n"]) for _ in range(40 * k)) for k in range(12)
]


@pytest.fixture(scope="module")
def small_model():
    return toxicity.train(TOXIC_TEXTS, [k % 3 == 0 for k in range(len(TOXIC_TEXTS))], steps=15)


def slow_score(p: dict, text: str) -> float:
    """The network's score of a text, a word, window and step at a time."""
    inside = lambda b: 48 <= b < 58 or 97 <= b < 123 or b >= 128
    low = bytes(b + 32 if 65 <= b < 91 else b for b in text.encode())
    runs = [(m.start(), m.end()) for m in re.finditer(rb"[0-9a-z\x80-\xff]+", low)]
    spans = [(k, min(k + 64, b)) for a, b in runs for k in range(a, b, 64)]
    flat = bytes(b if inside(b) else 32 for b in low)
    flat = b" " + flat + b"   "
    xs, mask = [], (1 << 64) - 1
    for a, b in spans:
        h = sum((low[i] + 1) * pow(int(toxicity._P), i - a, 1 << 64) for i in range(a, b)) & mask
        x = list(p["word"][(h * 0xD6E8FEB86659FD93 & mask) >> 64 - toxicity.WORD_BITS])
        gram = np.zeros(toxicity.EMBED)
        for i in range(a, a + max(b - a - 1, 1)):
            gram = gram + p["gram"][(int.from_bytes(flat[i : i + 4], "little") * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - toxicity.GRAM_BITS]
        xs.append(np.concatenate([x, gram]))
    if not xs:
        return 0.0
    H, best, sig = toxicity.HIDDEN, -np.inf, lambda v: 1 / (1 + np.exp(-v))
    starts = [0, *(k for k in range(8, len(xs), 8) if k + 8 < len(xs))]
    for k in starts:
        own, states = xs[k : k + 16], {}
        for d, order in (("f", own), ("b", own[::-1])):
            h, states[d] = np.zeros(H), []
            for x in order:
                g = x @ p[f"{d}_in"] + p[f"{d}_bias"]
                rz = sig(g[: 2 * H] + h @ p[f"{d}_rz"])
                c = np.tanh(g[2 * H :] + (rz[:H] * h) @ p[f"{d}_c"])
                h = h + rz[H:] * (c - h)
                states[d].append(h)
        both = [np.concatenate(pair) for pair in zip(states["f"], states["b"], strict=True)]
        a = np.exp([v @ p["attend"] for v in both])
        best = max(best, sum(w * v for w, v in zip(a / a.sum(), both, strict=True)) @ p["out"] + p["out_bias"][0])
    return sig(best)


def test_toxicity_against_a_slow_forward_pass(small_model):
    raw, at = text_bytes(pa.array(TOXIC_TEXTS, pa.large_string()))
    for text, got in zip(TOXIC_TEXTS, toxicity.score_rows(small_model, raw, at), strict=True):
        assert got == pytest.approx(slow_score(small_model.p, text), abs=1e-5), text[:40]


@pytest.mark.parametrize("chunk", [50, 120, 700, 1_500])
def test_long_texts_score_as_if_whole(small_model, chunk):
    for text in TOXIC_TEXTS:
        raw = np.frombuffer(text.encode(), np.uint8)
        assert toxicity.score_long(small_model, raw, chunk) == pytest.approx(toxicity.score_rows(small_model, raw, np.array([0, len(raw)]))[0], abs=1e-6)


def test_toxicity_held_out(spark):
    """On the documents: what the labels of the held-out fifth say is found, by ranking and by the threshold."""
    docs, labels = (read(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    rows = [r for r in toxicity.judge(docs, labels).join(labels, "doc_id").select("held_out", "score", "predicted", "toxic").collect() if r.held_out and r.toxic is not None]
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert len(bad) >= 10 and np.mean([b > g for b in bad for g in good]) > 0.95
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95


def test_only_long_texts_are_labelled(spark):
    """Labels of texts of any length are learnt from."""
    rows = [(k, ("le chat est sur la table et le chien dort " if k % 2 else "the cat sits on the table and the dog sleeps ") * 2_600, "fr" if k % 2 else "en") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r.lang_pred == ("fr" if r.doc_id % 2 else "en") for r in langid.predict(docs, langid.fit(docs, steps=60)).collect())
    marks = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, steps=40)
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in toxicity.score(docs, model).collect())


def slow_language(model: langid.Model, text: str) -> np.ndarray:
    """The network's probabilities, a window, filter and place at a time."""
    raw, hop = text.encode(), langid.WINDOW - 3
    starts = [0, *(k for k in range(hop, len(raw), hop) if k + 3 < len(raw))]
    total, weight = np.zeros(len(model.langs)), 0
    for k in starts:
        own = raw[k : k + langid.WINDOW]
        x = [model.embed[b] for b in own.ljust(langid.WINDOW, b"\0")]
        top = np.array([max(sum(x[i + j] @ model.conv[j * langid.EMBED : (j + 1) * langid.EMBED, f] for j in range(4)) for i in range(langid.WINDOW - 3)) for f in range(model.conv.shape[1])])
        z = np.exp(np.maximum(top + model.bias, 0) @ model.out + model.out_bias)
        total, weight = total + z / z.sum() * len(own), weight + len(own)
    return total / weight


def test_language_against_a_slow_forward_pass(spark):
    texts = ["the cat sits on the table", "le chien dort", "é" * 200, "der Hund " * 40]
    model = langid.train(texts * 2, ["en", "fr", "fr", "de"] * 2, steps=10)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.predict(docs, model).collect():
        p = slow_language(model, texts[r.doc_id])
        assert r.lang_pred == model.langs[p.argmax()] and r.score == pytest.approx(p.max(), abs=1e-4)


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1, 1), (6, 1, 0), (4, 1, 0), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.judge(odd, labels, steps=3).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert {r.score for r in rows if r.doc_id in (1, 2, 3)} == {0.0}
    assert toxicity.judge(empty, labels).collect() == [] and {r.score for r in toxicity.judge(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.keep_clean(odd, None).columns == odd.columns and toxicity.keep_clean(odd, None).count() == len(ODD)


VOCABULARY = pieces.load()


def test_pieces_without_dropout_are_the_librarys(spark, small):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [r.text for r in read(spark, small, "documents").collect()] + [t for _, t, *_ in ODD if t and pieces.SPACE not in t and len(t) < 1_000] + ["x" * 300, "    a  b\n\n c"]
    for text, ids in zip(texts, pieces.Segmenter(VOCABULARY, 0.0, 1).encode(texts, [0] * len(texts)), strict=True):
        assert ids.tolist() == sp.encode(text)


def slow_dropout(unit: str, key: int, rate: float) -> list[str]:
    """Merge-dropout by its definition: the best of all neighbours that make a piece and aren't skipped, again and again."""
    import sentencepiece

    sp, mask = slow_dropout.__dict__.setdefault("sp", sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)), (1 << 64) - 1
    own, start = [c.replace(" ", pieces.SPACE) if c != pieces.SPACE else "\ue000" for c in unit], list(range(len(unit)))
    while True:
        best = None
        for k in range(len(own) - 1):
            piece = sp.piece_to_id(own[k] + own[k + 1])
            if piece == sp.unk_id() or sp.is_control(piece) or sp.is_byte(piece):
                continue
            x = key + (start[k] << 32 | piece) * 0x9E3779B97F4A7C15 & mask
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
            if (x ^ x >> 31) >> 11 < rate * 2.0**53:
                continue
            if best is None or sp.get_score(piece) > sp.get_score(best[1]):
                best = (k, piece)
        if best is None:
            return own
        k = best[0]
        own[k : k + 2], start[k : k + 2] = [own[k] + own[k + 1]], [start[k]]


@pytest.mark.parametrize("rate", [0.1, 0.4])
def test_dropout_against_its_definition(spark, small, rate):
    texts = [r.text for r in read(spark, small, "documents").collect() if len(r.text) < 300][:4] + ["x" * 40 + " " + "considerable" * 3, "    a  b\n\n c", "日本語 ▁ \x00"]
    variants = [pieces.variant_of(str(k), 11) for k in range(len(texts))]
    made = pieces.Segmenter(VOCABULARY, rate, 11)
    made.encode(texts, [v ^ 5 for v in variants])  # what is kept from other documents changes nothing
    for text, variant, ids in zip(texts, variants, made.encode(texts, variants), strict=True):
        units = pieces.units_of(VOCABULARY, text)
        keys = pieces._mix(np.array([xxhash.xxh64_intdigest(u.encode(), 11) for u in units], np.uint64) ^ np.uint64(variant))
        want = [p for u, k in zip(units, keys.tolist(), strict=True) for p in slow_dropout(u, k, rate)]
        want = [q for p in want for q in ([p] if p in KNOWN else [f"<0x{b:02X}>" for b in ("▁" if p == "\ue000" else p).encode()])]
        assert [VOCABULARY.pieces[i] for i in ids] == want, text[:50]


KNOWN = {p for k, p in enumerate(VOCABULARY.pieces) if VOCABULARY.rank[k] < pieces.NONE}


def test_segmentations_are_kept_and_forgotten(monkeypatch):
    texts = [f"{w} again and again the same words" for w in ("one", "two", "three", "four", "five", "six")] * 3
    variants = [pieces.variant_of(str(k), 1) for k in range(len(texts))]
    once = [x.tolist() for x in pieces.Segmenter(VOCABULARY, 0.3, 1).encode(texts, variants)]
    monkeypatch.setattr(pieces, "KEPT_UNITS", 3)
    few = pieces.Segmenter(VOCABULARY, 0.3, 1)
    assert once == [few.encode([t], [v])[0].tolist() for t, v in zip(texts, variants, strict=True)]


@pytest.mark.parametrize("rate", [0.1, 0.5, 1.0])
def test_rows_and_heap_drop_the_same_merges(rate):
    rng = random.Random(2)
    units = list({"".join(rng.choice(" theranoiéß9") for _ in range(rng.randint(1, 30))).replace(" ", "", 3) or "a" for _ in range(300)})
    keys = np.arange(len(units), dtype=np.uint64) * np.uint64(1_000_003)
    flat, n = pieces.segment(VOCABULARY, units, keys, rate)
    ends = np.cumsum(n)
    for u, k, a, b in zip(units, keys, ends - n, ends, strict=True):
        symbols = [int(VOCABULARY.table[ord(c)]) if VOCABULARY.table[ord(c)] >= 0 else (1 << 30) + ord(c) for c in u]
        one = np.array(pieces.by_heap(VOCABULARY, symbols, int(k), rate), np.int32)
        assert pieces.fall_back(VOCABULARY, one, np.array([len(one)]))[0].tolist() == flat[a:b].tolist()


def test_pieces_round_trip_and_vary(odd, empty):
    rows = pieces.round_trip(odd.select("doc_id", "text"), rate=0.3).collect()
    assert len(rows) == len(ODD) and all(r.lossless for r in rows)
    assert [r.ids for r in rows if r.doc_id == 1] == [None] and [r.ids for r in rows if r.doc_id == 2] == [[]]
    again, other = pieces.encode(odd, rate=0.3).collect(), pieces.encode(odd, rate=0.3, seed=12).collect()
    assert [r.ids for r in rows] == [r.ids for r in again] != [r.ids for r in other]
    assert pieces.encode(odd).columns[-1] == "ids" and pieces.round_trip(empty.select("doc_id", "text")).collect() == []


def test_tiff_codecs():
    rng = random.Random(3)
    for n in [0, 1, 2, 3, 127, 128, 129, 500, 4_000, 30_000]:
        for letters in (b"a", b"ab", bytes(range(256))):
            data = bytes(rng.choice(letters) for _ in range(n))
            assert tiff.unpack(tiff.pack(data), n) == data and tiff.lzw_unpack(tiff.lzw_pack(data), n) == data


def test_tiff_predictors_planes_and_tiles():
    import struct

    rows = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    coded = np.concatenate([rows[:, :1], rows[:, 1:] - rows[:, :-1]], axis=1).tobytes()

    def file(order, fields, data):
        head = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8 + len(data) + len(data) % 2)
        body = b"".join(struct.pack(order + "HHI", t, 4, 1) + struct.pack(order + "I", v) for t, v in sorted(fields.items()))
        return head + data + b"\0" * (len(data) % 2) + struct.pack(order + "H", len(fields)) + body + b"\0" * 4

    for order in "<>":
        fields = {256: 7, 257: 5, 258: 8, 259: 8, 262: 2, 273: 8, 277: 3, 278: 5, 279: len(zlib.compress(coded)), 317: 2}
        (page,) = tiff.read_pages(file(order, fields, zlib.compress(coded)))
        assert page["pixels"] == rows.tobytes() and page["samples"] == 3
    wide = np.array([[1, 500, 70, 65_000]], ">u2")
    diff = np.concatenate([wide[:, :1], wide[:, 1:] - wide[:, :-1]], axis=1).astype(">u2").tobytes()
    (page,) = tiff.read_pages(file(">", {256: 4, 257: 1, 258: 16, 259: 1, 273: 8, 277: 1, 278: 1, 279: 8, 317: 2}, diff))
    assert page["pixels"] == wide.tobytes()


def test_tiff_broken_files(spark):
    good = tiff.store(b"x" * 6_400)
    loop = bytearray(good)
    files = [b"", b"II*", b"GIF89a", good[:-20], good[:50], bytes(loop[:4]) + b"\xff\xff\xff\x7f" + bytes(loop[8:]), None, good]
    df = spark.createDataFrame([(i, f, "keep", "clash") for i, f in enumerate(files)], "doc_id int, media binary, other string, page string")
    rows = tiff.pages(df).collect()
    assert {r.doc_id for r in rows if r.error} == {0, 1, 2, 3, 4, 5} and not [r for r in rows if r.doc_id == 6]
    assert [r.pixels for r in rows if r.doc_id == 7] == [bytearray(b"x" * 6_400)] and {r.other for r in rows} == {"keep"}
    assert tiff.pages(df.limit(0)).collect() == []


def test_tiff_text_media(odd, empty):
    rows = tiff.text_media(odd).collect()
    assert len(rows) == len(ODD)
    by_text = {}
    for r, (i, text, *_) in zip(rows, ODD, strict=True):
        raw = (text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        media = tiff.store(payload)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256) == (i, len(raw), len(payload), sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(media), sha256(media).hexdigest())
        assert by_text.setdefault(text or "", r.feature) == r.feature
    assert tiff.text_media(empty).collect() == []


def brute_spans(text: str) -> list[str]:
    found = []
    for order, (kind, pattern, group, least) in enumerate([
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
    ]):
        found += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text, re.A) if len(m[group]) >= least]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def test_secrets_trigram_queries():
    q = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert q["hex"] == secrets.ALWAYS and q["access"] == {frozenset({"aki", "kia"})}
    assert frozenset({"tok", "oke", "ken"}) in q["assign"] and frozenset({"api", "pi_", "i_k", "_ke", "key"}) in q["assign"] and len(q["assign"]) == 6
    rng = random.Random(4)
    for rule in secrets.RULES:
        for _ in range(200):
            text = "".join(rng.choice(["token", "api_key", "AKIA", "=", ": ", "ghp_", "A" * 36, "0f" * 12, " ", "é"]) for _ in range(8))
            if re.search(rule.pattern, text):
                have = {text.lower()[i : i + 3] for i in range(len(text))}
                assert any(c <= have for c in q[rule.kind])


def test_secrets_against_brute_force(spark):
    rng = random.Random(6)
    bits = ["token", "Secret", "API_KEY", "apikey", "passwd", "password", '"', "'", "=", ":", " ", "  ", "abc", "abcdef12", "AKIA", "AKIA" + "Z9" * 9, "0123456789abcdef" * 2, "é", "\U0001f600", "\n", "x", "token=token=abcdefgh", "secret: token: abcdefgh"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [None, "", "token=abcdef", "AKIA" + "A" * 16, "a" * 24]
    df = spark.createDataFrame([(i if i % 7 else None, t, "old", i) for i, t in enumerate(texts)], "doc_id int, text string, spans string, k int")
    scanned = secrets.scan(df)
    got = {r.k: r for r in scanned.withColumn("all", secrets.spans_text(scanned.spans)).collect()}
    for k, text in enumerate(texts):
        base = [s for s in got[k]["all"].split(",") if s.split(":")[0] in ("assign", "access", "hex")]
        assert base == brute_spans(text or ""), text
    rows = secrets.digest(scanned).collect()
    assert len(rows) == len(texts)


def test_secrets_redaction_and_odd(odd, empty, spark):
    text = "a token = 'abcdef123456' b " + "0f" * 16 + " c"
    df = spark.createDataFrame([(1, text), (2, "clean"), (3, None)], "doc_id int, text string")
    out = {r.doc_id: r.text for r in secrets.redact(secrets.scan(df)).collect()}
    assert out == {1: "a [SECRET]' b [SECRET] c", 2: "clean", 3: None}
    assert len(secrets.digest(secrets.scan(odd)).collect()) == len(ODD) and secrets.digest(secrets.scan(empty)).collect() == []


def test_mixing_counts_follow_the_distribution(spark):
    import math

    docs = spark.range(40_000).selectExpr("id AS doc_id", "'word word' AS text", "IF(id % 4 = 0, 'small', 'big') AS source", "'en' AS lang", "9L AS n_chars")
    out = mixing.mix(docs, {"small": 3.0, "big": 1.0})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert n["small"] == pytest.approx(30_000, rel=0.03) and n["big"] == pytest.approx(10_000, rel=0.03)
    times = {r["times"]: r["count"] for r in out.where("source = 'small'").groupBy("doc_id").count().withColumnRenamed("count", "times").groupBy("times").count().collect()}
    for k in range(1, 6):
        assert times[k] == pytest.approx(10_000 * math.exp(-3) * 3**k / math.factorial(k), rel=0.12)
    keys = [r.mix_key for r in out.collect()]
    assert keys == sorted(keys) and out.collect() == mixing.mix(docs.repartition(3), {"small": 3.0, "big": 1.0}).collect()


def test_mixing_large_means_and_odd(spark, odd, empty):
    one = spark.createDataFrame([(1, "x", "a"), (2, "y" * 2_000, "b")], "doc_id int, text string, source string")
    n = mixing.mix(one, {"a": 1.0, "b": 0.0}).count()
    assert abs(n - 2_001) < 300
    rows = mixing.mix(odd).collect()
    assert {r.doc_id for r in rows} <= {None, 1, 2, 3, 4, 5, 6, 7} and mixing.mix(empty).collect() == []
