"""Alignment against a plain walk over both tokenizers' own libraries, with their own readers of the files."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from martwright.llm import align

ODD = [None, "", " ", "  two  spaces ", "a▁b", "tab\tand\nlines\n\n", "é ﬁ ① 日本語 🙂🙂", "<|endoftext|> <s> </s> <unk> <0x41>", "a\x00b\x7f", "don't they're I'LL", "x" * 300, "1234567 89.10", "  nbsp", "ｆｕｌｌ", "é́"]


def by_definition(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(align.BYTE_BPE)
    hf.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=align.PIECES)
    symbols, entry = align.byte_symbols(), {i: e for e, i in hf.get_vocab().items()}
    of_a = lambda i: bytes(symbols[c] for c in entry[i])
    of_b = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    rows, held = [], Counter()
    for text in texts:
        whole = (" " + text).encode() if text else b""
        a = hf.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        if b"".join(map(of_a, a)) != whole or b"".join(map(of_b, b)) != whole:
            a, b = [], []
        owner_a, owner_b = ([k for k, i in enumerate(ids) for _ in f(i)] for ids, f in ((a, of_a), (b, of_b)))
        pairs = sorted(set(zip(owner_a, owner_b, strict=True)))  # one for each overlap, byte by byte
        links = [(a[x], b[y]) for x, y in pairs]
        ends = [{k + 1 for k in range(len(o)) if k + 1 == len(o) or o[k] != o[k + 1]} for o in (owner_a, owner_b)]
        groups, start = [], 0
        for end in sorted(ends[0] & ends[1]):
            groups.append([[ids[k] for k in sorted(set(o[start:end]))] for ids, o in ((a, owner_a), (b, owner_b))])
            start = end
        held.update(set(links))
        rows.append((a, b, groups, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for a, b, groups, links in rows:
        line = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(line.encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), digest))
    return rows, out


@pytest.fixture(scope="module")
def texts(spark, small):
    rng = random.Random(2)
    own = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    mixed = ["".join(rng.choices([t for t in ODD if t] + ["the cat ", "été "], k=6)) for _ in range(60)]
    return [*ODD, *own[:60], *mixed, own[0], own[0]]


def test_by_definition(spark, texts):
    rows = [(k, t, "z") for k, t in enumerate(texts)] + [(None, "the cat", "z")]
    frame = spark.createDataFrame(rows, "id long, Text string, block string").repartition(5)
    _, want = by_definition([*texts, "the cat"])
    got = {r["doc_id"]: tuple(r)[1:] for r in align.digest(frame, "id", "Text").collect()}
    assert got == {k: w for (k, _, _), w in zip(rows, want, strict=True)}


def test_blocks_change_nothing(spark, texts, monkeypatch):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    whole = sorted(align.digest(frame).collect())
    monkeypatch.setattr(align, "MOST_PAIRS", 50)
    monkeypatch.setattr(align, "ROW_PAIRS", 7)
    monkeypatch.setattr(align, "TEXT_BYTES", 300)
    assert sorted(align.digest(frame).collect()) == whole
    assert align.digest(frame.where("doc_id < 0")).count() == 0


def test_groups_and_products(spark, texts):
    rows, _ = by_definition(texts)
    frame = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, Links int")
    made = align.aligned(frame)
    assert made.columns == ["doc_id", "text", "groups", "links"]
    for r in made.collect():
        _, _, groups, links = rows[r["doc_id"]]
        assert [[g["a"], g["b"]] for g in r["groups"]] == groups
        assert [(p["a"], p["b"]) for p in r["links"]] == links
    pairs = Counter((r["doc_id"], r["group"], r["a"], r["b"]) for r in align.products(made).collect())
    assert pairs == Counter((k, n, x, y) for k, row in enumerate(rows) for n, (a, b) in enumerate(row[2]) for x in a for y in b)


def test_packed_numbers():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2097151, 2097152, (1 << 28) - 1, 5])
    raw, size = align.packed(values)
    assert size.tolist() == [1, 1, 1, 2, 2, 3, 3, 4, 4, 1] and align.unpacked(raw).tolist() == values.tolist()
    assert len(align.unpacked(np.zeros(0, np.uint8))) == 0
