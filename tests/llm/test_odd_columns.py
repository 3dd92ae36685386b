"""Every operator and stage on tables with further columns whose names are its own helpers', and on very long inputs."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from martwright.llm import common, langid, mixing, pieces, secrets, sharding, shingles, simhash, tiff, topk, toxicity, urlfilter

NAMES = (
    "_id _text _toxic _cand _kinds _parts _known _row _again _key _best _words _b _n _cdf _copy _changed cand kinds gone number times salt rate cdf source_text known_host known_path "
    "best key fp a b node root h p block words low id mix_key_ component_id fingerprint lang_pred held_out dim q part span lane side held n keys band other drawn"
).split()
ROWS = [
    (1, "a token = 'abcdef123456' and more words than five here", "en", "x", 3),
    (1, "a token = 'abcdef123456' and more words than five here", "en", "x", 3),
    (2, None, None, None, None),
    (3, "", "fr", "y", 0),
    (None, "no id at all", "en", "x", 12),
    (4, "bonjour tout le monde " * 30, "fr", "y", 600),
    (5, "0f" * 16, "en", "y", 32),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES)).cache()


def kept(df, names=NAMES) -> None:
    """The further columns are there with what was in them."""
    assert all(r[n] == f"own {n}" for r in df.collect() for n in names)


def test_clashing_names(spark, docs):
    labels = spark.createDataFrame([(1, 0, 1), (4, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert langid.identify(docs, steps=2).count() == len(ROWS) and toxicity.judge(docs, labels, steps=2).count() == len(ROWS)
    assert simhash.near_duplicates(docs).count() == len(ROWS)
    once = simhash.keep_first(docs)
    assert sorted(r.doc_id or 0 for r in once.collect()) == [0, 1, 2, 4, 5]
    kept(once)
    near = shingles.keep_first(docs.dropDuplicates(["doc_id"]))
    assert near.count() == 6
    kept(near)
    kept(toxicity.keep_clean(docs, None))
    held = [n for n in NAMES if n not in tiff.PAGE_ARROW]
    kept(tiff.pages(tiff.stored(docs)), held)
    assert tiff.text_media(docs).count() == len(ROWS)
    scanned = secrets.scan(docs.withColumn("SPANS", F.lit(1)))
    assert scanned.count() == len(ROWS) and [c for c in scanned.columns if c.lower() == "spans"] == ["spans"]
    kept(scanned)
    kept(secrets.redact(scanned))
    kept(sharding.place(docs, ["s", "t"]))
    mixed = mixing.mix(docs)
    kept(mixed)
    assert {"copy", "mix_key"} <= set(mixed.columns)
    kept(pieces.decode(pieces.encode(docs)))
    assert pieces.round_trip(docs).where("lossless").count() == len(ROWS)
    pages = docs.withColumn("url", F.lit("http://x.com/en/1"))
    judged = urlfilter.judge(pages, urlfilter.entries(spark))
    assert {r.rule for r in judged.collect()} == {"com/en/"}
    kept(judged)
    vectors = docs.withColumn("vec_id", F.coalesce("doc_id", F.lit(0)) * 20).withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0))).withColumn("score", F.lit("x")).withColumn("rank", F.lit("x"))
    assert {r.score for r in topk.top_k(vectors).collect()} == {5 * 64 * 64}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, docs, small, name, stage):
    out = stage(spark, docs, small)
    ids = [r.doc_id for r in out.collect()]
    if name in ("toxicity", "secrets", "pieces"):
        assert sorted(map(str, ids)) == sorted(str(r[0]) for r in ROWS)
    elif name == "near_duplicates":
        assert sorted(map(str, ids)) == ["1", "2", "4", "5", "None"]  # one of the repeated rows, one of the texts without words
    if name != "pieces":
        assert out.columns == [*corpus_pipeline.COLUMNS, *(["copy"] if name == "mixing" else [])]
    if name == "secrets":
        assert [r.n_chars for r in out.collect() if r.doc_id == 1] == [len("a [SECRET]' and more words than five here")] * 2


def test_mixing_many_sources(spark, docs, monkeypatch):
    """With more sources than are broadcast, rows of a source are salted; the result is the same."""
    want = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "MOST_SOURCES", 0)
    assert sorted(map(str, mixing.mix(docs).collect())) == want


def test_long_hosts_and_lists(spark):
    urls = ["x://" + "a." * 100_000 + "com/en/" + "z" * 100_000, "x://h7.com/p7/q", "x://www.h9.com/p9", "x://h9.com/p"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    assert [r.rule for r in urlfilter.judge(df, urlfilter.entries(spark)).orderBy("page_id").collect()] == ["com/en/", None, None, None]
    many = spark.range(30_000).selectExpr("concat('h', id, '.com') AS host", "concat('/p', id) AS path", "'block' AS verdict", "true AS is_rule")
    assert [r.rule for r in urlfilter.judge(df, many).orderBy("page_id").collect()] == [None, "h7.com/p7", "h9.com/p9", None]


def test_helpers():
    assert common.fresh(["A", "a_"], "a", "b", "B") == ["a__", "b", "B_"]
    unset = SimpleNamespace(get=lambda *a: None)
    with pytest.raises(RuntimeError):  # on a cluster the shared folder must be named
        common.shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master="spark://somewhere:7077")))


def test_samples(spark):
    df = spark.createDataFrame([(1, "same")] * 500 + [(k, "t") for k in range(2, 500)], "k int, t string")
    key = F.concat_ws(":", "k", "t")
    assert common.sampled(df, key, 40).count() == 40 and common.sampled(df.where("k = 1"), key, 40).count() == 40 and common.sampled(df.where("k = 0"), key, 40).count() == 0
    long = "".join(map(str, range(5_000)))
    (row,) = spark.createDataFrame([(long,)], "t string").select(common.excerpt(F.col("t"), 800)).collect()
    parts = row[0].split("\n")
    assert len(parts) == 8 and all(len(p) == 100 and p in long for p in parts) and parts[0] == long[:100] and parts[-1] == long[-100:]
