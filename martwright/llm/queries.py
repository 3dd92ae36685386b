"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import attribution, chat, mixing, secrets, sharding, topk, urlfilter
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


@query("op5_url_filter", urlfilter.oracle())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, urlfilter.entries(spark)).drop("url")


@query("op6_lookup_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read(spark, sf_dir, "documents"), [f"shard-{k:03d}" for k in range(256)])


@query("op7_secret_scan", secrets.oracle())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op9_poisson_mixing", mixing.oracle())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    return langid.identify(read(spark, sf_dir, "documents"))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op4_tiff_pages")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tiff

    return tiff.text_media(read(spark, sf_dir, "documents"))


@query("op8_merge_dropout")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pieces

    return pieces.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_exact_topk", topk.oracle())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op11_chat_format", chat.oracle())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_chats(chat.with_fixed(read(spark, sf_dir, "conversations"))))


@query("op12_click_attribution", attribution.oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute(read(spark, sf_dir, "clicks"), read(spark, sf_dir, "sales"))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import align

    return align.digest(read(spark, sf_dir, "documents"))
