"""Null ids of items, long hosts, columns whose names clash, rows repeated beyond a bucket."""

import collections
import hashlib
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import common, crf_lang, decontam, linespread, sharding, simhash_wide, urlfilter
from tests.conftest import SF

TAKEN = ["lang_pred", "score", "__lang_pred", "__score", "n_lines", "n_removed", "__kept", "__text", "text_key", "drop", "__keep", "as_text", "key", "own_key", "runs", "__shard", "__bucket", "__place", "__key", "base", "held", "row", "a.b"]


@pytest.mark.parametrize("room", [500_000, 5])
def test_item_without_id(spark, room):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x y"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, "b c"), (None, "a b"), (7, "b c"), (8, None)], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs, items, max_item_words=room).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [(got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) for i in (1, 2, 3)] == [(4, 3, 2, digest("7")), (2, 0, 0, digest("")), (0, 0, 0, digest(""))]
    assert {r.doc_id: r.text for r in decontam.remove_hits(docs, items, max_item_words=room, max_coverage=0.8).collect()} == {1: " d", 2: "x y", 3: None}


def test_long_hosts(spark):
    urls = [f"http://{'a.' * n}example.net/en/x" for n in (10, 2000, 60_000)] + [None] * 50 + ["no scheme"] * 50
    rules = spark.createDataFrame(urlfilter.DEFAULT_RULES, "host string, path string, action string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    urlfilter.filter_urls(pages.limit(1), rules).collect()
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.filter_urls(pages, rules).collect()}
    assert time.time() - began < 20 and len(got) == len(urls)
    assert [got[i] for i in range(4)] == [("example.net/en/", "allow")] * 3 + [(None, "allow")]


def test_clashing_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).cache()
    wide = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in TAKEN])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, SF)
        assert got.columns == wide.columns, name
        assert not got.filter(F.concat_ws("", *[common.col(c) for c in TAKEN]) != "".join(f"own {c}" for c in TAKEN)).count()
        plain = {r.doc_id: r.text for r in stage(spark, docs, SF).collect()}
        assert {r.doc_id: r.text for r in got.collect()} == plain, name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, SF).count() > 0
    sharding.write_shards(wide, str(tmp_path / "s"), n_shards=2, bucket_bytes=20_000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == sharding.assign_shards(wide, n_shards=2, bucket_bytes=20_000).count() == 60
    counted = linespread.remove_boilerplate(wide)
    assert dict(counted.dtypes)["n_lines"] == "bigint" and counted.count() == 60
    with pytest.raises(ValueError):
        crf_lang.label_documents(wide, crf_lang.train(docs))
    assert decontam.remove_hits(wide, docs.select(F.col("doc_id").alias("item_id"), F.substring("text", 1, 200).alias("text")), max_item_words=100).columns == wide.columns
    assert simhash_wide.keep_one(wide).columns == wide.columns


def test_rows_repeated_beyond_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SAME_ROWS", 50)
    docs = spark.range(400).select(F.lit(5).alias("doc_id"), F.lit("the same text").alias("text")).unionByName(spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))).repartition(4)
    got = sharding.assign_shards(docs, n_shards=2, bucket_bytes=1000).collect()
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    n = collections.Counter(r.shard for r in got)
    assert sum(n.values()) == 500 and all(sorted(r.slot for r in got if r.shard == s) == list(range(n[s])) for s in n)
