"""Exact dedup, mixing and sharding."""

import zlib
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from corpusloom.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from corpusloom.llm.mixing import mix_sources, sized_documents, slot_schedule, source_targets
from corpusloom.llm.sharding import permuted, shard_rows


def test_exact_matches_brute_force(edge_docs, edge_rows, small):
    assert set(brute.rows(exact_duplicates(edge_docs))) == brute.exact([r[:2] for r in edge_rows])
    assert set(brute.rows(exact_duplicates(small, salts=3))) == brute.exact(brute.rows(small.select("doc_id", "text")))


def test_exact_edges(spark, no_docs, clashing, edge_docs):
    assert exact_duplicates(no_docs).count() == 0
    assert set(brute.rows(exact_duplicates(clashing))) == set(brute.rows(exact_duplicates(edge_docs)))
    rows = [(None, "a"), (5, "a"), (5, "a"), (None, "b"), (None, "b")]
    got = sorted(map(str, brute.rows(exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_sha256"))))
    assert got == sorted(map(str, [(None, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True), (None, None, 2, True), (None, None, 2, True)]))
    kept = drop_exact_duplicates(clashing)
    assert kept.columns == clashing.columns
    assert kept.count() == exact_duplicates(edge_docs).where("kept").count()


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_mixing_reaches_targets(edge_docs, block):
    out = mix_sources(edge_docs, block=block).join(edge_docs.select("doc_id", "source"), "doc_id").collect()
    assert len(out) == edge_docs.count()
    assert all(0 <= r.taken <= 2 * r["size"] for r in out)
    for source in {r.source for r in out}:
        own = [r for r in out if r.source == source]
        assert sum(r["size"] for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) < 1


def test_mixing_weights_and_caps(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate(["a"] * 30 + ["b"] * 60 + ["c"] * 90 + [None] * 20)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).join(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id")
    got = {r.source: round(r.target, 6) for r in out.select("source", "target").distinct().collect()}
    # 3000 words over weights 5, 2, 1, 5: a is full at 600 and null at 400; b and c share 2000 as 2 to 1, b stops at 1200.
    assert got == {"a": 600.0, "b": 1200.0, "c": 800.0, None: 400.0}


def test_mixing_edges(spark, no_docs, clashing, edge_docs):
    assert mix_sources(no_docs).count() == 0
    assert set(brute.rows(mix_sources(clashing))) == set(brute.rows(mix_sources(edge_docs.repartition(3))))
    empty = mix_sources(spark.createDataFrame([(1, None, None), (None, "", "a")], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2
    twice = spark.createDataFrame([(1, "a b c d", "s"), (1, "a b c d", "s"), (None, "e f", "s")], "doc_id long, text string, source string")
    out = mix_sources(twice).collect()
    assert len(out) == 3 and sum(r.taken for r in out) == 15


def test_schedule_keeps_proportions_everywhere(small):
    sized = sized_documents(small, "doc_id", "text", "source", "mix")
    targets = source_targets(sized, (5, 2, 1), 1.5, 2, 16, 64).checkpoint()
    slots = [r._src for r in slot_schedule(targets).orderBy("slot").collect()]
    want = {r._src: r._want for r in targets.collect()}
    assert Counter(slots) == Counter({k: v for k, v in want.items() if v})
    for cut in (len(slots) // 4, len(slots) // 2):
        part = Counter(slots[:cut])
        assert all(abs(part[s] - want[s] * cut / len(slots)) < 12 for s in want)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 101, 4096, 9999])
def test_feistel_is_a_permutation(spark, n):
    df = spark.range(n).withColumn("n", F.lit(n).cast("long"))
    got = [r[0] for r in df.select(permuted(F.col("id"), F.col("n"), 3)).collect()]
    assert sorted(got) == list(range(n))
    assert n < 100 or got != list(range(n))


def test_sharding(edge_docs, edge_rows, no_docs, clashing, spark):
    out = shard_rows(edge_docs, shards=8).collect()
    text = {r[0]: (r[1] or "").encode() for r in edge_rows}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in out} == {(d, len(t) + 1, zlib.crc32(t)) for d, t in text.items()}
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(n))
    assert set(map(tuple, out)) == set(brute.rows(shard_rows(clashing.repartition(2))))
    assert shard_rows(no_docs).count() == 0
    odd = spark.createDataFrame([(None, None), (1, "a"), (1, "a"), (1, "b")], "doc_id long, text string")
    assert sorted((r.shard, r.slot) for r in shard_rows(odd, shards=2).collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
