"""Near-duplicate groups, sketches and components."""

import random

import brute
import numpy as np
import pytest

from corpusloom.llm import setsketch
from corpusloom.llm.near_dedup import cross_pairs, drop_near_duplicates, near_duplicates, shingle_sets
from corpusloom.llm.shingles import WordHash, shingle_set
from corpusloom.plans.components import connected_components


@pytest.mark.parametrize("width", [4, 5])
def test_components_match_brute_force(edge_docs, edge_rows, width):
    assert set(brute.rows(near_duplicates(edge_docs, width=width))) == brute.near([r[:2] for r in edge_rows], width)


def test_tables_match_brute_force(small):
    assert set(brute.rows(near_duplicates(small, width=4))) == brute.near(brute.rows(small.select("doc_id", "text")))


def test_links_between_components_of_a_bucket(spark):
    """Documents around the threshold share buckets, and stars alone miss links; the last round must not."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(words)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(60)] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert set(brute.rows(near_duplicates(df, width=4))) == brute.near(rows)


@pytest.mark.parametrize("strip", [3, 7, 1024])
def test_cross_pairs_of_strips_lose_no_link(spark, strip):
    """All links between components of a bucket are found, few other pairs are, and a strip is paired with strips only."""
    rng = random.Random(strip)
    base = [f"w{i}" for i in range(80)]
    docs = []
    for i in range(120):
        w = base[: rng.choice([60, 70, 80])]
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 20)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = shingle_sets(df, 4).checkpoint()
    labelled = spark.createDataFrame([(key, i, i // 2) for key, ids in ((1, range(120)), (2, range(0, 120, 3)), (3, [5])) for i in ids], "key long, doc_id long, comp long")
    found = set(brute.rows(cross_pairs(labelled, sets, 80, strip)))
    plain = {i: brute.shingles(t, 4) for i, t in docs}
    links = {(a, b) for a in plain for b in plain if a < b and a // 2 != b // 2 and 100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b])}
    assert len(links) > 50 and links <= found
    assert all(a // 2 != b // 2 and 100 * len(plain[a] & plain[b]) >= 70 * len(plain[a] | plain[b]) for a, b in found)


def test_edges(spark, no_docs, clashing, edge_docs):
    assert near_duplicates(no_docs).count() == 0
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (7, text), (7, text), (9, text + " z"), (None, "only"), (None, None), (3, None), (4, "")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(map(str, brute.rows(out)))
    assert got == sorted(map(str, [(None, 46, 7, False), (7, 46, 7, True), (7, 46, 7, True), (9, 47, 7, False), (None, 1, None, True), (None, 0, None, True), (3, 0, 3, True), (4, 0, 4, True)]))
    kept = drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns
    assert kept.count() == near_duplicates(edge_docs).where("kept").count()


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.8, 0.95):
        common = rng.integers(0, 1 << 64, int(4000 * share), np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 64, int(4000 * (1 - share)), np.uint64)])) for _ in range(2))
        ra, rb = setsketch.sketches([a, b], 512)
        assert np.array_equal(setsketch.merged(ra, rb), setsketch.sketches([np.union1d(a, b)], 512)[0])
        more, less = (ra > rb).sum(), (ra < rb).sum()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        guess = setsketch.joint_jaccard(*(np.array([x], float) for x in (more, less, 512 - more - less, len(a), len(b))))[0]
        assert abs(guess - true) < 5 * (true * (1 - true) / 512) ** 0.5
    whole = rng.integers(0, 1 << 64, 100_000, np.uint64)
    assert np.array_equal(setsketch.sketches([whole], 16)[0], np.maximum.reduce([setsketch.sketches([p], 16)[0] for p in np.array_split(whole, 7)]))


def test_recall_of_bands_at_the_threshold():
    """Of pairs at similarity 0.8, those that share no band are fewer than can show up here."""
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(300):
        x = rng.integers(0, 1 << 64, 540, np.uint64)
        a, b = x[:486], np.concatenate([x[:432], x[486:]])
        assert 432 / 540 == 0.8
        keys = setsketch.band_keys(setsketch.sketches([np.sort(a), np.sort(b)], 128), 4)
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0


def test_shingles(edge_rows):
    hashes = WordHash()
    for _, text, *_ in edge_rows:
        for width in (1, 4, 5):
            assert len(shingle_set(text, width, hashes)) == len(brute.shingles(text, width))
    assert np.array_equal(shingle_set("A b  C\nd e", 4, hashes), shingle_set("a B c d\tE", 4, hashes))


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(1000, 1050)] + [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(2000, 2000 + i) for i in range(100)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in parent if find(x) != x}
    assert set(brute.rows(connected_components(spark.createDataFrame(edges, "a long, b long")))) == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_need_no_step_to_see_the_end(spark, monkeypatch):
    """Tables written: the edges, and one for each step; stars need none, and what a step makes stars needs no other."""
    from corpusloom.plans import components

    written = []
    monkeypatch.setattr(components, "stored", lambda df: written.append(1) or df.checkpoint())
    stars = [(5, 5 + i) for i in range(1, 40)] + [(100, 101)]
    leader = [(min(i, 20), max(i, 20)) for i in range(40) if i != 20]
    for edges, steps, want in ((stars, 0, {(b, a) for a, b in stars}), (leader, 1, {(i, 0) for i in range(1, 40)}), ([], 0, set())):
        written.clear()
        assert set(brute.rows(components.connected_components(spark.createDataFrame(edges, "a long, b long")))) == want
        assert len(written) == 1 + steps


def test_group_values_without_parts(spark):
    """The same values with one shuffle less, though a group holds most rows."""
    from pyspark.sql import functions as F

    from corpusloom.plans.groups import with_group_values

    rows = spark.createDataFrame([(i % 7 if i % 10 == 0 else 99, i) for i in range(1000)], "k long, v long")
    parts = with_group_values(rows, ["k"], F.xxhash64("v"), [F.min("v").alias("_p")], [F.min("_p").alias("m")])
    direct = with_group_values(rows, ["k"], F.xxhash64("v"), [], [F.min("v").alias("m")])
    shuffles = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (parts, direct)]
    assert shuffles[1] == shuffles[0] - 1
    assert sorted(brute.rows(direct)) == sorted(brute.rows(parts)) and direct.count() == 1000
