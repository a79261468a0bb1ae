"""Manifests against a plain tree, with blocks of few nodes so that there are several rounds."""

import random

import duckdb
import pytest
from brute import merkle, rows

from corpusloom.llm import queries
from corpusloom.llm.merkle import backward, forward, height_of, verify_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
KEY = lambda r: tuple((x is not None, x) for x in r)


def check(spark, data, **options):
    found = sorted(rows(verify_manifest(spark.createDataFrame(data, SCHEMA).repartition(3), **options)), key=KEY)
    assert found == sorted(merkle(data), key=KEY)
    return found


def test_a_block_against_the_plain_tree():
    for n in range(1, 40):
        digests = [f"{i:064x}" for i in range(n)]
        height = height_of(n, 12)
        root, parents = forward(digests, height)
        paths = backward(parents, height, "")
        assert len(paths) == n and all(sum(p.count(c) for c in "LRN") == height for p in paths)
        assert n > 1 or (root, paths) == (digests[0], [""])


def test_edges(spark):
    rng = random.Random(3)
    data = [(rng.choice([None, i, i, 5]), rng.choice([None, "", "s"]), rng.choice([None, "", "-", "de", "é", "z"]), rng.choice([None, 0, -1, 2**63 - 1]), rng.choice([None, "", "é" * 3, "x" * 300_000])) for i in range(70)]
    found = check(spark, data + [(9, "s", "de", 1, "same")] * 5)
    assert {r[6] for r in found} == {True, False}


@pytest.mark.parametrize("sizes", [(1,), (2,), (1, 1), (4, 5, 16), (17, 1, 64, 65)])
def test_rounds(spark, sizes):
    check(spark, [(1000 * g + i, "s", f"l{g}", i, f"t{i}") for g, n in enumerate(sizes) for i in range(n)], bits=2)


def test_many_groups(spark):
    check(spark, [(i, None, f"g{i}", i, "t") for i in range(21)], bits=2)


def test_empty_table_and_extra_columns(spark, no_docs, clashing, edge_rows):
    assert verify_manifest(no_docs).count() == 0
    plain = [(d, s, g, n, t) for d, t, g, s, n in edge_rows]
    assert sorted(rows(verify_manifest(clashing)), key=KEY) == sorted(merkle(plain), key=KEY)


def test_query_against_sql(spark, data_dir):
    found = sorted(rows(queries.op13_merkle(spark, data_dir)))
    con = duckdb.connect()
    con.sql(f"create view documents as from '{data_dir}/documents.parquet'")
    assert found == sorted(con.sql(queries.OP13_SQL).fetchall())
    assert 0 < sum(not r[6] for r in found) < len(found) / 4
