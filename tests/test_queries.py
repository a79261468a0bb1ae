"""Every query that has SQL gives the rows that DuckDB gives, and the plans are as meant."""

import datetime
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus
from corpusloom.plans import corpus_queries, event_queries, vector_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = corpus_queries.QUERIES | event_queries.QUERIES | vector_queries.QUERIES
ORACLE = corpus_queries.ORACLE_SQL | event_queries.ORACLE_SQL | vector_queries.ORACLE_SQL


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, data_dir, name):
    df = QUERIES[name](spark, data_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    relation = duck.sql(ORACLE[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())


def test_queries_without_sql_run(spark, data_dir):
    for name in set(QUERIES) - set(ORACLE):
        assert QUERIES[name](spark, data_dir).count() > 0, name


def test_results_do_not_depend_on_partitions(spark, data_dir):
    """Same stream and chunks from 1, 3 and 8 shuffled partitions, with and without adaptive execution."""
    rows = corpus_queries.keyed(spark, data_dir).where("role = 'train'").select("doc_id", "key", "n_tokens").checkpoint()
    want = None
    for n in (1, 3, 8):
        for adaptive in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            pieces = corpus.cut_chunks(corpus.stream_offsets(rows.repartition(n, F.rand(3))), 4096)
            got = sorted(map(tuple, pieces.select("chunk_id", "doc_id", "pos", "from_doc", "n_piece").collect()))
            want = want or got
            assert got == want
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_only_needed_columns_are_read(spark, data_dir):
    plan = corpus_queries.q_unit_stats(spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan and "lang" not in plan


def test_tokenizer_runs_once(spark, data_dir):
    plan = corpus_queries.q_framed_tokens(spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_entry(spark):
    import __spark_entry__

    assert os.path.isdir("/root/testdata/sf0.001")
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
