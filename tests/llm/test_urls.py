"""URL filters against a plain search through all rules."""

import random

import duckdb
import pytest
from brute import judged, rows

from corpusloom.llm import queries
from corpusloom.llm.url_filters import judge_urls, rules_table

PAGES = "page_id long, url string, html string"
KEY = lambda r: tuple((x is not None, x) for x in r)


def check(spark, pages, rules, **options):
    df = spark.createDataFrame([(i, u, None) for i, u in pages], PAGES).repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, action string")
    found = sorted(rows(judge_urls(df, table, **options)), key=KEY)
    assert found == sorted(judged(pages, rules, options.get("default", "allow")), key=KEY)


def test_nested_rules_and_odd_urls(spark):
    labels = ["com", "net", "example", "www", "a", "-b", "", "xn--é", "COM"]
    hosts = ["", *(".".join(random.Random(i).choices(labels, k=random.Random(i).randint(1, 4))) for i in range(60))]
    paths = ["", "/", "/e", "/en", "/en/", "/en/x", "/-", "/.", "/é", "/en/x/y?q=/en", "/#/es/"]
    rng = random.Random(1)
    urls = [None, "", "no scheme", "://", "http://", "x://y://z/en/", "HTTP://WWW.Example.COM/En/", "http://com?/", "http://a.com#/en/", "s://a\n.com/\n/en", "http://com:80/"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(600)]
    urls += ["http://www.example.com/en/x"] * 300 + ["http://" + "a." * 3000 + "com/en/" + "x" * 50_000]
    rules = sorted({(rng.choice(hosts), rng.choice(paths[:9]), rng.choice(["allow", "block"])) for _ in range(120)}) + [("com", "/e", "allow"), ("com", "/e", "block"), ("COM", "/en", "block"), (None, None, "block"), ("", "/en/x", "allow"), ("a/b", "/", "block"), ("net", "en", "block")]
    check(spark, [(rng.choice([None, 7, i]), u) for i, u in enumerate(urls)], rules)
    check(spark, [(i, u) for i, u in enumerate(urls)], [r for r in rules if r[0]], default="block")


def test_one_range_has_no_rules_and_another_all(spark):
    rules = [("m.com", "/" + "x" * i, "block") for i in range(40)]
    check(spark, [(i, f"http://{c}.m.com/{'x' * (i % 50)}") for i, c in enumerate("abcxyz" * 60)] + [(0, "http://zz.net/")] * 50, rules)


def test_empty_tables_extra_columns_and_bad_actions(spark):
    none = spark.createDataFrame([], PAGES)
    pages = spark.createDataFrame([(1, "http://a.com/x", "h", "w", "w", "w")], PAGES + ", host string, _row string, _key string")
    rules = rules_table(spark, [("com", "/", "block")])
    assert judge_urls(none, rules).count() == 0
    assert rows(judge_urls(pages, rules)) == [(1, "a.com", "/x", "com/", "block")]
    assert rows(judge_urls(pages, rules_table(spark, []))) == [(1, "a.com", "/x", None, "allow")]
    with pytest.raises(Exception, match="neither allow nor block"):
        judge_urls(pages, rules_table(spark, [("com", "/", "drop")])).collect()


def test_query_against_sql(spark, data_dir):
    found = sorted(rows(queries.op11_url_filters(spark, data_dir).select("page_id", "host", "path", "rule", "verdict")), key=KEY)
    con = duckdb.connect()
    con.sql(f"create view pages as from '{data_dir}/pages.parquet'")
    assert found == sorted(con.sql(queries.OP11_SQL).fetchall(), key=KEY)
    assert len({r[3] for r in found}) > 2
