"""URL filters by a sort-merge range join (operator 11, DataFrame functions only).

A host is keyed by its labels in reverse, each with a dot behind it, so that a host and all its subdomains are one interval of
keys; a path is keyed behind its host, so that all paths with a prefix are one interval.  Keys of rules and urls are sorted
together into ranges, and a sweep goes through each range with the stack of rules that are open: a rule's row carries the stack
as it is once the rule has opened (the rules it is nested in, and itself), a url takes the stack of the last rule before it, and
pops those whose interval has ended.  A rule that still is open can't have been lost: all keys between it and the url begin with it.

A rule with a path fits subdomains too, which is no single interval of host and path.  So there are two sweeps: over hosts, which
finds the rule hosts a url lies under, and over the paths behind each of these.

No range, rule or host is hot: ranges are cut between rows of one key too, and what is open at a range's start is one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.ordered import sorted_parts
from corpusloom.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(x: Column) -> Column:
    """A-Z only."""
    return F.translate(x, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host from the first ``://`` up to ``/``, ``?``, ``#`` or the end; path from there up to ``?``, ``#`` or the end."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise("")
    return lowered(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """``a.example.com`` as ``com.example.a.``; the empty host, over all others, as the empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``host, path, action`` of rules given as parameters."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in rules]
    empty = F.expr("cast(array() as array<struct<host: string, path: string, action: string>>)")
    return spark.range(1).select(F.inline(F.array(*rows) if rows else empty))


def with_stacks(rules: DataFrame, entry: Column) -> DataFrame:
    """``_key, _stack`` of rules with distinct ``_key``: the ``entry`` of each rule it is nested in, outermost first, and its own."""
    named = rules.select("_key", entry.alias("_entry"))
    prefixes = named.select(F.col("_key").alias("_own"), F.explode(F.expr("transform(sequence(0, length(_key)), n -> substring(_key, 1, n))")).alias("_key"))
    met = prefixes.join(named.hint("merge"), "_key")
    stack = F.transform(F.array_sort(F.collect_list(F.struct(F.length("_key").alias("n"), F.col("_entry").alias("e")))), lambda x: x["e"])
    return met.groupBy(F.col("_own").alias("_key")).agg(stack.alias("_stack"))


def sweep(points: DataFrame, rules: DataFrame, tie: str) -> DataFrame:
    """``points`` with ``_open``: of the rules (``_key, _stack``; entries have ``key``) those whose interval holds the point's ``_key``.

    ``tie`` tells points of one key apart, so that ranges can be cut between them.
    """
    nothing = F.lit(None)
    columns = [c for c in points.columns if c != "_key"]
    kinds = dict(rules.dtypes)
    marked = points.withColumns({"_opens": nothing.cast("string"), "_stack": nothing.cast(kinds["_stack"]), "_point": F.lit(True)})
    opened = rules.select("_key", F.col("_key").alias("_opens"), "_stack", F.lit(False).alias("_point"))
    parts = sorted_parts(marked.unionByName(opened, allowMissingColumns=True), ["_key", "_point", tie])
    # The stack that the ranges before it leave.  This window is over one row per range, whatever the number of rows.
    left = parts.groupBy("_part").agg(F.max_by("_stack", "_opens").alias("_left"))
    carried = left.select("_part", F.last("_left", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    so_far = Window.partitionBy("_part").orderBy("_key", "_point", tie).rowsBetween(Window.unboundedPreceding, 0)
    swept = parts.withColumn("_last", F.last("_stack", ignorenulls=True).over(so_far)).where("_point").join(carried.hint("merge"), "_part")
    empty = F.array().cast(kinds["_stack"])
    still = F.filter(F.coalesce("_last", "_carried", empty), lambda e: F.startswith(F.col("_key"), e["key"]))
    return swept.select("_key", *columns, still.alias("_open"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every url: ``id_col, host, path, rule, verdict``, one row per input row.

    ``rules`` has ``host, path, action`` (allow or block; another action is an error).  A rule fits its host and all subdomains
    where the url's path starts with the rule's; the longest (host and path together, then host) wins, and of one rule given as
    both, block.  Where none fits, ``rule`` is null and the verdict is ``default``.

    A url that is null or has no ``://`` has an empty host and path; an empty path starts with ``/`` no more than any other
    does.  Null hosts and paths of rules count as empty: an empty host is over all hosts, the empty one included.  Rules whose
    host holds one of ``/?#``, or whose path is neither empty nor begins with ``/``, fit nothing.  Ports stay part of a host.
    Null and repeated ids are judged like others; urls may have any length; an empty table gives an empty result, no rules the
    default for all; other columns are not read.
    """
    spark = pages.sparkSession
    action = F.when(F.col("action").isin("allow", "block"), F.col("action")).otherwise(F.raise_error(F.lit("an action is neither allow nor block")).cast("string"))
    known = rules.select(lowered(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), action.alias("action"))
    # "block" is the larger word.
    known = known.where(~F.col("host").rlike("[/?#]") & ((F.col("path") == "") | F.startswith("path", F.lit("/")))).groupBy("host", "path").agg(F.max("action").alias("action"))
    known = stored(known.withColumn("_host_key", host_key(F.col("host"))))

    host, path = host_and_path(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).select("_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"_key": host_key(F.col("host")), "_row": F.monotonically_increasing_id()})

    hosts = known.select(F.col("_host_key").alias("_key")).distinct()
    under = stored(sweep(rows, with_stacks(hosts, F.struct(F.col("_key").alias("key"))), "_row").drop("_key"))

    paths = known.select(F.concat("_host_key", "path").alias("_key"), F.concat("host", "path").alias("rule"), "action", F.length("host").alias("h"))
    entry = F.struct(F.col("_key").alias("key"), "rule", "action", "h")
    behind = under.where(F.size("_open") > 0).select("_id", "host", "path", "_row", F.explode("_open.key").alias("_host"))
    swept = sweep(behind.withColumn("_key", F.concat("_host", "path")).drop("_host"), with_stacks(paths, entry), "_row")
    innermost = F.try_element_at("_open", F.lit(-1))
    ranked = F.when(F.size("_open") > 0, F.struct(F.length(innermost["rule"]).alias("n"), innermost["h"].alias("h"), innermost["rule"].alias("rule"), innermost["action"].alias("action")))
    judged = swept.groupBy("_row", "_id", "host", "path").agg(F.max(ranked).alias("_best"))
    others = under.where(F.size("_open") == 0).select("_row", "_id", "host", "path", F.lit(None).cast(dict(judged.dtypes)["_best"]).alias("_best"))
    return judged.unionByName(others).select(F.col("_id").alias(id_col), "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.action", F.lit(default)).alias("verdict"))
