"""Mixing sources to target weights by a low-discrepancy schedule (operator 5, DataFrame functions only).

Each source's documents are shuffled by a keyed digest and laid end to end as a stream of words,
which is cut into blocks of equal length.  Slot ``i`` of the schedule takes the point
``frac(i * golden ratio)`` and maps it through the sources' cumulative slot weights, so every stretch
of the schedule holds each source in proportion.  Slots are ranked per source, and rank ``r`` takes
block ``r mod K`` of that source's ``K`` blocks.  A source's slots end where its target is reached;
the few slots that the points leave short (a low-discrepancy sequence is off by a logarithm) are
appended behind the schedule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.ranking import hash_bucket, with_prefix_sum
from corpusloom.session import shuffle_partitions, stored

WORD = r"[^\x20\x09-\x0D]+"
#: 2^32 divided by the golden ratio, rounded to an odd number: multiples mod 2^32 are the golden-ratio points.
GOLDEN_32 = 2654435769
BINS = 1024


def sized_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """Narrow rows ``_id, _src, _size, _order, _bucket``; ``_src`` sorts by code point, null last."""
    return docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("~")).alias("_src"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("_order"),
    ).withColumn("_bucket", hash_bucket("_order"))


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, max_repeat: float, block: int, min_blocks: int) -> DataFrame:
    """One row per source: size, target, block length, blocks, slots wanted and cumulative slot weights.

    A target is ``min(max_repeat * size, level * weight)``; the level that spends the whole budget is
    found by ordering the sources by the level at which they fill up.  This table has one row per source
    whatever the number of documents, so its windows over all sources are small.
    """
    per = sized.groupBy("_src").agg(F.sum("_size").alias("source_size"))
    by_name = Window.orderBy("_src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    per = per.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(max_repeat)))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), "_src")
    whole = Window.partitionBy()
    per = (
        per.withColumn("_budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_budget") - F.col("_capped")) / F.col("_open"))
        .withColumn("_level", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_src", "_level"))).over(whole)["_level"])
        .withColumn("target", F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_w"))))
        .withColumn("_quota", F.floor(F.col("target") + F.lit(1e-6)).cast("long"))
        .withColumn("_block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / F.lit(min_blocks)))).cast("long"))
        .withColumn("_blocks", F.ceil(F.col("source_size") / F.col("_block")).cast("long"))
        # Slots that fill the quota: whole passes over all blocks, then blocks of the last pass.
        .withColumn("_passes", F.when(F.col("source_size") > 0, F.expr("_quota div source_size")).otherwise(0))
        .withColumn("_want", F.col("_passes") * F.col("_blocks") + F.ceil((F.col("_quota") - F.col("_passes") * F.col("source_size")) / F.col("_block")))
    )
    upto = by_name.rowsBetween(Window.unboundedPreceding, 0)
    return (
        per.withColumn("_slots", F.sum("_want").over(whole))
        .withColumn("_hi", F.when(F.col("_slots") > 0, F.sum("_want").over(upto) / F.col("_slots")).otherwise(0.0))
        .withColumn("_lo", F.coalesce(F.lag("_hi").over(by_name), F.lit(0.0)))
        .select("_src", "source_size", "target", "_quota", "_block", "_blocks", "_want", "_slots", "_lo", "_hi")
    )


def slot_schedule(targets: DataFrame, chunk: int = 1 << 12) -> DataFrame:
    """The schedule: ``slot, _src, rank, _first, _words``: which words of the source's repeated stream a slot takes."""
    chunks = (
        targets.agg(F.max("_slots").alias("_n"))
        .where("_n > 0")
        .select("_n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {chunk}"))).alias("_chunk"))
        # A slot's place is known from its number alone, so the chunks are dealt out before they are unfolded.  The number of
        # tasks is given, as adaptive execution would merge these few rows into one task that unfolds all slots.
        .repartition(shuffle_partitions(targets.sparkSession), "_chunk")
    )
    points = chunks.select("_chunk", F.explode(F.expr(f"sequence(_chunk * {chunk}, least(_n, (_chunk + 1) * {chunk}) - 1)")).alias("slot"))
    points = points.withColumn("_point", F.pmod(F.pmod(F.col("slot"), F.lit(1 << 32)) * F.lit(GOLDEN_32), F.lit(1 << 32)) / F.lit(float(1 << 32)))
    # Ranges are cut at the bounds of equal bins, so a point meets by equality the few ranges of its bin.
    facts = ["_src", "source_size", "_quota", "_block", "_blocks", "_want", "_slots"]
    ranges = targets.where("_want > 0").select(*facts, "_lo", "_hi", F.explode(F.expr(f"sequence(cast(floor(_lo * {BINS}) as int), least(cast(floor(_hi * {BINS}) as int), {BINS - 1}))")).alias("_bin"))
    points = points.withColumn("_pbin", F.floor(F.col("_point") * BINS).cast("int"))
    # The planner cannot know how many points there are: by hint, they are never broadcast.
    placed = points.hint("merge").join(ranges, (F.col("_pbin") == F.col("_bin")) & (F.col("_point") >= F.col("_lo")) & (F.col("_point") < F.col("_hi")))
    ranked = with_prefix_sum(placed.select("slot", "_chunk", *facts), F.lit(1), ["_src"], "_chunk", ["slot"], "rank")
    got = placed.groupBy("_src").agg(F.count(F.lit(1)).alias("_got"))
    tail = (
        targets.join(got, "_src", "left")
        .withColumn("_got", F.coalesce("_got", F.lit(0)))
        .where("_got < _want")
        .select(*facts, F.explode(F.expr("sequence(_got, _want - 1)")).alias("rank"))
        .select((F.col("_slots") + F.col("rank")).alias("slot"), "rank", *facts)
    )
    used = ranked.select("slot", "rank", *facts).unionByName(tail).where("rank < _want")
    block = F.pmod(F.col("rank"), F.col("_blocks"))
    first = F.expr("(rank div _blocks)") * F.col("source_size") + block * F.col("_block")
    end = F.least(first + F.col("_block"), F.expr("(rank div _blocks) + 1") * F.col("source_size"), F.col("_quota"))
    return used.select("slot", "_src", "rank", block.alias("_k"), first.alias("_first"), (end - first).alias("_words"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_repeat: float = 2,
    block: int = 1024,
    min_blocks: int = 1024,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Words that the mix takes of every document: ``id_col, size, source_size, target, taken``.

    Sources by code point (null last) weigh ``weights``, repeating, and share ``share`` of all words; a
    target stops at ``max_repeat`` times its source and the excess is reshared by weight.  A document
    without words (null or empty text) takes 0.  A null id is shuffled like any other; repeated rows are separate
    documents.  If no document has words all targets are 0; an empty table gives an empty result.  Other
    columns are not read.  The result depends on ids, sources and sizes only, never on partitioning.
    """
    # Narrow rows, stored: words are counted once, and all that follows reads the counts.
    sized = stored(sized_documents(docs, id_col, text_col, source_col, seed))
    targets = stored(source_targets(sized, weights, share, max_repeat, block, min_blocks))
    placed = with_prefix_sum(sized, F.col("_size"), ["_src"], "_bucket", ["_order", "_id", "_size"], "_start")
    within = Window.partitionBy("_src", "_bucket").orderBy("_order", "_id", "_size")
    placed = placed.withColumn("_row", F.row_number().over(within)).join(targets, "_src")
    ks = F.when(F.col("_size") > 0, F.expr("sequence(_start div _block, (_start + _size - 1) div _block)"))
    pieces = placed.select("_src", "_bucket", "_row", "_id", "_size", "source_size", "target", "_start", "_block", F.explode_outer(ks).alias("_k"))
    # A block's slots, as words from its first word on: whole takes and, for the last slot of a source, a cut one.
    takes = slot_schedule(targets).groupBy("_src", F.col("_k").alias("_sk")).agg(F.collect_list("_words").alias("_takes"))
    takes = takes.select(F.col("_src").alias("_ssrc"), "_sk", "_takes")
    met = pieces.join(takes.hint("merge"), (F.col("_src") == F.col("_ssrc")) & (F.col("_k") == F.col("_sk")), "left")
    at = F.greatest(F.col("_start") - F.col("_k") * F.col("_block"), F.lit(0))
    to = F.least(F.col("_start") + F.col("_size") - F.col("_k") * F.col("_block"), F.col("_block"))
    words = F.aggregate(F.coalesce("_takes", F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda s, t: s + F.greatest(F.least(t, to) - at, F.lit(0)))
    return (
        met.withColumn("_words", F.coalesce(words, F.lit(0)))
        .groupBy("_src", "_bucket", "_row", "_id", "_size", "source_size", "target")
        .agg(F.sum("_words").alias("taken"))
        .select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", "taken")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as documents: each row of ``docs`` as often as it is taken, with all its columns.

    Whole takes repeat the row; a last, partial take has the first words of the text only, joined by single spaces, and
    keeps the other columns as they are.  Documents that the mix does not take, or that have no words, are left out.  Rows that share
    an id are taken together: each of them as often as the id's words were taken on average.
    """
    taken = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    taken = taken.where("taken > 0").groupBy(F.col(id_col).alias("_tid")).agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    # The row travels as one column, so its names cannot clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_rid"), F.col(text_col).alias("_text"))
    met = rows.join(taken, F.col("_rid").eqNullSafe(F.col("_tid"))).withColumn("_words", F.coalesce(F.regexp_count("_text", F.lit(WORD)), F.lit(0)))
    # Words of this row that are taken in all; equal to _taken where ids are unique.
    share = F.when(F.col("_words") == F.col("_size"), F.col("_taken")).otherwise(F.floor(F.col("_words") * F.col("_taken") / F.col("_size")))
    met = met.withColumn("_share", share).where("_words > 0 and _share > 0")
    met = met.withColumn("_copy", F.explode(F.expr("sequence(0L, (_share - 1) div _words)")))
    left = F.least(F.col("_share") - F.col("_copy") * F.col("_words"), F.col("_words"))
    part = F.array_join(F.slice(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int")), " ")
    text = F.when(left == F.col("_words"), F.col("_text")).otherwise(part)
    return met.select(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
