"""Queries over ``documents`` as a corpus (crawl := source, id := doc_id), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import scalar
from corpusloom.operators import corpus, samples
from corpusloom.session import stored, table
from corpusloom.sources import documents as sources

CHUNK, SEQ, EOS_MARK = 4096, 512, "@"
EOS = scalar.BYTE_SHIFT + ord(EOS_MARK)
DOMAIN, FRACTION, BUDGET = "validation", 0.05, 1_000_000
CHUNK_SAMPLES = CHUNK // SEQ
SEED = 7


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the corpus, normalised (a null text is empty); the unit is a hundred ids."""
    docs = table(spark, d, "documents").select(
        F.coalesce("source", F.lit("")).alias("crawl"), F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.format_string("unit-%05d", F.expr("doc_id div 100")).alias("unit_id")
    )
    return corpus.apply_transforms(docs, [("whitespace_normalize", 1)])


def keyed(spark: SparkSession, d: str) -> DataFrame:
    """Narrow rows: key, framed length (byte tokens, BOS and EOS), reservation and role."""
    rows = corpus.doc_key(documents(spark, d))
    rows = rows.withColumns({"n_tokens": (F.octet_length("text") + 2).cast("long"), "has_eos": F.col("text").contains(EOS_MARK)})
    rows = corpus.route_roles(corpus.with_validation(rows, DOMAIN, FRACTION), ["train", "validation"])
    # Narrow rows, stored: texts are read, normalised and hashed once, whatever is made of them.
    return stored(rows.select("unit_id", "crawl", "doc_id", "key", "n_tokens", "has_eos", "is_validation", "role"))


def train_stream(spark: SparkSession, d: str) -> DataFrame:
    return corpus.stream_offsets(keyed(spark, d).where("role = 'train' and not has_eos").select("doc_id", "key", "n_tokens"))


SPACE_SQL = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
DOCS_SQL = f"""docs AS (
  SELECT coalesce(source, '') AS crawl, doc_id, trim(regexp_replace(coalesce(text, ''), '{SPACE_SQL}', ' ', 'g'), ' ') AS text,
         printf('unit-%05d', doc_id // 100) AS unit_id
  FROM documents
)"""
KEYED_SQL = f"""{DOCS_SQL}, k0 AS (
  SELECT unit_id, crawl, doc_id, substr(sha256(crawl || chr(0) || doc_id::VARCHAR), 1, 32) AS key,
         (octet_length(encode(text)) + 2)::BIGINT AS n_tokens, contains(text, '{EOS_MARK}') AS has_eos
  FROM docs
), keyed AS (
  SELECT *, substr(sha256('{DOMAIN}' || chr(0) || key), 1, 16) < '{scalar.share_threshold(FRACTION, 16)}' AS is_validation,
         CASE WHEN is_validation THEN 'validation' ELSE 'train' END AS role
  FROM k0
)"""
STREAM_SQL = f"""{KEYED_SQL}, stream AS (
  SELECT doc_id, key, n_tokens,
         (sum(n_tokens) OVER (ORDER BY key) - n_tokens)::BIGINT AS start_pos, (sum(n_tokens) OVER ())::BIGINT AS stream_tokens
  FROM keyed WHERE role = 'train' AND NOT has_eos
)"""
PIECES_SQL = f"""{STREAM_SQL}, ids AS (
  SELECT *, unnest(range(CASE WHEN start_pos % {CHUNK} = 0 AND start_pos > 0 THEN start_pos // {CHUNK} - 1 ELSE start_pos // {CHUNK} END,
                         (start_pos + n_tokens - 1) // {CHUNK} + 1)) AS chunk_id
  FROM stream
), pieces AS (
  SELECT chunk_id, doc_id, greatest(start_pos, chunk_id * {CHUNK}) - chunk_id * {CHUNK} AS pos,
         greatest(start_pos, chunk_id * {CHUNK}) - start_pos AS from_doc,
         least(start_pos + n_tokens, (chunk_id + 1) * {CHUNK} + 1) - greatest(start_pos, chunk_id * {CHUNK}) AS n_piece
  FROM ids
), chunks AS (
  SELECT chunk_id, count(*) AS pieces, sum(n_piece)::BIGINT AS tokens FROM pieces GROUP BY chunk_id
)"""
LAYOUT_SQL = f"""{PIECES_SQL}, layout AS (
  SELECT chunk_id, (tokens - 1) // {SEQ} AS samples, (sum((tokens - 1) // {SEQ}) OVER (ORDER BY chunk_id))::BIGINT AS cumulative FROM chunks
)"""
PERM_SQL = f"""{LAYOUT_SQL}, js AS (SELECT chunk_id, unnest(range(samples)) AS j FROM layout WHERE samples > 0
), perm AS (
  SELECT chunk_id, j, row_number() OVER (PARTITION BY chunk_id ORDER BY sha256('{SEED}:@epoch:' || chunk_id || ':' || j)) - 1 AS local FROM js
)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return corpus.chunk_counts(corpus.cut_chunks(train_stream(spark, d), CHUNK))


def q_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d)


def q_documents(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("crawl", "doc_id", "unit_id", F.sha2("text", 256).alias("text_sha256"))


def q_doc_keys(spark: SparkSession, d: str) -> DataFrame:
    return keyed(spark, d)


def q_unit_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus.unit_stats(keyed(spark, d))


def q_role_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus.role_stats(keyed(spark, d).where("not has_eos"), totals=True)


def q_eos_drop_rate(spark: SparkSession, d: str) -> DataFrame:
    return corpus.eos_drop_violations(corpus.unit_stats(keyed(spark, d)), 0.005).select("unit_id", "seen", "dropped_eos")


def q_tranche(spark: SparkSession, d: str) -> DataFrame:
    return corpus.tranche(keyed(spark, d), 0.25).select("doc_id", "key", "n_tokens")


def q_stream_offsets(spark: SparkSession, d: str) -> DataFrame:
    return train_stream(spark, d)


def q_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return corpus.token_budget(train_stream(spark, d), BUDGET).select("doc_id", "start_pos", "n_tokens")


def q_cut_chunks(spark: SparkSession, d: str) -> DataFrame:
    return corpus.cut_chunks(train_stream(spark, d), CHUNK).select("chunk_id", "doc_id", "pos", "from_doc", "n_piece")


def q_sample_windows(spark: SparkSession, d: str) -> DataFrame:
    return samples.sample_pieces(train_stream(spark, d), SEQ).select("g", "doc_id", "pos", "from_doc", "n_piece")


def q_chunk_layout(spark: SparkSession, d: str) -> DataFrame:
    return samples.chunk_layout(chunks(spark, d), SEQ)


def q_permutation(spark: SparkSession, d: str) -> DataFrame:
    return samples.permutation_by_hash(samples.chunk_layout(chunks(spark, d), SEQ), SEED, 0)


def total_of(layout: DataFrame) -> DataFrame:
    return layout.agg(F.max("cumulative").alias("total"))


def q_read_strided(spark: SparkSession, d: str) -> DataFrame:
    """Every sample of the first epoch's second stream of three, in order."""
    layout = samples.chunk_layout(chunks(spark, d), SEQ)
    total = layout.agg(F.max("cumulative")).first()[0] or 0
    ids = samples.range_ids(spark, 1, max(0, -(-(total - 1) // 3)), 3)
    placed = samples.locate(ids, F.lit(max(1, total)), CHUNK_SAMPLES)
    met = placed.join(samples.permutation_by_hash(layout, SEED, 0), ["chunk_id", "local"])
    return met.select("sample_id", "epoch", "chunk_id", "local", "j", (F.col("chunk_id") * CHUNK_SAMPLES + F.col("j")).alias("g"))


def q_read_range(spark: SparkSession, d: str) -> DataFrame:
    """All of the second epoch."""
    layout = samples.chunk_layout(chunks(spark, d), SEQ)
    total = layout.agg(F.max("cumulative")).first()[0] or 0
    placed = samples.locate(samples.range_ids(spark, total, total), F.lit(max(1, total)), CHUNK_SAMPLES)
    return placed.join(samples.permutation_by_hash(layout, SEED, 1), ["chunk_id", "local"]).select("sample_id", "epoch", "chunk_id", "j")


def q_stream_batches(spark: SparkSession, d: str) -> DataFrame:
    total = samples.chunk_layout(chunks(spark, d), SEQ).agg(F.max("cumulative")).first()[0] or 0
    return samples.stream_batches(spark, 1, 4, 8, -(-total // 32), total)


def q_shard_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Two epochs of the batches of each shard."""
    layout = samples.chunk_layout(chunks(spark, d), SEQ)
    shards = layout.groupBy(F.expr("chunk_id div 2").alias("shard")).agg(F.count(F.lit(1)).alias("n")).drop("n")
    total = layout.agg(F.max("cumulative")).first()[0] or 0
    return samples.shard_epochs(F.lit(total), shards, 2, CHUNK_SAMPLES, 6, 2)


def q_shard_batches(spark: SparkSession, d: str) -> DataFrame:
    layout = samples.chunk_layout(chunks(spark, d), SEQ)
    shards = layout.groupBy(F.expr("chunk_id div 2").alias("shard")).agg(F.count(F.lit(1)).alias("n")).drop("n")
    total = layout.agg(F.max("cumulative")).first()[0] or 0
    return samples.shard_batches(F.lit(total), shards, 2, CHUNK_SAMPLES, 6)


def q_locate_range(spark: SparkSession, d: str) -> DataFrame:
    layout = samples.chunk_layout(chunks(spark, d), SEQ)
    starts = samples.sample_pieces(train_stream(spark, d), SEQ).select(F.col("g").alias("pos")).distinct()
    return samples.locate_range(starts, layout)


def q_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Texts standing for keys: repeats within the whole table."""
    return corpus.duplicate_keys(documents(spark, d).select(F.sha2("text", 256).alias("key")))


def q_select_items(spark: SparkSession, d: str) -> DataFrame:
    """Objects named after crawl and unit, chosen by globs."""
    names = documents(spark, d).select(F.concat_ws("/", F.lit("data"), "crawl", F.concat("unit_id", F.lit(".parquet"))).alias("name")).distinct()
    return corpus.select_items(names, ["data/**/*.parquet", "src?/*"], ["data/src1*/**", "**/unit-0000[.]parquet"])


def q_with_crawl(spark: SparkSession, d: str) -> DataFrame:
    host = F.concat_ws("/", F.split_part("url", F.lit("/"), F.lit(3)), F.concat(F.lit("CC-MAIN-"), F.expr("page_id % 7")), F.concat("page_id", F.lit(".html")))
    return corpus.with_crawl(table(spark, d, "pages").select("page_id", F.when(F.expr("page_id % 3 = 0"), host).otherwise(F.split_part("url", F.lit("/"), F.lit(3))).alias("path")))


def markers(spark: SparkSession, d: str) -> DataFrame:
    return corpus.unit_stats(keyed(spark, d))


def units(spark: SparkSession, d: str) -> DataFrame:
    return keyed(spark, d).groupBy("unit_id").agg(F.count(F.lit(1)).alias("rows"), F.min("crawl").alias("crawl"), F.substring(F.sha2(F.min("key"), 256), 1, 8).alias("pin"))


def q_pending_units(spark: SparkSession, d: str) -> DataFrame:
    """Units whose marker is missing: those whose pin starts with a letter stand for finished ones."""
    u = units(spark, d)
    return corpus.pending_units(u, u.where("pin rlike '^[a-f]'"), ["pin"]).select("unit_id", "pin")


def q_marker_mismatches(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    other = u.select("unit_id", F.when(F.col("pin").rlike("^[0-7]"), F.lit("stale")).otherwise(F.col("pin")).alias("pin"))
    return corpus.marker_mismatches(u, other, ["pin"]).select("unit_id", "pin", "marker_pin")


def q_reconcile_units(spark: SparkSession, d: str) -> DataFrame:
    """Units whose parts lost the validation role do not add up."""
    parts = corpus.role_stats(keyed(spark, d).where("not has_eos and role = 'train'"))
    m = markers(spark, d).join(units(spark, d).select("unit_id", "rows"), "unit_id")
    return corpus.reconcile_units(m, parts).select("unit_id", "seen", "selected", "part_docs", "part_tokens", "tokens")


def q_reconcile_crawls(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d).withColumn("rows", F.when(F.col("pin").rlike("^[0-3]"), F.col("rows") + 1).when(F.col("pin").rlike("^[4-9]"), F.col("rows")))
    return corpus.reconcile_crawls(u, markers(spark, d))


def q_split_leak(spark: SparkSession, d: str) -> DataFrame:
    """Roles given with a larger reservation leak against the agreed one."""
    wide = corpus.route_roles(corpus.with_validation(keyed(spark, d), DOMAIN, 0.1), ["train", "validation"])
    return corpus.split_leak(wide, DOMAIN, FRACTION).select("doc_id", "key", "role", "is_validation")


def q_inventory_drift(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.octet_length("text").alias("size"))
    locked = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("name"), F.col("doc_id").cast("int").alias("size"))
    return corpus.inventory_drift(live, locked)


def q_overlap_breaks(spark: SparkSession, d: str) -> DataFrame:
    pieces = corpus.cut_chunks(train_stream(spark, d), CHUNK)
    ends = pieces.groupBy("chunk_id").agg(F.min_by("doc_id", "pos").alias("first_token"), F.max_by("doc_id", "pos").alias("last_token"))
    return corpus.overlap_breaks(ends.withColumnRenamed("chunk_id", "ordinal"))


def q_overlap_breaks_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as objects in the order of their ids, their ends as tokens; unlike chunks they do not overlap."""
    texts = table(spark, d, "documents").where("length(text) > 0")
    return corpus.overlap_breaks(texts.select(F.col("doc_id").alias("ordinal"), F.left("text", F.lit(1)).alias("first_token"), F.right("text", F.lit(1)).alias("last_token")))


def q_membership_diff(spark: SparkSession, d: str) -> DataFrame:
    return corpus.membership_diff(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


def q_same_set(spark: SparkSession, d: str) -> DataFrame:
    return corpus.set_difference(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"))


def q_disjoint(spark: SparkSession, d: str) -> DataFrame:
    rows = keyed(spark, d)
    return corpus.intersection(rows.where("role = 'train'").select("crawl"), rows.where("role = 'validation'").select("crawl"), "crawl")


def q_framed_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Byte tokens, framed, in range, without documents that hold EOS: length, ends and inputs/labels per document."""
    rows = corpus.tokenize_bytes(documents(spark, d).select("doc_id", "text"), digest="sha256").withColumn("plain", F.col("tokens"))
    rows = corpus.frame_tokens(corpus.assert_token_range(corpus.drop_docs_with_eos(rows, EOS), scalar.BYTE_CAP), scalar.BYTE_BOS, scalar.BYTE_EOS)
    pair = scalar.shift_labels(F.col("tokens"))
    # The digest was taken with the tokens; it stands only where the framed ones, without the frame, are still the same.
    digest = F.when(F.slice("tokens", F.lit(2), F.size("tokens") - 2) == F.col("plain"), F.col("sha256"))
    return rows.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.get("tokens", F.lit(0)).alias("first"), F.element_at("tokens", -1).alias("last"), F.size(pair["inputs"]).cast("long").alias("n_inputs"), F.element_at(pair["labels"], -1).cast("long").alias("last_label"), digest.alias("tokens_sha256"))


def q_global_order(spark: SparkSession, d: str) -> DataFrame:
    """The shuffle is the ascending key: no document is out of order."""
    rows = keyed(spark, d).select("key", F.lit(1).alias("n"))
    ranked = corpus.stream_offsets(rows, "n").withColumnRenamed("start_pos", "position")
    return ranked.select("key", "position")


def q_assign_units(spark: SparkSession, d: str) -> DataFrame:
    return corpus.assign_units(units(spark, d), 3).select("unit_id", "worker")


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of two roles as one table."""
    rows = keyed(spark, d).where("not has_eos").select("unit_id", "doc_id", "key", "n_tokens", "role")
    return corpus.union_parts([rows.where(F.col("role") == r) for r in ("train", "validation")])


def q_union_parts(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d)


def q_reconcile_output(spark: SparkSession, d: str) -> DataFrame:
    """Output that lost its documents of even ids does not add up to the parts."""
    whole = corpus.role_stats(parts(spark, d))
    written = parts(spark, d).where("doc_id % 2 = 1").groupBy("role").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    return corpus.reconcile_output(written, whole).select("role", "written_docs", "written_tokens", "docs", "tokens")


def q_order_violations(spark: SparkSession, d: str) -> DataFrame:
    """Within a unit, documents in the order of ids are out of key order where a key is not larger than the one before."""
    rows = keyed(spark, d).withColumn("position", F.col("doc_id"))
    return corpus.order_violations(rows, "key", ("unit_id",)).select("doc_id", "key", "previous_key")


def q_unique_names(spark: SparkSession, d: str) -> DataFrame:
    return sources.unique_names(documents(spark, d).select(F.col("crawl").alias("name")))


def q_chunk_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Of the chunks, those divisible by 5 are too long, those by 7 have another digest, those by 11 are missing."""
    c = chunks(spark, d).withColumn("name", F.concat(F.lit("chunk-"), "chunk_id"))
    manifest = c.select("name", "tokens", F.sha2("name", 256).alias("sha256"))
    digest = F.sha2(F.when(F.col("chunk_id") % 7 == 0, F.lit("x")).otherwise(F.col("name")), 256)
    found = c.where("chunk_id % 11 > 0").select("name", (4 * F.col("tokens") + F.when(F.col("chunk_id") % 5 == 0, 4).otherwise(0)).alias("size"), digest.alias("sha256"))
    return corpus.chunk_integrity(found, manifest).select("name", "found_size", "tokens")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d)


QUERIES = {n[2:]: f for n, f in globals().items() if n.startswith("q_")}

ORACLE_SQL = {
    "chunk_counts": f"WITH {PIECES_SQL} SELECT chunk_id, pieces, tokens FROM chunks",
    "documents": f"WITH {DOCS_SQL} SELECT crawl, doc_id, unit_id, sha256(text) AS text_sha256 FROM docs",
    "doc_keys": f"WITH {KEYED_SQL} SELECT * FROM keyed",
    "unit_stats": f"""WITH {KEYED_SQL} SELECT unit_id, count(*) AS seen, count(*) FILTER (NOT has_eos) AS selected, count(*) FILTER (has_eos) AS dropped_eos,
        count(*) FILTER (NOT has_eos AND is_validation) AS validation, coalesce(sum(n_tokens) FILTER (NOT has_eos), 0)::BIGINT AS tokens FROM keyed GROUP BY unit_id""",
    "role_stats": f"WITH {KEYED_SQL} SELECT unit_id, role, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens FROM keyed WHERE NOT has_eos GROUP BY ROLLUP (unit_id, role)",
    "eos_drop_rate": f"WITH {KEYED_SQL} SELECT unit_id, count(*) AS seen, count(*) FILTER (has_eos) AS dropped_eos FROM keyed GROUP BY unit_id HAVING count(*) FILTER (has_eos) > 0.005 * count(*)",
    "tranche": f"WITH {KEYED_SQL} SELECT doc_id, key, n_tokens FROM keyed WHERE key < '{scalar.share_threshold(0.25, 32)}'",
    "stream_offsets": f"WITH {STREAM_SQL} SELECT * FROM stream",
    "token_budget": f"WITH {STREAM_SQL} SELECT doc_id, start_pos, least(n_tokens, {BUDGET} - start_pos) AS n_tokens FROM stream WHERE start_pos < {BUDGET}",
    "cut_chunks": f"WITH {PIECES_SQL} SELECT * FROM pieces",
    "sample_windows": f"""WITH {STREAM_SQL}, ids AS (
        SELECT *, unnest(range(CASE WHEN start_pos % {SEQ} = 0 AND start_pos > 0 THEN start_pos // {SEQ} - 1 ELSE start_pos // {SEQ} END, (start_pos + n_tokens - 1) // {SEQ} + 1)) AS g FROM stream)
        SELECT g, doc_id, greatest(start_pos, g * {SEQ}) - g * {SEQ} AS pos, greatest(start_pos, g * {SEQ}) - start_pos AS from_doc,
        least(start_pos + n_tokens, g * {SEQ} + {SEQ} + 1) - greatest(start_pos, g * {SEQ}) AS n_piece FROM ids WHERE (g + 1) * {SEQ} <= stream_tokens - 1""",
    "chunk_layout": f"WITH {LAYOUT_SQL} SELECT * FROM layout",
    "permutation": f"WITH {PERM_SQL.replace('@epoch', '0')} SELECT chunk_id, local, j FROM perm",
    "read_strided": f"""WITH {PERM_SQL.replace('@epoch', '0')}, t AS (SELECT max(cumulative) AS total FROM layout), rids AS (SELECT unnest(range(1, total, 3)) AS sample_id FROM t)
        SELECT sample_id, 0::BIGINT AS epoch, chunk_id, local, j, chunk_id * {CHUNK_SAMPLES} + j AS g FROM rids JOIN perm ON chunk_id = sample_id // {CHUNK_SAMPLES} AND local = sample_id % {CHUNK_SAMPLES}""",
    "read_range": f"""WITH {PERM_SQL.replace('@epoch', '1')}, t AS (SELECT max(cumulative) AS total FROM layout), rids AS (SELECT total, unnest(range(total)) AS p FROM t)
        SELECT total + p AS sample_id, 1::BIGINT AS epoch, chunk_id, j FROM rids JOIN perm ON chunk_id = p // {CHUNK_SAMPLES} AND local = p % {CHUNK_SAMPLES}""",
    "stream_batches": f"""WITH {LAYOUT_SQL}, t AS (SELECT max(cumulative) AS total FROM layout), wanted AS (SELECT unnest(range(1, total, 4)) AS sample_id FROM t)
        SELECT sample_id // 32 AS batch_no, sample_id % 32 // 4 AS row_no, sample_id FROM wanted""",
    "shard_epochs": f"""WITH {LAYOUT_SQL}, t AS (SELECT max(cumulative) AS total FROM layout), s AS (SELECT DISTINCT chunk_id // 2 AS shard FROM layout),
        r AS (SELECT shard, total, shard * {2 * CHUNK_SAMPLES} AS low, least((shard + 1) * {2 * CHUNK_SAMPLES}, total) AS high FROM s, t),
        b AS (SELECT *, unnest(range((high - low - 1) // 6 + 1)) AS n FROM r WHERE high > low), e AS (SELECT *, unnest(range(2)) AS epoch FROM b)
        SELECT shard, epoch, row_number() OVER (PARTITION BY shard ORDER BY epoch, n) - 1 AS turn, epoch * total + low + n * 6 AS first_sample, epoch * total + least(low + n * 6 + 6, high) AS end_sample FROM e""",
    "shard_batches": f"""WITH {LAYOUT_SQL}, t AS (SELECT max(cumulative) AS total FROM layout), s AS (SELECT DISTINCT chunk_id // 2 AS shard FROM layout),
        r AS (SELECT shard, shard * {2 * CHUNK_SAMPLES} AS low, least((shard + 1) * {2 * CHUNK_SAMPLES}, total) AS high FROM s, t),
        b AS (SELECT *, unnest(range((high - low - 1) // 6 + 1)) AS batch_no FROM r WHERE high > low)
        SELECT shard, batch_no, low + batch_no * 6 AS first_sample, least(low + batch_no * 6 + 6, high) AS end_sample FROM b""",
    "locate_range": f"""WITH {LAYOUT_SQL}, g AS (SELECT unnest(range(max(cumulative))) AS pos FROM layout)
        SELECT pos, min(chunk_id) AS chunk_id FROM g JOIN layout ON cumulative > pos GROUP BY pos""",
    "duplicate_keys": f"WITH {DOCS_SQL} SELECT sha256(text) AS key, count(*) AS times FROM docs GROUP BY 1 HAVING count(*) > 1",
    "select_items": f"""WITH {DOCS_SQL} SELECT DISTINCT 'data/' || crawl || '/' || unit_id || '.parquet' AS name FROM docs
        WHERE NOT regexp_full_match('data/' || crawl || '/' || unit_id || '.parquet', 'data/src1[^/]*/.*')""",
    "with_crawl": """SELECT page_id, path, CASE WHEN page_id % 3 = 0 THEN 'CC-MAIN-' || page_id % 7 ELSE regexp_replace(path, '\\.[^.]*$', '') END AS crawl FROM (
        SELECT page_id, CASE WHEN page_id % 3 = 0 THEN split_part(url, '/', 3) || '/CC-MAIN-' || page_id % 7 || '/' || page_id || '.html' ELSE split_part(url, '/', 3) END AS path FROM pages)""",
    "pending_units": f"""WITH {KEYED_SQL}, u AS (SELECT unit_id, substr(sha256(min(key)), 1, 8) AS pin FROM keyed GROUP BY unit_id) SELECT unit_id, pin FROM u WHERE NOT regexp_matches(pin, '^[a-f]')""",
    "marker_mismatches": f"""WITH {KEYED_SQL}, u AS (SELECT unit_id, substr(sha256(min(key)), 1, 8) AS pin FROM keyed GROUP BY unit_id) SELECT unit_id, pin, 'stale' AS marker_pin FROM u WHERE pin < '8'""",
    "reconcile_units": f"""WITH {KEYED_SQL}, m AS (SELECT unit_id, count(*) AS seen, count(*) FILTER (NOT has_eos) AS selected, coalesce(sum(n_tokens) FILTER (NOT has_eos), 0)::BIGINT AS tokens,
        count(*) FILTER (NOT has_eos AND role = 'train') AS part_docs, coalesce(sum(n_tokens) FILTER (NOT has_eos AND role = 'train'), 0)::BIGINT AS part_tokens FROM keyed GROUP BY unit_id)
        SELECT unit_id, seen, selected, part_docs, part_tokens, tokens FROM m WHERE part_docs <> selected OR part_tokens <> tokens""",
    "reconcile_crawls": f"""WITH {KEYED_SQL}, u AS (SELECT unit_id, count(*) AS seen, min(crawl) AS crawl, substr(sha256(min(key)), 1, 8) AS pin FROM keyed GROUP BY unit_id)
        SELECT crawl, sum(seen)::BIGINT AS seen, sum(seen + CASE WHEN pin < '4' THEN 1 ELSE 0 END)::BIGINT AS declared FROM u WHERE pin < 'a' GROUP BY crawl HAVING count(*) FILTER (pin < '4') > 0""",
    "split_leak": f"""WITH {KEYED_SQL} SELECT doc_id, key, 'validation' AS role, is_validation FROM keyed WHERE NOT is_validation AND substr(sha256('{DOMAIN}' || chr(0) || key), 1, 16) < '{scalar.share_threshold(0.1, 16)}'""",
    "inventory_drift": """SELECT coalesce(d.doc_id, l.doc_id)::VARCHAR AS name, octet_length(encode(text))::INT AS live_size, l.doc_id::INT AS locked_size
        FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE octet_length(encode(text)) IS DISTINCT FROM l.doc_id""",
    "overlap_breaks": f"""WITH {PIECES_SQL}, e AS (SELECT chunk_id AS ordinal, arg_min(doc_id, pos) AS first_token, arg_max(doc_id, pos) AS last_token FROM pieces GROUP BY chunk_id)
        SELECT a.ordinal, a.first_token, a.last_token, b.first_token AS next_first FROM e a JOIN e b ON b.ordinal = a.ordinal + 1 WHERE a.last_token <> b.first_token""",
    "overlap_breaks_texts": """WITH e AS (SELECT doc_id AS ordinal, left(text, 1) AS first_token, right(text, 1) AS last_token FROM documents WHERE length(text) > 0)
        SELECT a.ordinal, a.first_token, a.last_token, b.first_token AS next_first FROM e a JOIN e b ON b.ordinal = a.ordinal + 1 WHERE a.last_token <> b.first_token""",
    "membership_diff": """SELECT DISTINCT doc_id, 'evict' AS action FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'refresh' FROM labels""",
    "same_set": """(SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)) UNION ALL (SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents))""",
    "disjoint": f"WITH {KEYED_SQL} SELECT crawl FROM keyed WHERE role = 'train' INTERSECT SELECT crawl FROM keyed WHERE role = 'validation'",
    "framed_tokens": f"""WITH {DOCS_SQL} SELECT doc_id, (octet_length(encode(text)) + 2)::BIGINT AS n_tokens, 1 AS "first", 2 AS "last", (octet_length(encode(text)) + 1)::BIGINT AS n_inputs, 2::BIGINT AS last_label, sha256(hex(encode(text))) AS tokens_sha256 FROM docs WHERE NOT contains(text, '{EOS_MARK}')""",
    "global_order": f"WITH {KEYED_SQL} SELECT key, row_number() OVER (ORDER BY key) - 1 AS position FROM keyed",
    "assign_units": f"WITH {KEYED_SQL} SELECT DISTINCT unit_id, (regexp_extract(unit_id, '[0-9]+$')::BIGINT % 3)::INT AS worker FROM keyed",
    "union_parts": f"WITH {KEYED_SQL} SELECT unit_id, doc_id, key, n_tokens, role FROM keyed WHERE NOT has_eos",
    "reconcile_output": f"""WITH {KEYED_SQL} SELECT role, count(*) FILTER (doc_id % 2 = 1) AS written_docs, (sum(n_tokens) FILTER (doc_id % 2 = 1))::BIGINT AS written_tokens, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens
        FROM keyed WHERE NOT has_eos GROUP BY role HAVING written_docs <> docs OR written_tokens <> tokens""",
    "order_violations": f"WITH {KEYED_SQL} SELECT doc_id, key, lag(key) OVER (PARTITION BY unit_id ORDER BY doc_id) AS previous_key FROM keyed QUALIFY previous_key >= key",
    "unique_names": f"WITH {DOCS_SQL} SELECT crawl AS name, count(*) AS times FROM docs GROUP BY crawl HAVING count(*) > 1",
    "chunk_integrity": f"""WITH {PIECES_SQL} SELECT 'chunk-' || chunk_id AS name, CASE WHEN chunk_id % 11 > 0 THEN 4 * tokens + CASE WHEN chunk_id % 5 = 0 THEN 4 ELSE 0 END END AS found_size, tokens
        FROM chunks WHERE chunk_id % 5 = 0 OR chunk_id % 7 = 0 OR chunk_id % 11 = 0""",
}
