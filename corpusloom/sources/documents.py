"""Document and object scans, and their evidence."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import scalar
from corpusloom.plans.ranking import with_prefix_sum
from corpusloom.session import dealt

READ = 1 << 20


def _relative(path: Column, root: str) -> Column:
    base = root.rstrip("/").removeprefix("file://")
    return F.regexp_replace(F.regexp_replace(path, r"^file:/+", "/"), "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in base) + "/", "")


def _crawl(parsed: Column, item: Column) -> Column:
    pick = lambda name: F.nullif(F.try_variant_get(parsed, f"$.{name}", "string"), F.lit(""))
    return F.coalesce(pick("crawl"), pick("dump"), scalar.crawl_of(item))


def scan_jsonl_documents(spark: SparkSession, paths: str | Sequence[str], root: str = "") -> DataFrame:
    """``crawl, doc_id, text, item_name`` of JSON lines; blank lines are skipped.

    A line that is not JSON, or whose ``id`` or ``text`` is missing or no string, fails the scan and is shown.
    """
    rows = spark.read.text(paths).select(F.col("value"), F.col("_metadata.file_path").alias("_path")).where(F.trim("value") != "")
    item = _relative(F.col("_path"), root) if root else F.regexp_extract("_path", "[^/]+$", 0)
    parsed = F.try_parse_json("value")
    rows = rows.withColumns({"item_name": item, "_json": parsed})

    def text_of(name: str) -> Column:
        field = F.try_variant_get("_json", f"$.{name}", "variant")
        good = F.coalesce(F.schema_of_variant(field) == "STRING", F.lit(False))
        bad = F.raise_error(F.concat(F.lit(f"no text in {name}: "), "item_name", F.lit(": "), F.substring("value", 1, 200)))
        return F.when(good, F.try_variant_get("_json", f"$.{name}", "string")).otherwise(bad.cast("string"))

    return rows.select(_crawl(F.col("_json"), F.col("item_name")).alias("crawl"), text_of("id").alias("doc_id"), text_of("text").alias("text"), "item_name")


def scan_parquet_documents(spark: SparkSession, paths: str | Sequence[str], root: str = "") -> DataFrame:
    """The same of Parquet files with ``id``, ``text`` and perhaps ``dump``; only these columns are read."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    kinds = dict(df.dtypes)
    missing = [c for c in ("id", "text") if c not in kinds]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    wrong = [c for c in ("id", "text") if kinds[c] != "string"]
    if wrong:
        raise ValueError(f"columns must be strings: {wrong}")
    item = _relative(F.col("_metadata.file_path"), root) if root else F.regexp_extract("_metadata.file_path", "[^/]+$", 0)
    dump = F.nullif(F.col("dump").cast("string"), F.lit("")) if "dump" in kinds else F.lit(None).cast("string")
    needed = lambda c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"null {c}")).cast("string"))
    return df.select(F.coalesce(dump, scalar.crawl_of(item)).alias("crawl"), needed("id").alias("doc_id"), needed("text").alias("text"), item.alias("item_name"))


def scan_documents(spark: SparkSession, paths: Sequence[str], root: str = "") -> DataFrame:
    """Dispatch on ``.jsonl`` and ``.parquet``; anything else is an error."""
    other = [p for p in paths if not p.endswith((".jsonl", ".parquet"))]
    if other or not paths:
        raise ValueError(f"neither .jsonl nor .parquet: {other or 'no paths'}")
    parts = []
    for suffix, scan in ((".jsonl", scan_jsonl_documents), (".parquet", scan_parquet_documents)):
        own = [p for p in paths if p.endswith(suffix)]
        if own:
            parts.append(scan(spark, own, root))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def list_inventory(spark: SparkSession, root: str, suffixes: Sequence[str] = (".jsonl", ".parquet")) -> DataFrame:
    """``name, size, path`` below ``root`` by name; other suffixes are ignored.

    A local name that is a symbolic link, or leads through one, is an error: it may lie outside of the root.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    kept = files.where(F.lower("path").rlike("(" + "|".join("\\" + s for s in suffixes) + ")$"))
    base = root.removeprefix("file://").rstrip("/")

    def contained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist() if base.startswith("/") else ():
                if os.path.realpath(f"{base}/{name}") != f"{os.path.realpath(base)}/{name}":
                    raise ValueError(f"a symbolic link in an inventory: {name}")
            yield batch

    named = kept.select(_relative(F.col("path"), root).alias("name"), "size", "path")
    return named.mapInArrow(contained, "name string, size long, path string").orderBy("name")


def unique_names(inventory: DataFrame) -> DataFrame:
    """Names that occur more than once."""
    return inventory.groupBy("name").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def _open(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file:///") else "file:///" + path[6:].lstrip("/"))
    return store.open_input_file(inner)


def hash_objects(inventory: DataFrame) -> DataFrame:
    """``name, bytes, sha256`` by streaming each object; none is held whole."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest, n = hashlib.sha256(), 0
                with _open(path) as source:
                    while data := source.read(READ):
                        digest.update(data)
                        n += len(data)
                out.append((name, n, digest.hexdigest()))
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["name", "bytes", "sha256"])

    return inventory.select("name", "path").mapInArrow(digests, "name string, bytes long, sha256 string")


def parquet_footer_rows(inventory: DataFrame) -> DataFrame:
    """``name, rows`` from footers only; null for what is not Parquet, an error for a broken footer."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            names, paths = (c.to_pylist() for c in batch.columns)
            rows = []
            for path in paths:
                if path.endswith(".parquet"):
                    with _open(path) as source:
                        rows.append(pq.ParquetFile(source).metadata.num_rows)
                else:
                    rows.append(None)
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(rows, pa.int64())], names=["name", "rows"])

    return inventory.select("name", "path").mapInArrow(footers, "name string, rows long")


def scan_token_objects(spark: SparkSession, inventory: DataFrame, chunk_tokens: int) -> DataFrame:
    """Ordered int32 objects as slices ``ordinal, pos, tokens`` of at most 65536 tokens.

    A size that is no multiple of 4, a non-final object without exactly ``chunk_tokens + 1`` tokens, or a final one with more,
    is an error.  ``inventory`` has ``ordinal, path, size``; the overlap token of all but the last is dropped.
    """
    last = inventory.agg(F.max("ordinal")).first()[0]
    n = F.col("size") / 4
    good = (F.col("size") % 4 == 0) & F.when(F.col("ordinal") == last, n <= chunk_tokens + 1).otherwise(n == chunk_tokens + 1)
    checked = inventory.select("ordinal", F.when(good, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("wrong size: "), "path")).cast("string")).alias("path"), (F.col("ordinal") == last).alias("final"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ordinal, path, final in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pos = 0
                with _open(path) as source:
                    while data := source.read(4 * 65536):
                        tokens = pa.Array.from_buffers(pa.int32(), len(data) // 4, [None, pa.py_buffer(data)])
                        tokens = tokens if final else tokens[: max(0, chunk_tokens - pos)]
                        if len(tokens):
                            yield pa.record_batch([pa.array([ordinal], pa.int64()), pa.array([pos], pa.int64()), pa.array([tokens.to_pylist()], pa.list_(pa.int32()))], names=["ordinal", "pos", "tokens"])
                        pos += len(data) // 4

    return dealt(checked, inventory.count(), 1).mapInArrow(slices, "ordinal long, pos long, tokens array<int>")


def object_ends(inventory: DataFrame) -> DataFrame:
    """``ordinal, first_token, last_token, n`` of int32 objects, by two short reads of each."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ordinal, path, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size % 4 or not size:
                    raise ValueError(f"wrong size: {path}")
                with _open(path) as source:
                    first = source.read(4)
                    source.seek(size - 4)
                    rows.append((ordinal, int.from_bytes(first, "little", signed=True), int.from_bytes(source.read(4), "little", signed=True), size // 4))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["ordinal", "first_token", "last_token", "n"])

    listed = inventory.select(F.col("ordinal").cast("long"), "path", F.col("size").cast("long"))
    return dealt(listed, listed.count()).mapInArrow(ends, "ordinal long, first_token int, last_token int, n long")


def rechunk(slices: DataFrame, old_chunk: int) -> DataFrame:
    """Positions of an ordered legacy stream are arithmetic: slices become documents of a stream that ``cut_chunks`` cuts."""
    start = F.col("ordinal") * old_chunk + F.col("pos")
    return slices.select(start.alias("start_pos"), F.size("tokens").cast("long").alias("n_tokens"), "tokens")


def scan_log_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Log records as ``value``; ``operators.telemetry.parse_lines`` splits them.

    A line that does not begin like a record (a traceback, say) belongs to the record before it in its file, also where the file is
    read in splits; lines before a file's first record stand alone, blank ones between records are left out.  A stream reads each
    file whole, so its files must fit a task's memory.
    """
    from corpusloom.operators.telemetry import HEAD

    if streaming:
        files = spark.readStream.schema("value string").text(path, wholetext=True)
        cuts = F.split("value", r"\r?\n(?=" + HEAD[1:] + ")")
        # What comes before the first record is cut at each line.
        first = F.when(F.get(cuts, F.lit(0)).rlike(HEAD), F.slice(cuts, 1, 1)).otherwise(F.split(F.get(cuts, F.lit(0)), r"\r?\n"))
        lines = files.select(F.explode(F.concat(first, F.slice(cuts, F.lit(2), F.size(cuts)))).alias("value"))
        return lines.select(F.regexp_replace("value", r"[\r\n]+$", "").alias("value")).where(F.trim("value") != "")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"))
    lines = lines.withColumn("_head", F.col("value").rlike(HEAD))
    # Records are numbered by the heads before them: within a split, and split by split.
    numbered = with_prefix_sum(lines, F.col("_head").cast("int"), ["_file"], "_split", ["_at"], "_record")
    record = F.when(F.col("_head"), F.col("_record") + 1).otherwise(F.col("_record"))
    alone = F.when(record == 0, F.struct("_split", "_at"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_split", "_at", "value"))), lambda p: p["value"])
    rows = numbered.withColumns({"_record": record, "_alone": alone}).groupBy("_file", "_record", "_alone").agg(F.regexp_replace(F.array_join(parts, "\n"), r"\n+$", "").alias("value"))
    return rows.select("value").where(F.trim("value") != "")


def scan_socket_stats(spark: SparkSession, path: str) -> DataFrame:
    """Peers of socket dumps: a header line names the peer in its fifth field, the indented line after it has the details.

    A dump file is one row, so lines keep their order; loopback peers are skipped.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\n").alias("lines"))
    rows = files.select("file", "lines", F.posexplode("lines").alias("n", "line")).where(F.col("line").rlike(r"^\s+\S"))
    head = F.regexp_replace(F.trim(F.get("lines", F.col("n") - 1)), r"\s+", " ")
    peer = F.regexp_replace(F.split_part(head, F.lit(" "), F.lit(5)), r":[^:]*$", "")
    number = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit("")).cast("double")
    out = rows.select(
        "file", peer.alias("peer"), number(r"\brtt:([\d.]+)").alias("rtt_ms"), number(r"\bminrtt:([\d.]+)").alias("min_rtt_ms"), F.coalesce(F.regexp_extract("line", r"\bretrans:\d+/(\d+)", 1).try_cast("long"), F.lit(0)).alias("retrans"),
        scalar.rate_to_mbps(F.regexp_extract("line", r"\bdelivery_rate (\S+)", 1)).alias("delivery_mbps"), head.alias("_head"),
    )
    return out.where(~F.col("_head").startswith("State") & (F.col("peer") != "") & ~F.col("peer").rlike(r"^(127\.|\[?::1)")).drop("_head")


def resolve_corpus(name: str, registry: dict[str, dict], uri: str | None = None) -> dict:
    """Registry entry of a corpus; an explicit uri wins, and one that is missing or remote needs a manifest identity."""
    if name not in registry:
        raise KeyError(name)
    entry = dict(registry[name])
    unknown = set(entry) - {"uri", "manifest_identity", "reader", "description"}
    if unknown:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    entry["uri"] = uri or entry.get("uri")
    remote = entry["uri"] is None or ("://" in entry["uri"] and not entry["uri"].startswith("file://"))
    if remote and not entry.get("manifest_identity"):
        raise ValueError(f"{name}: a corpus without a local uri needs a manifest identity")
    return entry


def publish(chunks: DataFrame, present: DataFrame, manifest_present: bool) -> DataFrame:
    """What a publication has to do per chunk: ``skip``, ``copy``; other content under a name is an error.

    If the manifest is there already, all its chunks must be: a dangling publication is an error.
    """
    theirs = present.select("name", F.col("sha256").alias("present_sha256"))
    met = chunks.join(theirs, "name", "left")
    wrong = F.col("present_sha256").isNotNull() & (F.col("present_sha256") != F.col("sha256"))
    dangling = F.lit(manifest_present) & F.col("present_sha256").isNull()
    action = F.when(wrong, F.raise_error(F.concat(F.lit("other content at "), "name")).cast("string")).when(dangling, F.raise_error(F.concat(F.lit("dangling publication: no "), "name")).cast("string"))
    return met.withColumn("action", action.when(F.col("present_sha256").isNotNull(), "skip").otherwise("copy"))


def write_parts(rows: DataFrame, folder: str) -> DataFrame:
    """Parts per ``unit_id`` and ``role``, each file in order of ``key``: ``name, bytes, sha256`` of the files written.

    A unit and role that is written again replaces its own parts and no others; large ones have several files.
    """
    near = rows.hint("rebalance", "unit_id", "role").sortWithinPartitions("unit_id", "role", "key")
    near.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("unit_id", "role").parquet(folder)
    # Values of partition columns are escaped in the names of folders, and such names once more in a URI.
    files = list_inventory(rows.sparkSession, folder, (".parquet",)).withColumn("path", F.expr("replace(replace(path, '%', '%25'), ' ', '%20')"))
    return hash_objects(dealt(files, files.count()))


def publish_chunks(spark: SparkSession, source: str, target: str, manifest: dict) -> dict:
    """Copy a manifest's chunks from one folder to another, and write ``manifest.json`` there last: the commit of it all.

    What lies at the target is hashed: equal chunks are skipped, others are an error, and so are another manifest, or the same with a
    chunk missing.  A copy is hashed as it is read and takes its name when complete and as the manifest says, so a lost task
    leaves no broken chunk.  The receipt tells what is there now and is the same for a repeated publication.
    """
    import json

    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(target)
    store.create_dir(base, recursive=True)
    body = json.dumps(manifest, sort_keys=True).encode()
    committed = store.get_file_info(f"{base}/manifest.json").type != fs.FileType.NotFound
    if committed:
        with store.open_input_stream(f"{base}/manifest.json") as old:
            if old.read() != body:
                raise ValueError("another manifest is published there")
    chunks = spark.createDataFrame([(c["name"], c["sha256"]) for c in manifest["chunks"]], "name string, sha256 string")
    there = list_inventory(spark, target, (".bin",)).join(chunks, "name", "left_semi")
    todo = publish(chunks, hash_objects(dealt(there, len(manifest["chunks"]), 1)), committed).where("action = 'copy'")

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for batch in batches:
            for name, sha in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                to, inner = fs.FileSystem.from_uri(target)
                temp, digest = f"{inner}/.{name}-{TaskContext.get().taskAttemptId()}", hashlib.sha256()
                with _open(os.path.join(source, name)) as chunk, to.open_output_stream(temp) as out:
                    while data := chunk.read(READ):
                        digest.update(data)
                        out.write(data)
                if digest.hexdigest() != sha:
                    to.delete_file(temp)
                    raise ValueError(f"{name} does not match the manifest")
                to.move(temp, f"{inner}/{name}")
                yield pa.record_batch([pa.array([name])], names=["name"])

    dealt(todo.select("name", "sha256"), len(manifest["chunks"]), 1).mapInArrow(copy, "name string").agg(F.count(F.lit(1))).first()
    if not committed:
        with store.open_output_stream(f"{base}/.manifest.json") as out:
            out.write(body)
        store.move(f"{base}/.manifest.json", f"{base}/manifest.json")
    return {"uri": target, "manifest_sha256": manifest["manifest_sha256"], "chunks": len(manifest["chunks"]), "tokens": manifest["total_tokens"]}
