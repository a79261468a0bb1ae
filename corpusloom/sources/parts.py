"""Parts of a build: what each unit and slice of keys holds, with a marker that vouches for the file.

A task writes a part under a temporary name, then gives it its own, then writes its marker.  So a build that was lost, even with its
driver, goes on with the slices that have no marker, and a part that was changed since differs from its marker's digest.
"""

from __future__ import annotations

import hashlib
import json
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import dealt, shuffle_partitions
from corpusloom.sources.token_chunks import file_digest, resolve

PART = "key string, crawl string, doc_id string, tokens array<int>, n_tokens long, has_eos boolean, is_validation boolean, unit_id string, role string"
PINS = ("recipe_sha256", "input_docs", "input_hash")
STATS = ("seen", "selected", "dropped_eos", "validation", "tokens")
MARKER = "unit_id string, slice int, recipe_sha256 string, input_docs long, input_hash string, seen long, selected long, dropped_eos long, validation long, tokens long, roles map<string, struct<docs: long, tokens: long>>, crawls map<string, long>, part string, part_sha256 string"


def unit_folder(unit: str) -> str:
    """Name of a unit's folder: one safe path segment."""
    quoted = urllib.parse.quote(unit, safe=" ")
    return f"u-{quoted}"


def slice_of(key: str = "key"):
    """Slice of a document: 16 of them, by its key, so that a large unit is many tasks."""
    return F.conv(F.substring(key, 1, 1), 16, 10).cast("int")


def write_parts(rows: DataFrame, units: DataFrame, folder: str) -> DataFrame:
    """Write ``PART`` rows by unit and slice, in key order, and a marker for each: the markers (``MARKER``).

    ``units`` has ``unit_id`` and the pins that go into the markers.  A part is streamed; a slice that is written again replaces
    its own part and no other.
    """
    columns = [c.split()[0] for c in PART.split(", ")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        store, base = resolve(folder)
        now, out, temp, facts = None, None, "", {}

        def close() -> Iterator[pa.RecordBatch]:
            if out is None:
                return
            out.close()
            unit, part_slice = now[:2]
            name = f"parts/{unit_folder(unit)}/slice-{part_slice:02d}.parquet"
            marker = {"unit_id": unit, "slice": part_slice, **dict(zip(PINS, now[2:], strict=True)), **facts, "part": name, "part_sha256": file_digest(store, temp)}
            store.move(temp, f"{base}/{name}")
            store.create_dir(f"{base}/markers/{unit_folder(unit)}", recursive=True)
            whole = f"{base}/markers/{unit_folder(unit)}/slice-{part_slice:02d}.json"
            with store.open_output_stream(f"{temp}.json") as file:
                file.write(json.dumps(marker).encode())
            store.move(f"{temp}.json", whole)
            yield pa.record_batch([pa.array([json.dumps(marker)])], names=["marker"])

        for batch in batches:
            ids = list(zip(*(batch.column(c).to_pylist() for c in ("unit_id", "_slice", *PINS)), strict=True))
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i][:2] != ids[i - 1][:2]), len(ids)]
            for p, q in zip(cuts[:-1], cuts[1:], strict=True):
                if p == q:
                    continue
                own = batch.slice(p, q - p).select(columns)
                if now is None or now[:2] != ids[p][:2]:
                    yield from close()
                    now, facts = ids[p], {**dict.fromkeys(STATS, 0), "roles": {}, "crawls": {}}
                    where = f"{base}/parts/{unit_folder(now[0])}"
                    store.create_dir(where, recursive=True)
                    temp = f"{where}/.slice-{now[1]:02d}-{TaskContext.get().taskAttemptId()}"
                    out = pq.ParquetWriter(temp, own.schema, filesystem=store, compression="zstd")
                out.write_batch(own)
                for role, crawl, n, eos, held in zip(*(own.column(c).to_pylist() for c in ("role", "crawl", "n_tokens", "has_eos", "is_validation")), strict=True):
                    facts["seen"] += 1
                    facts["crawls"][crawl] = facts["crawls"].get(crawl, 0) + 1
                    if eos:
                        facts["dropped_eos"] += 1
                        continue
                    sums = facts["roles"].setdefault(role, {"docs": 0, "tokens": 0})
                    sums["docs"], sums["tokens"] = sums["docs"] + 1, sums["tokens"] + n
                    facts["selected"], facts["tokens"], facts["validation"] = facts["selected"] + 1, facts["tokens"] + n, facts["validation"] + bool(held)
        yield from close()

    kinds = {c.split()[0]: c.split()[1] for c in PART.split(", ")}
    pinned = rows.select(*[F.col(c).cast(kinds[c]) for c in columns]).join(units.select("unit_id", *PINS), "unit_id").withColumn("_slice", slice_of())
    ordered = pinned.repartition(shuffle_partitions(rows.sparkSession), "unit_id", "_slice").sortWithinPartitions("unit_id", "_slice", "key")
    return ordered.mapInArrow(write, "marker string").select(F.from_json("marker", MARKER).alias("m")).select("m.*")


def read_markers(spark: SparkSession, folder: str) -> DataFrame:
    """Markers of all slices that were finished (none: no rows)."""
    store, base = resolve(folder)
    if store.get_file_info(f"{base}/markers").type == fs.FileType.NotFound:
        return spark.createDataFrame([], MARKER)
    return spark.read.schema(MARKER).option("recursiveFileLookup", True).json(f"{folder}/markers")


def changed_parts(markers: DataFrame, folder: str) -> DataFrame:
    """Markers whose part is missing or has another digest; parts are streamed where they lie."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = resolve(folder)
        for batch in batches:
            parts = batch.column(0).to_pylist()
            there = [store.get_file_info(f"{base}/{p}").type != fs.FileType.NotFound for p in parts]
            found = [file_digest(store, f"{base}/{p}") if t else None for p, t in zip(parts, there, strict=True)]
            yield pa.record_batch([pa.array(parts, pa.string()), pa.array(found, pa.string())], names=["part", "found_sha256"])

    found = dealt(markers.select("part"), markers.count(), 1).mapInArrow(digests, "part string, found_sha256 string")
    return markers.join(found, "part").where(~F.col("part_sha256").eqNullSafe(F.col("found_sha256")))


def unit_markers(markers: DataFrame) -> DataFrame:
    """Sums of a unit's slices: pins, ``STATS``; ``rows`` is null, as input counts are pinned."""
    sums = [F.sum(c).alias(c) for c in STATS]
    return markers.groupBy("unit_id", *PINS).agg(*sums).withColumn("rows", F.col("input_docs"))


def role_sums(markers: DataFrame) -> DataFrame:
    """``unit_id, role, docs, tokens`` of markers."""
    return markers.select("unit_id", F.explode("roles").alias("role", "r")).groupBy("unit_id", "role").agg(F.sum("r.docs").alias("docs"), F.sum("r.tokens").alias("tokens"))


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PART).option("recursiveFileLookup", True).parquet(f"{folder}/parts")


def unfinished(units: DataFrame, markers: DataFrame) -> DataFrame:
    """Units whose slices do not add up to their documents yet."""
    seen = unit_markers(markers).select("unit_id", "seen")
    return units.join(seen, "unit_id", "left").where(F.coalesce("seen", F.lit(0)) < F.col("input_docs")).drop("seen")


