"""Chunks of a corpus as a data source: ``spark.read.format("token_chunks")`` and a sink that commits.

Reading: one input partition per chunk of the manifest; filters on ``chunk_id`` choose the chunks, so others are never opened.
An object is read once: its size is checked first, slices are handed on while it is hashed, and a digest that is not the
manifest's fails the task at the end, so no job with a broken chunk completes.

Writing: tasks write whole chunks to a staging folder of their own query.  Only when all tasks are done does the commit move them
to their names and leave a list of them (``_chunks.json``); an abort removes the staging folder (a task that is still being killed may
write there again, where no reader looks).  A task that dies leaves no chunk, and whichever attempt succeeded, its chunks appear once.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from corpusloom.functions import scalar

SCHEMA = "chunk_id long, pos long, tokens array<int>"
#: Tokens of a slice.
SLICE = 65536
READ = 1 << 20
LISTED = "_chunks.json"


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[6:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def chunk_name(chunk: int) -> str:
    return f"chunk-{chunk:05d}.bin"


def checked_manifest(manifest: dict) -> dict:
    body = {k: v for k, v in manifest.items() if k != "manifest_sha256"}
    if scalar.canonical_digest(body, compact=False) != manifest["manifest_sha256"]:
        raise ValueError("the manifest does not match its digest")
    return manifest


@dataclass
class Chunk(InputPartition):
    chunk_id: int
    name: str
    tokens: int
    sha256: str


class ChunkReader(DataSourceReader):
    #: Comparison with ``chunk_id`` of each filter that is settled by choosing chunks.
    TESTS = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v}

    def __init__(self, folder: str, manifest: dict):
        self.folder = folder
        self.chunks = [Chunk(int(c["name"][6:-4]), c["name"], c["tokens"], c["sha256"]) for c in checked_manifest(manifest)["chunks"]]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            test = self.TESTS.get(type(f))
            if test is None or f.attribute != ("chunk_id",):
                yield f
            else:
                self.chunks = [c for c in self.chunks if test(c.chunk_id, f.value)]

    def partitions(self) -> list[Chunk]:
        return self.chunks

    def read(self, chunk: Chunk | None) -> Iterator[pa.RecordBatch]:
        if chunk is None:
            return
        store, base = resolve(self.folder)
        path, digest, pos = f"{base}/{chunk.name}", hashlib.sha256(), 0
        if store.get_file_info(path).size != 4 * chunk.tokens:
            raise ValueError(f"{chunk.name} has another size than the manifest says")
        with store.open_input_stream(path) as source:
            while data := source.read(4 * SLICE):
                digest.update(data)
                n = len(data) // 4
                tokens = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.Array.from_buffers(pa.int32(), n, [None, pa.py_buffer(data)]))
                yield pa.record_batch([pa.array([chunk.chunk_id], pa.int64()), pa.array([pos], pa.int64()), tokens], names=["chunk_id", "pos", "tokens"])
                pos += n
        if pos != chunk.tokens or digest.hexdigest() != chunk.sha256:
            raise ValueError(f"{chunk.name} does not match the manifest")


@dataclass
class Staged(WriterCommitMessage):
    """Chunks of one task: id, tokens, digest, staged path (empty: the same content was there already)."""

    chunks: list[tuple[int, int, str, str]]


class ChunkWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        from pyspark import TaskContext

        store, base = resolve(self.folder)
        # A folder for each attempt, so that two of one task never meet.
        own = f"{base}/{self.staging}/{TaskContext.get().taskAttemptId()}"
        store.create_dir(own, recursive=True)
        done: list[tuple[int, int, str, str]] = []
        chunk, out, digest, n = None, None, None, 0

        def close() -> None:
            if out is None:
                return
            out.close()
            there = f"{base}/{chunk_name(chunk)}"
            staged = f"{own}/{chunk_name(chunk)}"
            if store.get_file_info(there).type != fs.FileType.NotFound:
                if file_digest(store, there) != digest.hexdigest():
                    raise ValueError(f"{chunk_name(chunk)} exists with other content")
                store.delete_file(staged)
                staged = ""
            done.append((chunk, n, digest.hexdigest(), staged))

        for batch in iterator:
            tokens = batch.column("tokens")
            for i, (at, pos) in enumerate(zip(batch.column("chunk_id").to_pylist(), batch.column("pos").to_pylist(), strict=True)):
                if at != chunk:
                    close()
                    chunk, digest, n = at, hashlib.sha256(), 0
                    out = store.open_output_stream(f"{own}/{chunk_name(at)}")
                if pos != n:
                    raise ValueError(f"chunk {chunk} has a gap at {n}")
                data = tokens[i].values.to_numpy().astype("<i4").tobytes()
                out.write(data)
                digest.update(data)
                n += len(data) // 4
        close()
        return Staged(done)

    def commit(self, messages: list[Staged | None]) -> None:
        store, base = resolve(self.folder)
        chunks = sorted(c for m in messages if m for c in m.chunks)
        ids = [c[0] for c in chunks]
        if len(set(ids)) < len(ids):
            self.abort(messages)
            raise ValueError("a chunk was written by two tasks: rows must be dealt by chunk_id")
        for chunk, _, _, staged in chunks:
            if staged:
                store.move(staged, f"{base}/{chunk_name(chunk)}")
        listed = [{"chunk_id": c, "name": chunk_name(c), "tokens": n, "sha256": d} for c, n, d, _ in chunks]
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{LISTED}") as out:
            out.write(json.dumps(listed).encode())
        self.abort([])

    def abort(self, messages: list[Staged | None]) -> None:
        store, base = resolve(self.folder)
        if store.get_file_info(f"{base}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{self.staging}")


def file_digest(store: fs.FileSystem, path: str) -> str:
    digest = hashlib.sha256()
    with store.open_input_stream(path) as source:
        while data := source.read(READ):
            digest.update(data)
    return digest.hexdigest()


class TokenChunks(DataSource):
    """``path`` is the folder; ``manifest`` (JSON) overrides its ``manifest.json``, ``manifest_sha256`` pins which one it must be."""

    @classmethod
    def name(cls) -> str:
        return "token_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChunkReader:
        folder = self.options["path"]
        if "manifest" in self.options:
            manifest = json.loads(self.options["manifest"])
        else:
            store, base = resolve(folder)
            with store.open_input_stream(f"{base}/manifest.json") as source:
                manifest = json.loads(source.read())
        pinned = self.options.get("manifest_sha256")
        if pinned and manifest["manifest_sha256"] != pinned:
            raise ValueError("not the manifest that is asked for")
        return ChunkReader(folder, manifest)

    def writer(self, schema, overwrite: bool) -> ChunkWriter:
        if overwrite:
            raise ValueError("chunks are written once: use mode append")
        return ChunkWriter(self.options["path"])


def register(spark: SparkSession) -> SparkSession:
    """Make the source known to a session, and let it take filters."""
    spark.dataSource.register(TokenChunks)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_chunks(spark: SparkSession, folder: str, manifest: dict | None = None) -> DataFrame:
    """Slices ``chunk_id, pos, tokens`` of a corpus; filters on ``chunk_id`` open no other chunk."""
    reader = register(spark).read.format("token_chunks")
    return (reader.option("manifest", json.dumps(checked_manifest(manifest))) if manifest is not None else reader).load(folder)


def write_chunks(pieces: DataFrame, folder: str) -> DataFrame:
    """Write ``chunk_id, pos, tokens`` pieces as ``chunk-%05d.bin`` (little-endian int32), once each: ``chunk_id, name, tokens, sha256``.

    A task streams its chunks in order of position, so no chunk is held whole; one that exists with other bytes is an error.
    """
    spark = register(pieces.sparkSession)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = pieces.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMA.split(", ")]).repartition(parts, "chunk_id").sortWithinPartitions("chunk_id", "pos")
    ordered.write.format("token_chunks").mode("append").save(folder)
    store, base = resolve(folder)
    with store.open_input_stream(f"{base}/{LISTED}") as source:
        listed = json.loads(source.read())
    return spark.createDataFrame([(c["chunk_id"], c["name"], c["tokens"], c["sha256"]) for c in listed], "chunk_id long, name string, tokens long, sha256 string")
