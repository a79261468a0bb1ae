"""Chunks as a data source and committing sink, and HTTP items by fake origins."""

import hashlib
import io

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus
from corpusloom.sources import http_items, token_chunks


@pytest.fixture
def pieces(spark):
    rows = [(k, pos, list(range(100 * k + pos, 100 * k + pos + 10))) for k in range(6) for pos in range(0, 40, 10)]
    return spark.createDataFrame(rows, token_chunks.SCHEMA).repartition(5)


def chunk_files(folder):
    """Files but for staging: a task that is being killed may still write there while the others are swept up."""
    return sorted(p.name for p in folder.rglob("*") if p.is_file() and not p.name.startswith(".") and "_staging" not in str(p))


def test_filters_open_no_other_chunk(spark, pieces, tmp_path):
    folder = f"file://{tmp_path}"
    manifest = corpus.manifest_of(token_chunks.write_chunks(pieces, folder), 2, 40, 1)
    whole = token_chunks.read_chunks(spark, folder, manifest)
    assert whole.rdd.getNumPartitions() == 6
    for k in (0, 2, 3, 5):
        (tmp_path / f"chunk-{k:05d}.bin").unlink()
    two = whole.where(F.col("chunk_id").isin(1, 4))
    assert two.rdd.getNumPartitions() == 2
    assert {r.chunk_id: list(r.tokens) for r in two.collect()} == {k: list(range(100 * k, 100 * k + 40)) for k in (1, 4)}
    for condition, n in (("chunk_id = 4", 1), ("chunk_id > 3 and chunk_id < 5", 1), ("chunk_id >= 4 and chunk_id <= 4 and pos = 0", 1), ("chunk_id = 4 and pos = 1", 0), ("chunk_id = 77", 0)):
        assert whole.where(condition).count() == n
    with pytest.raises(Exception, match="another size"):
        whole.where("chunk_id <= 1").collect()


def test_a_corrupt_chunk_fails_at_its_end(spark, pieces, tmp_path):
    folder = f"file://{tmp_path}"
    manifest = corpus.manifest_of(token_chunks.write_chunks(pieces, folder), 2, 40, 1)
    path = tmp_path / "chunk-00003.bin"
    data = path.read_bytes()
    path.write_bytes(data[:-1] + bytes([data[-1] ^ 1]))
    assert token_chunks.read_chunks(spark, folder, manifest).where("chunk_id <> 3 or pos < 0").where("chunk_id < 3").count() == 3
    with pytest.raises(Exception, match="does not match"):
        token_chunks.read_chunks(spark, folder, manifest).where("chunk_id = 3").collect()
    with pytest.raises(Exception, match="does not match its digest"):
        token_chunks.read_chunks(spark, folder, manifest | {"total_docs": 7}).collect()


def test_a_manifest_in_the_folder_may_be_pinned(spark, pieces, tmp_path):
    import json

    folder = f"file://{tmp_path}"
    manifest = corpus.manifest_of(token_chunks.write_chunks(pieces, folder), 2, 40, 1)
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    assert token_chunks.read_chunks(spark, folder).count() == 6
    reader = spark.read.format("token_chunks")
    assert reader.option("manifest_sha256", manifest["manifest_sha256"]).load(folder).count() == 6
    with pytest.raises(Exception, match="not the manifest"):
        reader.option("manifest_sha256", "0" * 64).load(folder).collect()


def test_a_lost_write_leaves_nothing_and_a_second_one_no_duplicate(spark, pieces, tmp_path):
    folder = f"file://{tmp_path}/c"
    bad = pieces.where("not (chunk_id = 4 and pos = 20)")
    with pytest.raises(Exception, match="gap"):
        token_chunks.write_chunks(bad, folder)
    assert chunk_files(tmp_path) == []
    first = sorted(map(tuple, token_chunks.write_chunks(pieces, folder).collect()))
    names = chunk_files(tmp_path)
    assert len(first) == 6 and names == sorted([*(f"chunk-{k:05d}.bin" for k in range(6)), "_chunks.json"])
    assert sorted(map(tuple, token_chunks.write_chunks(pieces, folder).collect())) == first and chunk_files(tmp_path) == names
    with pytest.raises(Exception, match="other content"):
        token_chunks.write_chunks(pieces.withColumn("tokens", F.reverse("tokens")), folder)
    assert chunk_files(tmp_path) == names and not list((tmp_path / "c").glob("_staging*"))


def test_a_task_that_dies_half_way_is_done_again(spark, pieces, tmp_path):
    """A worker process that ends in the middle of a chunk: its attempt is left in staging, the next one counts."""
    flag = tmp_path / "died"

    def dies_once(batches):
        import os

        from pyspark import TaskContext

        for batch in batches:
            yield batch
            if not flag.exists() and TaskContext.get().partitionId() == 1:
                flag.write_text("x")
                os._exit(1)

    risky = pieces.repartition(3, "chunk_id").sortWithinPartitions("chunk_id", "pos").mapInArrow(dies_once, token_chunks.SCHEMA)
    token_chunks.register(spark)
    try:
        risky.write.format("token_chunks").mode("append").save(f"file://{tmp_path}/c")
    except Exception:  # noqa: BLE001 - a local master does not try tasks again
        assert chunk_files(tmp_path / "c") == []
        risky.write.format("token_chunks").mode("append").save(f"file://{tmp_path}/c")
    assert flag.exists() and chunk_files(tmp_path / "c") == sorted([*(f"chunk-{k:05d}.bin" for k in range(6)), "_chunks.json"])


def test_one_chunk_from_two_tasks_is_refused(spark, pieces, tmp_path):
    token_chunks.register(spark)
    two = pieces.where("pos = 0").unionByName(pieces.where("pos = 0"))
    with pytest.raises(Exception, match="two tasks"):
        two.write.format("token_chunks").mode("append").save(f"file://{tmp_path}/c")
    with pytest.raises(Exception, match="written once"):
        pieces.write.format("token_chunks").mode("overwrite").save(f"file://{tmp_path}/c")
    assert chunk_files(tmp_path) == []


DATA = {"a/one.jsonl": b'{"id": "1", "text": "x", "crawl": "c"}\n' * 1, "b é?#/two.jsonl": b'{"id": "2", "text": "y"}\n{"id": "3", "text": "z"}\n'}


class Origin:
    """A fake origin: ``cut`` bytes per answer, ``longer`` or ``other`` content, or down."""

    def __init__(self, cut=1 << 30, longer=b"", other=False, down=False):
        self.cut, self.longer, self.other, self.down = cut, longer, other, down

    def __call__(self, url, start):
        import urllib.parse

        assert url.startswith("http://origin/base/")
        segments = url.removeprefix("http://origin/base/").split("/")
        data = DATA["/".join(map(urllib.parse.unquote, segments))] + self.longer
        if self.down:
            raise OSError("refused")
        return io.BytesIO((data[::-1] if self.other else data)[start : start + self.cut])


def items(spark, **changes):
    rows = [(n, changes.get("size", len(d)), changes.get("sha256", hashlib.sha256(d).hexdigest())) for n, d in DATA.items()]
    return spark.createDataFrame(rows, "name string, size long, sha256 string")


def fetch(spark, tmp_path, origin, listed=None):
    return {r["name"]: r["requests"] for r in http_items.fetch_items(items(spark) if listed is None else listed, "http://origin/base/", f"file://{tmp_path}/spool", origin, retries=2, wait_s=0).collect()}


def test_items_are_fetched_once_and_scanned(spark, tmp_path):
    assert fetch(spark, tmp_path, Origin()) == dict.fromkeys(DATA, 1)
    assert all((tmp_path / "spool" / n).read_bytes() == d for n, d in DATA.items())
    assert fetch(spark, tmp_path, Origin(down=True)) == dict.fromkeys(DATA, 0)
    one = items(spark).where("name like 'a/%'")
    rows = http_items.scan_http_items(spark, "http://origin/base", one, f"file://{tmp_path}/other", Origin(), wait_s=0).collect()
    assert [tuple(r) for r in rows] == [("c", "1", "x", "a/one.jsonl")]


def test_broken_connections_are_taken_up(spark, tmp_path):
    assert fetch(spark, tmp_path, Origin(cut=10)) == {n: -(-len(d) // 10) for n, d in DATA.items()}
    assert all((tmp_path / "spool" / n).read_bytes() == d for n, d in DATA.items())


@pytest.mark.parametrize("origin, message", [(Origin(longer=b"!"), "more than"), (Origin(other=True), "another digest"), (Origin(down=True), "refused"), (Origin(cut=0), "ends after 0")])
def test_bad_origins_leave_nothing(spark, tmp_path, origin, message):
    with pytest.raises(Exception, match=message):
        fetch(spark, tmp_path, origin)
    assert not [p for p in (tmp_path / "spool").rglob("*") if p.is_file()]


def test_items_must_be_pinned_and_safely_named(spark, tmp_path):
    with pytest.raises(Exception, match="must be given"):
        fetch(spark, tmp_path, Origin(), items(spark).withColumn("sha256", F.lit(None).cast("string")))
    for name in ("../x", "a//b", "/a", "a/./b", "a\nb"):
        with pytest.raises(ValueError, match="safe name"):
            http_items.item_url("http://origin/", name)
    for url in ("ftp://x", "http://", "http://x?q", "http://x y", "file:///x"):
        with pytest.raises(ValueError, match="plain http"):
            http_items.item_url(url, "a")
    (tmp_path / "spool/a").mkdir(parents=True)
    (tmp_path / "spool/a/one.jsonl").write_text("else")
    with pytest.raises(Exception, match="other content"):
        fetch(spark, tmp_path, Origin())
