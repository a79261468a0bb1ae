"""Closed forms, hashes, traps and failures of the corpus side."""

import hashlib
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scalar
from corpusloom.operators import corpus, samples
from corpusloom.sources import documents as src
from corpusloom.sources import token_chunks


def stream_of(spark, lengths):
    rows, at = [], 0
    for i, n in enumerate(lengths):
        rows.append((i, at, n, list(range(at, at + n))))
        at += n
    return spark.createDataFrame(rows, "doc_id long, start_pos long, n_tokens long, tokens array<int>").withColumn("stream_tokens", F.lit(at).cast("long")), at


@pytest.mark.parametrize("lengths", [[1], [4, 4, 4], [13], [4, 1], [3, 5, 1, 1, 9], [2, 6, 8], [8, 1], [5, 0, 3]])
def test_chunks_and_samples_follow_the_list_model(spark, lengths):
    chunk, seq = 4, 2
    stream, n = stream_of(spark, lengths)
    flat = list(range(n))
    chunks = {}
    for r in corpus.cut_chunks(stream, chunk, tokens="tokens").orderBy("chunk_id", "pos").collect():
        held = chunks.setdefault(r.chunk_id, [])
        assert len(held) == r.pos and len(r.tokens) == r.n_piece
        held += r.tokens
    assert chunks == {k: flat[k * chunk : (k + 1) * chunk + 1] for k in range(-(-n // chunk))}
    got = {r.g: r.tokens for r in samples.assemble(samples.sample_pieces(stream, seq)).collect()}
    assert got == {g: flat[g * seq : g * seq + seq + 1] for g in range((n - 1) // seq)}
    layout = samples.chunk_layout(corpus.chunk_counts(corpus.cut_chunks(stream, chunk)), seq).collect()
    assert max((r.cumulative for r in layout), default=0) == (n - 1) // seq


@pytest.mark.parametrize("budget", [1, 5, 12, 100])
def test_budget_is_an_exact_prefix(spark, budget):
    stream, n = stream_of(spark, [5, 3, 4])
    out = corpus.token_budget(stream, budget, tokens="tokens").orderBy("start_pos").collect()
    assert [t for r in out for t in r.tokens] == list(range(min(n, budget))) and all(len(r.tokens) == r.n_tokens for r in out)


def test_hashes_match_hashlib(spark):
    rows = [("c", "1"), ("", "é\0x"), ("漢", "z" * 100)]
    df = spark.createDataFrame(rows, "crawl string, doc_id string")
    seed = b"0123456789abcdef"
    out = corpus.with_validation(corpus.doc_key(df, "blake2b", seed), "dom", 0.5, "blake2b").collect()
    for r in out:
        key = hashlib.blake2b(f"{r.crawl}\0{r.doc_id}".encode(), digest_size=16, key=seed).digest()
        assert r.key == key.hex()
        assert r.is_validation == (int.from_bytes(hashlib.blake2b(b"dom\0" + key, digest_size=8).digest(), "big") < 1 << 63)


def test_pcg64_permutation(spark):
    layout = spark.createDataFrame([(0, 5), (1, 8)], "chunk_id long, samples long")
    got = {}
    for r in samples.permutation_pcg64(layout, 3, 2).orderBy("chunk_id", "local").collect():
        got.setdefault(r.chunk_id, []).append(r.j)
    for k, n in ((0, 5), (1, 8)):
        start = int.from_bytes(hashlib.blake2b(f"3:2:{k}".encode(), digest_size=8).digest(), "little")
        assert got[k] == np.random.Generator(np.random.PCG64(start)).permutation(n).tolist()


def test_whitespace_is_python_whitespace(spark):
    points = [c for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, f"a{chr(c)}{chr(c)}b") for c in points], "c int, t string")
    out = df.select("c", scalar.whitespace_normalize(F.col("t")).alias("t")).collect()
    assert all(r.t == re.sub(r"\s+", " ", f"a{chr(r.c)}{chr(r.c)}b") for r in out)


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(scalar.rate_to_mbps(F.lit("12.5Gbps"))) == 12500 and get(scalar.rate_to_mbps(F.lit("x"))) is None
    assert get(scalar.successor_stage(F.lit("body2.1"), 4)) == "tail" and get(scalar.successor_stage(F.lit("tail.0"), 4)) is None
    assert tuple(get(scalar.member_value(F.lit("p_ghost1_2_ghost2_9")))) == ("p_ghost1_2", 2, 9)
    assert get(scalar.nearest_rank(F.array(*map(F.lit, [5.0, 1.0, 3.0, 9.0])), 0.5)) == 5.0
    assert get(F.hex(F.lit(bytearray(b"\x80"))) > F.hex(F.lit(bytearray(b"\x7f"))))
    assert get(scalar.flop_per_sample(F.lit(10.0), 2, 3, 4, 5)) == (20 + 4 * 2 * 3 * 4 * 5) * 5
    for name, good in (("a/b.bin", True), ("../a", False), ("/a", False), ("a//b", False), ("a\\b", False), ("a/.", False)):
        assert get(scalar.safe_object_name(F.lit(name))) == good
    for path, pattern, good in (("a/b/c.x", "**/*.x", True), ("c.x", "**/*.x", True), ("a/b.x", "*.x", False), ("a/b", "a/?", True), ("a/b/c", "a/**", True)):
        assert get(scalar.glob_match(F.lit(path), pattern)) == good


def test_documents_from_json_and_parquet(spark, tmp_path):
    lines = [{"id": "1", "text": "x", "dump": "d"}, {"id": "2", "text": "é", "crawl": "c", "dump": "d"}, {"id": "3", "text": "", "dump": ""}]
    folder = tmp_path / "CC-MAIN-1"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n  \n")
    spark.createDataFrame([("9", "t", None)], "id string, text string, dump string").coalesce(1).write.parquet(str(tmp_path / "CC-MAIN-2"))
    root = str(tmp_path)
    parquet = [str(p) for p in (tmp_path / "CC-MAIN-2").glob("*.parquet")]
    out = src.scan_documents(spark, [str(folder / "a.jsonl"), *parquet], root).collect()
    assert sorted((r.crawl, r.doc_id, r.text) for r in out) == [("CC-MAIN-1", "3", ""), ("CC-MAIN-2", "9", "t"), ("c", "2", "é"), ("d", "1", "x")]
    for bad in ('{"id": 5, "text": "x"}', '{"id": "5"}', "{", '{"id": "5", "text": null}'):
        (folder / "bad.jsonl").write_text(bad)
        with pytest.raises(Exception, match="no text in"):
            src.scan_jsonl_documents(spark, str(folder / "bad.jsonl"), root).collect()
    (folder / "bad.jsonl").unlink()
    with pytest.raises(ValueError, match="missing"):
        spark.range(1).write.parquet(str(tmp_path / "n.parquet"))
        src.scan_parquet_documents(spark, str(tmp_path / "n.parquet"))
    with pytest.raises(ValueError, match="neither"):
        src.scan_documents(spark, ["x.csv"])
    inventory = src.list_inventory(spark, root)
    names = [r.name for r in inventory.collect()]
    assert "CC-MAIN-1/a.jsonl" in names and names == sorted(names)
    digests = {r.name: (r.bytes, r.sha256) for r in src.hash_objects(inventory).collect()}
    data = (folder / "a.jsonl").read_bytes()
    assert digests["CC-MAIN-1/a.jsonl"] == (len(data), hashlib.sha256(data).hexdigest())
    rows = {r.name: r.rows for r in src.parquet_footer_rows(inventory).collect()}
    assert rows["CC-MAIN-1/a.jsonl"] is None and sum(v or 0 for k, v in rows.items() if "MAIN-2" in k) == 1
    assert src.unique_names(inventory).isEmpty()


def test_chunk_files_round_trip(spark, tmp_path):
    stream, n = stream_of(spark, [700, 9, 1300, 91])
    pieces = corpus.cut_chunks(stream, 512, tokens="tokens")
    folder = f"file://{tmp_path}/out"
    written = token_chunks.write_chunks(pieces, folder).cache()
    manifest = corpus.manifest_of(written, 2, 512, 4)
    assert manifest["total_tokens"] == n and len(manifest["chunks"]) == -(-n // 512)
    flat = {}
    for r in token_chunks.read_chunks(spark, folder, manifest).orderBy("chunk_id", "pos").collect():
        flat.setdefault(r.chunk_id, []).extend(r.tokens)
    assert flat == {k: list(range(n))[k * 512 : (k + 1) * 512 + 1] for k in range(-(-n // 512))}
    assert token_chunks.write_chunks(pieces, folder).count() == len(flat)
    with pytest.raises(Exception, match="other content"):
        token_chunks.write_chunks(corpus.cut_chunks(stream.withColumn("tokens", F.transform("tokens", lambda x: x + 1)), 512, tokens="tokens"), folder).collect()
    with pytest.raises(ValueError, match="digest"):
        token_chunks.read_chunks(spark, folder, manifest | {"total_docs": 5})
    files = [(k, f"{folder}/chunk-{k:05d}.bin", (tmp_path / "out" / f"chunk-{k:05d}.bin").stat().st_size) for k in flat]
    objects = spark.createDataFrame(files, "ordinal long, path string, size long")
    again = corpus.cut_chunks(src.rechunk(src.scan_token_objects(spark, objects, 512), 512), 300, tokens="tokens")
    cut = {}
    for r in again.orderBy("chunk_id", "pos").collect():
        cut.setdefault(r.chunk_id, []).extend(r.tokens)
    assert cut == {k: list(range(n))[k * 300 : (k + 1) * 300 + 1] for k in range(-(-n // 300))}
    (tmp_path / "out" / "chunk-00001.bin").write_bytes(b"\0" * 4 * 513)
    with pytest.raises(Exception, match="does not match"):
        token_chunks.read_chunks(spark, folder, manifest).collect()


def test_failures(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "key string")
    with pytest.raises(ValueError, match="repeated"):
        corpus.fail_if_any(corpus.duplicate_keys(df), "repeated keys")
    with pytest.raises(Exception, match="out of range"):
        corpus.assert_token_range(spark.createDataFrame([([1, 300],)], "tokens array<int>"), 272).collect()
    with pytest.raises(ValueError, match="unknown"):
        corpus.apply_transforms(df, [("nope", 1)])
    with pytest.raises(ValueError, match="strictly"):
        scalar.share_threshold(1.0, 16)
    with pytest.raises(ValueError, match="non-negative"):
        samples.range_ids(spark, -1, 3)
    stats = spark.createDataFrame([("u", 10, 6), ("v", 0, 0)], "unit_id string, seen long, dropped_eos long")
    assert [r.unit_id for r in corpus.eos_drop_violations(stats, 0.5).collect()] == ["u"]
    rows = spark.createDataFrame([(0, "a"), (1, "c"), (2, "b")], "position long, key string")
    assert corpus.order_violations(rows).count() == 1
    chunks = spark.createDataFrame([("x", 8, "h"), ("y", 4, "h")], "name string, size long, sha256 string")
    manifest = spark.createDataFrame([("x", 2, "h"), ("z", 1, "h")], "name string, tokens long, sha256 string")
    assert sorted(r.name for r in corpus.chunk_integrity(chunks, manifest).collect()) == ["y", "z"]
    assert [r.action for r in src.publish(chunks, chunks.limit(1), False).orderBy("name").collect()] == ["skip", "copy"]
    with pytest.raises(Exception, match="dangling"):
        src.publish(chunks, chunks.limit(1), True).collect()
    with pytest.raises(ValueError, match="identity"):
        src.resolve_corpus("a", {"a": {"uri": "s3://x"}})
    assert src.resolve_corpus("a", {"a": {"uri": "s3://x"}}, "file:///y")["uri"] == "file:///y"


def test_frames_and_roles(spark):
    df = spark.createDataFrame([([5, 6], True), ([7], False)], "tokens array<int>, is_validation boolean")
    assert [r.tokens for r in corpus.frame_tokens(df, 1, 2).collect()] == [[1, 5, 6, 2], [1, 7, 2]]
    assert [r.tokens for r in corpus.frame_tokens(df, None, 2).collect()] == [[5, 6, 2], [7, 2]]
    assert {r.role for r in corpus.route_roles(df, ["train"]).collect()} == {"train"}
    assert [r.role for r in corpus.route_roles(df, ["train", "validation"]).collect()] == ["validation", "train"]
    text = spark.createDataFrame([("aé",), (None,), ("",)], "text string")
    assert [r.tokens for r in corpus.tokenize_bytes(text).collect()] == [[b + 16 for b in "aé".encode()], None, []]
