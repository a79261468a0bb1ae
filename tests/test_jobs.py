"""Whole jobs end to end."""

import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scalar
from corpusloom.operators import corpus, records, samples, telemetry
from corpusloom.plans import jobs
from corpusloom.plans.corpus_queries import documents
from corpusloom.sources import documents as documents_source
from corpusloom.sources import parts, token_chunks


@pytest.mark.parametrize("pieces", [1, 5])
def test_build_and_read(spark, data_dir, tmp_path, pieces):
    docs = documents(spark, data_dir).repartition(pieces)
    recipe = jobs.Recipe(seed=b"s" * 16, chunk_tokens=4096, validation=0.2, budgets=(("train", 150_000),))
    folder = f"file://{tmp_path}/corpus"
    manifests = jobs.build_corpus(docs, recipe, folder)
    rows = []
    for r in docs.select("crawl", "doc_id", "text").collect():
        import hashlib

        key = hashlib.blake2b(f"{r.crawl}\0{r.doc_id}".encode(), digest_size=16, key=b"s" * 16).digest()
        held = int.from_bytes(hashlib.blake2b(b"validation\0" + key, digest_size=8).digest(), "big") < int(0.2 * 2**64)
        rows.append((key, held, [1, *(b + 16 for b in r.text.encode()), 2]))
    for role, held, budget in (("train", False, 150_000), ("validation", True, 1 << 60)):
        stream = [t for k, h, ts in sorted(rows) if h == held for t in ts][:budget]
        manifest = manifests[role]
        assert manifest["total_tokens"] == len(stream)
        out = jobs.read_corpus(spark, f"{folder}/{role}", manifest, 512, seed=3).orderBy("sample_id").collect()
        assert [r.sample_id for r in out] == list(range((len(stream) - 1) // 512))
        for r in out:
            g = r.chunk_id * 8 + r.j
            assert r.tokens == stream[g * 512 : g * 512 + 513]
    assert jobs.build_corpus(docs, recipe, folder) == manifests
    with pytest.raises(ValueError, match="one key"):
        jobs.build_corpus(docs.unionByName(docs.limit(1)), recipe, f"file://{tmp_path}/other")
    assert not (tmp_path / "other" / "train" / "manifest.json").exists()


def test_publication(spark, tmp_path):
    docs = spark.createDataFrame([("c", f"d{i}", "text " * i) for i in range(30)], "crawl string, doc_id string, text string")
    source, target = f"file://{tmp_path}/corpus/train", tmp_path / "public"
    manifest = jobs.build_corpus(docs, jobs.Recipe(chunk_tokens=256, roles=("train",)), f"file://{tmp_path}/corpus")["train"]
    receipt = documents_source.publish_chunks(spark, source, f"file://{target}", manifest)
    assert receipt["chunks"] == len(manifest["chunks"]) > 3 and sorted(p.name for p in target.glob("*.bin")) == [c["name"] for c in manifest["chunks"]]
    total = token_chunks.read_chunks(spark, f"file://{target}", manifest).agg(F.sum(F.size("tokens"))).first()[0]
    assert total == sum(c["tokens"] for c in manifest["chunks"])
    assert documents_source.publish_chunks(spark, source, f"file://{target}", manifest) == receipt
    first = target / manifest["chunks"][0]["name"]
    whole = first.read_bytes()
    first.unlink()
    with pytest.raises(Exception, match="dangling"):
        documents_source.publish_chunks(spark, source, f"file://{target}", manifest)
    (target / "manifest.json").unlink()
    assert documents_source.publish_chunks(spark, source, f"file://{target}", manifest) == receipt and first.read_bytes() == whole
    with pytest.raises(ValueError, match="another manifest"):
        documents_source.publish_chunks(spark, source, f"file://{target}", {**manifest, "total_docs": 0})
    first.write_bytes(whole[:-4] + b"....")
    with pytest.raises(Exception, match="other content"):
        documents_source.publish_chunks(spark, source, f"file://{target}", manifest)


def test_a_build_goes_on(spark, tmp_path):
    docs = spark.createDataFrame([("c", f"d{i}", "text " * i, f"data/u {i % 4}") for i in range(40)], "crawl string, doc_id string, text string, unit_id string")
    recipe = jobs.Recipe(chunk_tokens=256, validation=0.3)
    want = jobs.build_corpus(docs, recipe, f"file://{tmp_path}/whole")
    folder = f"file://{tmp_path}/lost"
    jobs.build_units(docs.where("unit_id <> 'data/u 2'"), recipe, folder)
    built = {p: p.stat().st_mtime_ns for p in (tmp_path / "lost/parts").rglob("*.parquet")}
    assert jobs.build_corpus(docs, recipe, folder) == want
    now = {p: p.stat().st_mtime_ns for p in (tmp_path / "lost/parts").rglob("*.parquet")}
    assert built.items() < now.items() and all("u 2" in str(p) for p in now.keys() - built.keys())
    with pytest.raises(ValueError, match="something else"):
        jobs.build_units(docs.where("doc_id <> 'd3'"), recipe, folder)
    with pytest.raises(ValueError, match="something else"):
        jobs.build_units(docs, jobs.Recipe(chunk_tokens=512), folder)
    next(iter((tmp_path / "lost/parts").rglob("*.parquet"))).unlink()
    with pytest.raises(ValueError, match="parts and marker"):
        jobs.build_units(docs, recipe, folder)


def test_a_build_lost_within_a_unit_goes_on_slice_by_slice(spark, tmp_path):
    """With default settings: slices that were finished before the loss are not built again."""
    docs = spark.createDataFrame([("c", f"d{i}", "text " * i, "one") for i in range(60)], "crawl string, doc_id string, text string, unit_id string")
    recipe = jobs.Recipe(chunk_tokens=256, validation=0.3)
    folder, place = f"file://{tmp_path}/c", tmp_path / "c"
    want = jobs.build_corpus(docs, recipe, folder)
    markers = sorted((place / "markers").rglob("*.json"))
    assert len(markers) > 8
    for m in markers[3:]:
        m.unlink()
    (place / "parts/u-one" / markers[4].name.replace("json", "parquet")).unlink()
    before = {p: p.stat().st_mtime_ns for p in (place / "parts").rglob("*.parquet")}
    assert jobs.build_corpus(docs, recipe, folder) == want
    kept = {m.name.replace("json", "parquet") for m in markers[:3]}
    assert all((p.stat().st_mtime_ns == t) == (p.name in kept) for p, t in before.items())


def test_a_part_changed_with_equal_counts_is_found(spark, tmp_path):
    docs = spark.createDataFrame([("c", f"d{i}", f"word{i}", "one") for i in range(30)], "crawl string, doc_id string, text string, unit_id string")
    recipe, folder = jobs.Recipe(chunk_tokens=256), f"file://{tmp_path}/c"
    jobs.build_units(docs, recipe, folder)
    path = next(iter((tmp_path / "c/parts").rglob("*.parquet")))
    table = pq.read_table(path)
    i = table.column_names.index("tokens")
    tokens = [[x + 1 if x > 2 else x for x in t] for t in table["tokens"].to_pylist()]
    pq.write_table(table.set_column(i, table.schema.field(i), pa.array(tokens, table.schema.field(i).type)), path)
    with pytest.raises(ValueError, match="parts and marker"):
        jobs.build_corpus(docs, recipe, folder)


def test_audits_and_publication_of_a_build(spark, tmp_path):
    docs = spark.createDataFrame([(f"c{i % 2}", f"d{i}", "text " * i) for i in range(40)], "crawl string, doc_id string, text string")
    recipe = jobs.Recipe(chunk_tokens=256, validation=0.3)
    crawls = spark.createDataFrame([("c0", 20), ("c1", 20)], "crawl string, rows long")
    manifests = jobs.build_corpus(docs, recipe, f"file://{tmp_path}/c", crawls=crawls, publish_to=f"file://{tmp_path}/public")
    for role, manifest in manifests.items():
        assert json.loads((tmp_path / "public" / role / "manifest.json").read_text()) == manifest
        assert jobs.broken_chunks(spark, f"file://{tmp_path}/public/{role}", manifest).isEmpty()
    with pytest.raises(ValueError, match="declared rows"):
        jobs.build_corpus(docs, recipe, f"file://{tmp_path}/c", crawls=crawls.withColumn("rows", F.col("rows") + 1))
    chunk = tmp_path / "c/train/chunk-00000.bin"
    chunk.write_bytes(b"\0" * len(chunk.read_bytes()))
    assert [r["name"] for r in jobs.broken_chunks(spark, f"file://{tmp_path}/c/train", manifests["train"]).collect()] == ["chunk-00000.bin"]
    evidence = jobs.unit_evidence(docs.withColumn("unit_id", F.lit("unit-00000")))
    assert evidence.first()["input_docs"] == 40 and jobs.build_corpus(docs, recipe, f"file://{tmp_path}/other", evidence=evidence) == manifests


def test_parts(spark, tmp_path):
    one = lambda i: (f"{i * 7919 % 97:02x}", "c", f"d{i}", [1, i, 2], 3, i % 5 == 0, i % 2 == 0, f"u{i % 3}", "train" if i % 2 else "validation")
    rows = spark.createDataFrame([one(i) for i in range(60)], parts.PART)
    units = rows.groupBy("unit_id").agg(F.count("*").alias("input_docs")).withColumns({"recipe_sha256": F.lit("r"), "input_hash": F.lit("h")}).cache()
    folder = f"file://{tmp_path}/c"
    written = parts.write_parts(rows, units, folder).collect()
    assert all(len(r.part_sha256) == 64 for r in written) and {tuple(r) for r in parts.read_markers(spark, folder).drop("roles", "crawls").collect()} == {tuple(r.asDict()[c] for c in r.asDict() if c not in ("roles", "crawls")) for r in written}
    sums = {r.unit_id: r for r in parts.unit_markers(parts.read_markers(spark, folder)).collect()}
    assert {u: (r.seen, r.dropped_eos, r.tokens) for u, r in sums.items()} == {u: (20, 4, 48) for u in ("u0", "u1", "u2")}
    assert parts.unfinished(units, parts.read_markers(spark, folder)).isEmpty() and parts.changed_parts(parts.read_markers(spark, folder), folder).isEmpty()
    assert corpus.reconcile_units(parts.unit_markers(parts.read_markers(spark, folder)), parts.role_sums(parts.read_markers(spark, folder))).isEmpty()
    assert sorted(r.doc_id for r in parts.read_parts(spark, folder).collect()) == sorted(f"d{i}" for i in range(60))
    for path in (tmp_path / "c/parts").rglob("*.parquet"):
        keys = pq.read_table(path)["key"].to_pylist()
        assert keys == sorted(keys)


def test_units_that_do_not_add_up(spark):
    good = ("u", 10, 8, 2, 3, 40, 10)
    schema = "unit_id string, seen long, selected long, dropped_eos long, validation long, tokens long, rows long"
    held = spark.createDataFrame([("u", "train", 5, 25), ("u", "validation", 3, 15)], "unit_id string, role string, docs long, tokens long")
    assert corpus.reconcile_units(spark.createDataFrame([good], schema), held).isEmpty()
    for i, value in ((1, 11), (2, 9), (4, 9), (4, 2), (5, 41), (6, 12)):
        bad = tuple(value if k == i else v for k, v in enumerate(good))
        assert corpus.reconcile_units(spark.createDataFrame([bad], schema), held).count() == 1
    short = spark.createDataFrame([("u", "train", 5, 38), ("u", "validation", 3, 2)], "unit_id string, role string, docs long, tokens long")
    assert corpus.reconcile_units(spark.createDataFrame([good], schema), short).count() == 1


def test_reading_by_ids(spark, tmp_path):
    """Ranges, strides and batches over several epochs, from the chunks that hold them only."""
    docs = spark.createDataFrame([("c", f"d{i}", "text " * i) for i in range(30)], "crawl string, doc_id string, text string")
    folder = f"file://{tmp_path}/c/train"
    manifest = jobs.build_corpus(docs, jobs.Recipe(chunk_tokens=256, roles=("train",)), f"file://{tmp_path}/c")["train"]
    total = jobs.epoch_samples(manifest, 32)
    whole = {}
    for epoch in (0, 1):
        whole |= {r.sample_id: list(r.tokens) for r in jobs.read_corpus(spark, folder, manifest, 32, seed=5, epoch=epoch).collect()}
    for ids in (samples.range_ids(spark, total - 3, 6), samples.range_ids(spark, 1, 9, stride=7), samples.stream_batches(spark, 1, 3, 2, 4)):
        got = jobs.read_samples(spark, folder, manifest, 32, 5, ids).collect()
        assert sorted(r.sample_id for r in got) == sorted(r.sample_id for r in ids.collect())
        assert all(list(r.inputs) == whole[r.sample_id][:-1] and list(r.labels) == whole[r.sample_id][1:] for r in got)
    assert jobs.read_samples(spark, folder, manifest, 32, 5, samples.range_ids(spark, 0, 0)).count() == 0
    (tmp_path / "c/train/chunk-00001.bin").unlink()
    assert jobs.read_samples(spark, folder, manifest, 32, 5, samples.range_ids(spark, 0, 8)).count() == 8
    with pytest.raises(Exception, match="another size"):
        jobs.read_samples(spark, folder, manifest, 32, 5, samples.range_ids(spark, 0, 9)).collect()


def test_console_view(spark):
    at = "2026-01-01 00:00:{:02d},000 - {}"
    texts = ["INFO - Exiting ghost mode at 3 local epoch", "INFO - Ghost phase 1 will last 5 steps, ending at local epoch 9", "INFO - Processed 0 batches in last 60 seconds:", "INFO - Processed 4 batches in last 60 seconds:", "INFO - chatter", "WARNING - odd", "INFO - Exiting ghost mode at 9 local epoch", "INFO - Processed 0 batches in last 60 seconds:"]
    df = spark.createDataFrame([("h", at.format(i, t)) for i, t in enumerate(texts)], "host string, value string")
    out = telemetry.visible_lines(telemetry.parse_lines(df)).orderBy("ts").collect()
    assert [(r.ts.second, r.tag) for r in out] == [(1, "SYNC"), (3, "PROGRESS"), (5, "WARNING"), (6, "SYNC"), (7, "PROGRESS")]


def test_fleet_and_vectors(spark):
    df = spark.createDataFrame([("h", f"2026-01-01 00:00:0{i},000 - INFO - [GhostPhase] phase: {i}") for i in range(3)] + [("h", "2026-01-01 00:00:05,000 - ERROR - x"), ("h", "2026-01-01 00:00:06,000 - INFO - Banned expert a.1 reason=t duration=1s")], "host string, value string")
    gauges, errors, labels = jobs.fleet_metrics(df)
    assert [(r.name, r.value) for r in gauges.collect()] == [("ghost_phase", 2.0)]
    assert [(r.name, r.total) for r in errors.collect()] == [("error_unknown", 1)] and labels.first().name == "ban_t_a.1"
    sent = spark.createDataFrame([("g", 1.0, [1.0, 3.0]), ("g", 3.0, [5.0, 7.0]), ("g", 9.0, [float("nan"), 0.0]), ("z", 0.0, [4.0, 4.0])], "g string, weight double, embedding array<double>")
    local = spark.createDataFrame([("g", [0.0, 0.0]), ("z", [1.0, 2.0]), ("none", [5.0, 6.0])], "g string, embedding array<double>")
    got = {r.g: r.embedding for r in jobs.average_vectors(sent, local, ["g"]).collect()}
    assert np.allclose(got["g"], [4, 6]) and got["z"] == [1, 2] and got["none"] == [5, 6]
    losses = spark.createDataFrame([("o", "train/loss", 3, 0.0, 1.5)], "origin string, mode string, step long, loss double, tps double").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert records.loss_records(losses, "60 seconds").first().value == '{"mode":"train/loss","step":3,"tps":1.5}'
    assert len(jobs.Recipe().sha256) == 64 and scalar.canonical_digest({"b": 1, "a": 2}) == scalar.canonical_digest({"a": 2, "b": 1})


def test_build_with_a_tokenizer_file(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = [f"w{i}" for i in range(50)]
    tokenizer = Tokenizer(models.WordLevel({"<unk>": 0, "<s>": 1, "</s>": 2, **{w: i + 3 for i, w in enumerate(words)}}, unk_token="<unk>"))
    tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    path = str(tmp_path / "words.json")
    tokenizer.save(path)
    rows = [("c", f"d{i}", " ".join(words[(i * 7 + k) % 50] for k in range(i % 30)) + " zz") for i in range(40)]
    docs = spark.createDataFrame(rows, "crawl string, doc_id string, text string")
    recipe = jobs.Recipe(chunk_tokens=64, roles=("train",), flavour="sha2", tokenizer=path, bos=None, eos=2, vocabulary=53)
    folder = f"file://{tmp_path}/corpus"
    manifest = jobs.build_corpus(docs, recipe, folder)["train"]
    import hashlib

    key = lambda d: hashlib.sha256(f"c\0{d}".encode()).hexdigest()[:32]
    stream = [t for _, d, text in sorted(rows, key=lambda r: key(r[1])) for t in [*tokenizer.encode(text).ids, 2]]
    assert manifest["total_tokens"] == len(stream) and manifest["eos_id"] == 2 and manifest["total_docs"] == 40
    for r in jobs.read_corpus(spark, f"{folder}/train", manifest, 16, seed=1).collect():
        g = r.chunk_id * 4 + r.j
        assert r.tokens == stream[g * 16 : g * 16 + 17]
    with pytest.raises(ValueError, match="vocabulary"):
        jobs.Recipe(tokenizer=path, eos=99, vocabulary=53)
    with pytest.raises(ValueError, match="budgets"):
        jobs.Recipe(budgets=(("other", 5),))


def test_a_lease_is_settled_once(spark):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    leases = spark.createDataFrame([("a", 1, "r", at(0)), ("a", 2, "r", at(0)), ("a", 3, "r", at(0))], "origin string, seq long, receiver string, at string").selectExpr("origin", "seq", "receiver", "timestamp(at) ts")
    receipts = spark.createDataFrame([("a", 1, "r", at(5)), ("a", 1, "r", at(2)), ("a", 1, "r", at(9)), ("a", 2, "r", at(40))], "origin string, seq long, receiver string, at string").selectExpr("origin", "seq", "receiver", "timestamp(at) ts")
    out = records.pair_leases_receipts(leases, receipts, "10 seconds").orderBy("seq").collect()
    assert [(r.seq, r.state, r.interval_s) for r in out] == [(1, "settled", 2.0), (2, "expired", None), (3, "expired", None)]


def test_names_and_schemas(spark):
    names = ["chunk-00001.bin", ".bin", "a/b.bin", "..", "x.bin\n", "a.txt"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(scalar.safe_chunk_name(F.col("n"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, False, False]
    assert scalar.schema_hash({"a": "int", "b": "string"}) == scalar.schema_hash({"b": "string", "a": "int"}) != scalar.schema_hash({"a": "int"})
