"""The pipeline, stage by stage against brute force, and the driver's entry."""

import zlib
from collections import Counter, defaultdict

import brute
import numpy as np

import corpus_pipeline
from test_language import plain_bits

from corpusloom.llm.language_id import ORDER
from corpusloom.llm.mixing import mix_sources, mixed_documents


def test_stages(spark, data_dir, tmp_path):
    from tokenizers import Tokenizer

    from corpusloom.llm.token_pieces import tokenizer_path

    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, data_dir).write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
        was = {r.doc_id: r.text for r in before.collect()}
        if name == "language_id":
            trees = defaultdict(lambda: defaultdict(Counter))
            for r in before.collect():
                if r.lang and zlib.crc32(str(r.doc_id).encode()) % 5:
                    data = bytes(ORDER) + (r.text or "").encode()
                    for i in range(ORDER, len(data)):
                        for order in range(ORDER + 1):
                            trees[r.lang][data[i - order : i]][data[i]] += 1
            fits = {d for d, t in was.items() if any(c.isalpha() for c in t or "") and min(plain_bits(t.encode(), x) for x in trees.values()) <= 8 * len(t.encode()) + 64}
            assert {r.doc_id for r in docs.collect()} == fits
        elif name == "exact_dedup":
            assert {r.doc_id for r in docs.collect()} == {r[0] for r in brute.exact(was.items()) if r[3]}
        elif name == "near_dedup":
            assert {r.doc_id for r in docs.collect()} == {r[0] for r in brute.near(was.items(), 5) if r[3]}
        elif name == "mixing":
            taken = {r.doc_id: r.taken for r in mix_sources(before).collect()}
            got = defaultdict(int)
            for r in docs.collect():
                got[r.doc_id] += len(brute.words(r.text))
                assert brute.words(r.text) == brute.words(was[r.doc_id])[: len(brute.words(r.text))]
            assert dict(got) == {d: n for d, n in taken.items() if n}
    encode = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode
    want = Counter()
    for r in kept["mixing"].collect():
        ids = np.array([*encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        want.update((r.doc_id, k, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048)))
    out = kept["packing"].collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in out) == want
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
    assert corpus_pipeline.run(spark, data_dir).count() == len(out)


def test_stages_on_edges(spark, edge_docs, no_docs, clashing, data_dir):
    from pyspark.sql import functions as F

    odd = clashing.withColumns({n: F.lit("y") for n in ("lang_pred", "score", "row", "body", "_kept_id", "_taken", "_words", "_copy", "_tid")})
    sizes = []
    for docs in (edge_docs, odd, no_docs):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data_dir)
            assert name == "packing" or docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] == sizes[1] > 0 == sizes[2]


def test_repeated_ids_in_a_mix(spark):
    rows = [(1, "a b c d", "s"), (1, "a b c d", "s"), (2, "e f", "s"), (None, "g h i", "s"), (3, None, "t")]
    out = mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sum(len(r.text.split()) for r in out) in range(17, 20)


def test_entry_lists_all_queries():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {x.split("_")[0] + "_" for x in names if x.startswith("op") and x[2].isdigit()}
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= names
