"""Language identification."""

import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np

from corpusloom.llm import language_id
from corpusloom.llm.language_id import ORDER, Model, identify_language, keep_identified, train


def test_held_out_accuracy(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    out = identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    right = out.where("lang = lang_pred").count()
    assert right >= 0.95 * out.count() > 0


def plain_bits(text, trees):
    total, data = 0.0, bytes(ORDER) + text
    for i in range(ORDER, len(data)):
        for order in range(ORDER, -1, -1):
            seen = trees.get(data[i - order : i])
            if not seen:
                continue
            t, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                total -= math.log2(seen[data[i]] / (t + d))
                break
            total -= math.log2(d / (t + d))
        else:
            total += 8
    return total


def test_code_lengths_match_plain_trees(edge_docs, edge_rows, monkeypatch):
    model = train(edge_docs)
    trees = {x: defaultdict(Counter) for x in model.langs}
    for doc, text, lang, *_ in edge_rows:
        if lang and zlib.crc32(str(doc).encode()) % 5:
            data = bytes(ORDER) + (text or "").encode()
            for i in range(ORDER, len(data)):
                for order in range(ORDER + 1):
                    trees[lang][data[i - order : i]][data[i]] += 1
    texts = [(r[1] or "").encode() for r in edge_rows if len(r[1] or "") < 3000] + [b"\xff\xfe zz Q"]
    want = np.array([[plain_bits(t, trees[x]) for x in model.langs] for t in texts])
    assert np.allclose(model.bits(texts), want, rtol=1e-4)
    monkeypatch.setattr(language_id, "BLOCK", 100)
    assert np.allclose(model.bits(texts), want, rtol=1e-4)


def test_code_lengths_of_odd_starts_and_symbols(spark):
    """Fuzz: few training texts, so that contexts at the start of a text and bytes that no language has are common."""
    rng = random.Random(6)
    for trial in range(12):
        rows = [(i, "".join(rng.choice("abcxyz QÉ") for _ in range(rng.randint(0, 12))), rng.choice(["u", "v", "w"])) for i in range(rng.randint(2, 9))]
        rows.append((100, "a", "u"))
        model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), folds=10**6)
        trees = {x: defaultdict(Counter) for x in model.langs}
        for _, text, lang in rows:
            data = bytes(ORDER) + text.encode()
            for i in range(ORDER, len(data)):
                for order in range(ORDER + 1):
                    trees[lang][data[i - order : i]][data[i]] += 1
        texts = ["".join(rng.choice("abcxyz QÉ\0zé漢") for _ in range(rng.randint(1, 20))).encode() for _ in range(60)]
        want = np.array([[plain_bits(t, trees[x]) for x in model.langs] for t in texts])
        assert np.allclose(model.bits(texts), want, rtol=1e-5, atol=1e-4), trial


def test_foreign_scripts_go(spark):
    rows = [(i, f"the cat sat on the mat and saw {i} birds", "en") for i in range(1, 40)] + [(100, "猫は窓のそばで眠っている鳥を見ていた" * 3, None), (101, "the birds sat on a cat", None), (102, "12 34", None), (103, None, "en"), (104, "Ж", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in keep_identified(df).collect()} == {*range(1, 40), 101, 104}
    # With a model that has seen such texts, they stay.
    more = df.unionByName(spark.createDataFrame([(i, "猫は窓のそばで鳥を見ている" * 2, "ja") for i in range(200, 240)], df.schema))
    assert {r.doc_id for r in keep_identified(more).collect()} >= {*range(1, 40), 100, 101, 104}


def test_long_text(spark):
    """A text of megabytes is scored in blocks, whole."""
    rows = [(1, "one two three four " * 150_000, "en"), (2, "eins zwei drei vier " * 150_000, "de"), (3, "drei vier eins " * 200_000, None)]
    assert {(r.doc_id, r.lang_pred) for r in identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), folds=10**6).collect()} == {(1, "en"), (2, "de"), (3, "de")}


def test_edges(spark, no_docs, clashing, edge_docs, edge_rows):
    assert identify_language(no_docs).count() == 0
    out = identify_language(edge_docs).collect()
    text = {r[0]: r[1] for r in edge_rows}
    assert {r.doc_id for r in out} == set(text) and len(out) == len(text)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or ""))
        assert 0 <= r.score <= 1
    assert set(brute.rows(identify_language(clashing).select(out[0].__fields__))) == set(map(tuple, out))
    unlabelled = spark.createDataFrame([(1, "abc", None), (None, "abc", "en")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in identify_language(unlabelled.where("doc_id = 1")).collect()] == ["und"]
    assert {(r.doc_id, r.held_out) for r in identify_language(unlabelled).collect()} == {(1, False), (None, False)}


def test_hash_table():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 32, 5000, np.uint64))
    table = language_id.HashTable(keys)
    assert np.array_equal(table.find(keys), np.arange(len(keys)))
    other = np.setdiff1d(np.random.default_rng(1).integers(0, 1 << 32, 5000, np.uint64), keys)
    assert (table.find(other) == -1).all()
    assert isinstance(Model().langs, list)
