"""Token counts, packing, WARC and substring dedup."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import substring_dedup, warc
from corpusloom.llm.packing import pack_documents, plan_best_fit
from corpusloom.llm.substring_dedup import FingerprintIndex, remove_repeated_substrings, removed_windows, without_removed
from corpusloom.llm.token_counts import at_limits, length_histogram, quantiles
from corpusloom.llm.token_pieces import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def test_word_encoding_equals_whole_text(edge_rows, encode, small):
    from corpusloom.llm.token_pieces import encoder

    odd = ["İstanbul ΣΑΣ ΟΔΟΣ ΑΣ'Σ", "don't <|endoftext|>x <|startoftext|> it's", "é ́x a ́", " a b\x1cc\x85d", "ﬁ K Å 한국어", "a" * 300]
    texts = [None, *(r[1] for r in edge_rows), *odd, *(r[0] for r in small.select("text").collect())]
    batch = pa.record_batch([pa.array(texts, pa.string())], names=["t"])
    got = [ids[a:b].tolist() for _, ids, bounds in encoder(PATH).batches(batch, 0) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [encode(t) for t in texts]


def test_word_encoding_of_odd_letters(encode):
    """10000 texts over letters that change when normalised, marks that combine, apostrophes, digits and special tokens."""
    from corpusloom.llm.token_pieces import encoder

    rng = random.Random(8)
    alphabet = [*"aBıİiI.,-'!19 sStT", "\u0307", "\u0301", "\u0345", "é", "É", "ß", "ẞ", "Σ", "σ", "ς", "Å", "ŉ", "ﬁ", "한", "漢", "א", "\u0660", "²", "Ⅷ", "ª", "ʰ", "😀", "\x1c", "\x85", "\u200d", "<|endoftext|>", "<|", "|>", "'ll", "'S", "ǅ", "\ua7cb", "\u1c89"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(10_000)]
    batch = pa.record_batch([pa.array(texts, pa.string())], names=["t"])
    got = [ids[a:b].tolist() for _, ids, bounds in encoder(PATH).batches(batch, 0) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert [t for t, g in zip(texts, got, strict=True) if g != encode(t)] == []


def test_histogram(edge_docs, edge_rows, encode, no_docs, clashing):
    lengths = [len(encode(r[1])) for r in edge_rows]
    out = length_histogram(edge_docs, PATH)
    got = out.collect()
    assert {r.length: r.n_docs for r in got} == dict(Counter(lengths))
    for r in got:
        assert r.total_docs == len(lengths) and r.total_tokens == sum(lengths)
        assert r.truncated_tokens == sum(min(x, r.length) for x in lengths)
        assert r.docs_over == sum(x > r.length for x in lengths)
        assert r.tokens_upto == sum(x for x in lengths if x <= r.length)
    limits = at_limits(out, [0, 1, 37, 10**6]).collect()
    assert all(r.truncated_tokens == sum(min(x, r.context_limit) for x in lengths) for r in limits) and len(limits) == 4
    for r in quantiles(out, [0.1, 0.5, 1.0]).collect():
        assert r.length == sorted(lengths)[int(np.ceil(r.share * len(lengths) - 1e-9)) - 1]
    assert length_histogram(no_docs, PATH).count() == 0
    assert set(brute.rows(length_histogram(clashing, PATH))) == set(map(tuple, got))


def check_packing(out, docs, encode, capacity):
    want = {}
    for doc, text in docs:
        ids = np.array([*encode(text), 0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[doc, k] = (at, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [2048, 64, 1])
def test_packing(edge_docs, edge_rows, encode, capacity):
    docs = [r[:2] for r in edge_rows if capacity > 1 or len(r[1] or "") < 500]
    frame = edge_docs if capacity > 1 else edge_docs.where("length(coalesce(text, '')) < 500")
    used = check_packing(pack_documents(frame, PATH, capacity).collect(), docs, encode, capacity)
    lengths = [n for _, t in docs for n in [len(encode(t)) + 1]]
    pieces = [capacity] * sum(n // capacity for n in lengths) + [n % capacity for n in lengths if n % capacity]
    assert used <= 1.02 * best_fit(pieces, capacity) + 1


def best_fit(pieces, capacity):
    rooms = []
    for n in sorted(pieces, reverse=True):
        fit = [r for r in rooms if r >= n]
        room = min(fit) if fit else capacity
        if fit:
            rooms.remove(room)
        rooms.append(room - n)
    return len(rooms)


def test_plan_equals_best_fit_on_items():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice([10, 37, 2048])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
        runs = plan_best_fit(Counter(items), capacity)
        fill, ranks = Counter(), defaultdict(list)
        for length, lo, n, first, each, _ in runs:
            for j in range(n):
                fill[first + j // each] += length
                ranks[length].append(lo + j)
        assert all(x <= capacity for x in fill.values())
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in Counter(items).items()}
        assert len(fill) == best_fit(items, capacity)


def test_packing_edges(spark, no_docs, clashing, edge_docs):
    assert pack_documents(no_docs, PATH).count() == 0
    assert pack_documents(clashing, PATH).count() == pack_documents(edge_docs, PATH).count()
    odd = spark.createDataFrame([(None, None), (None, "a"), (2, "a b"), (2, "a b")], "doc_id long, text string")
    out = pack_documents(odd, PATH, keep_ids=True).collect()
    assert len(out) == 4 and len({(r.sequence_id, r.offset) for r in out}) == 4
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in out)


def pages_result(pages):
    same = defaultdict(list)
    for page, html in pages:
        same[(html or "").encode()].append(page)
    out = set()
    for page, html in pages:
        data = (html or "").encode()
        again = len(data) >= 1000 and max(same[data]) != page
        out.add((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same[data]) if again else None))
    return out


def test_warc(spark, data_dir):
    rng = random.Random(3)
    big = "".join(rng.choice("abc\r\n é") for _ in range(400_000))
    rows = [(i, f"http://h/{i}\r\nX: y é", h) for i, h in enumerate([None, "", "a", big, big, big, "b" * 999, "b" * 999, "c" * 1000, "c" * 1000, "WARC/1.1\r\n\r\n" * 100, "é" * 500, "é" * 500])]
    rows += [(100, None, "c" * 1000)]
    out = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), chunk_bytes=1000)
    assert set(brute.rows(out.drop("chunks"))) == pages_result([(r[0], r[2]) for r in rows])
    pages = spark.read.parquet(f"{data_dir}/pages.parquet")
    assert set(brute.rows(warc.archive_pages(pages).drop("chunks"))) == pages_result(brute.rows(pages.select("page_id", "html")))


def test_warc_edges(spark):
    schema = "page_id long, url string, html string, digest string, size string, _kept int"
    assert warc.archive_pages(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, "x" * 2000, "q", "r", 1), (7, "u", "x" * 2000, "q", "r", 1), (7, "u", "x" * 2000, "q", "r", 1), (None, None, "y" * 2000, None, None, None)]
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.archive_pages(spark.createDataFrame(rows, schema)).collect())
    assert got == [("7", "response", None), ("7", "response", None), ("None", "response", None), ("None", "revisit", 7)]


def test_warc_chunks_carry_running_digests(spark, tmp_path):
    data = bytes(range(256)) * 40
    text = data.decode("latin-1")
    payload = text.encode()
    head = warc.record_head(5, "http://x/", "response", None, hashlib.sha1(payload).hexdigest(), len(payload))
    archive = gzip.compress(head + payload + b"\r\n\r\n") + gzip.compress(warc.record_head(6, None, "revisit", 5, hashlib.sha1(payload).hexdigest(), len(payload)) + b"\r\n\r\n")
    rows = list(warc.record_chunks([archive[i : i + 7] for i in range(0, len(archive), 7)], 1000))
    assert b"".join(r[-1] for r in rows[:-1]) == payload
    for r in rows[:-1]:
        assert r[7] == hashlib.sha1(payload[: r[6]]).hexdigest() and len(r[-1]) <= 1000
    assert rows[-1][:5] == (6, 0, "revisit", 5, len(payload))
    assert base64.b32encode(hashlib.sha1(payload).digest()).decode().encode() in head
    broken = gzip.compress(head + payload[:-1] + b"?" + b"\r\n\r\n")
    with pytest.raises(ValueError, match="differs"):
        list(warc.record_chunks([broken], 1000))


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_substrings_match_brute_force(edge_docs, edge_rows, small, batches, monkeypatch):
    assert set(brute.rows(remove_repeated_substrings(edge_docs, batches))) == brute.substrings([r[:2] for r in edge_rows])
    if batches == 2:
        assert set(brute.rows(remove_repeated_substrings(small))) == brute.substrings(brute.rows(small.select("doc_id", "text")))


def test_compaction_keeps_results(spark, edge_docs, edge_rows):
    index = FingerprintIndex(spark, max_runs=1, buckets=3)
    slim = edge_docs.select("doc_id", "text")
    for low in range(0, 400, 50):
        index.add_batch(slim.where(f"doc_id >= {low} and doc_id < {low + 50}"))
    assert len(index.runs) == 1 and len(index.batches) == 8
    got = without_removed(slim, removed_windows(slim, index))
    assert set(brute.rows(got)) == brute.substrings([r[:2] for r in edge_rows])


def test_small_chunks_and_caches(edge_rows, monkeypatch):
    """Hashes do not depend on what is hashed together."""
    monkeypatch.setattr(substring_dedup, "CACHE", 50)
    words = [(r[1] or "").encode().split() for r in edge_rows]
    whole = substring_dedup.Words(words, substring_dedup.WordHash()).spans()
    parts = [p for p in (substring_dedup.Words([w], substring_dedup.WordHash()).spans() for w in words) if len(p[0])]
    assert np.array_equal(whole[0], np.concatenate([p[0] for p in parts]).astype(whole[0].dtype))
    assert np.array_equal(whole[1], np.concatenate([p[1] for p in parts]).astype(whole[1].dtype))


def test_substring_edges(spark, no_docs, clashing, edge_docs):
    assert remove_repeated_substrings(no_docs).count() == 0
    assert set(brute.rows(remove_repeated_substrings(clashing))) == set(brute.rows(remove_repeated_substrings(edge_docs)))
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (4, text), (4, text), (9, f"q {text}"), (None, None)]
    out = remove_repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in out) == [("4", 30, 0), ("4", 30, 0), ("9", 31, 30), ("None", 0, 0), ("None", 30, 0)]
    assert {r.kept_text for r in out if r.doc_id == 9} == {"q"}
