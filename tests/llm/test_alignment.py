"""Alignment of two tokenizers against whole texts encoded plainly."""

import random

import numpy as np
import pytest
from brute import alignments, rows, token_groups

from corpusloom.llm import alignment, queries
from corpusloom.llm.alignment import align_tokenizers, shared_groups
from corpusloom.llm.token_pieces import tokenizer_path

FILES = [tokenizer_path(queries.BYTE_BPE), tokenizer_path(queries.PIECE_BPE)]
KEY = lambda r: tuple((x is not None, x) for x in r)
PARTS = [*"abcdeXYZ  ..,!?'’\n\t\r  0123456789éñ漢字\U0001f600 　\x85\x1c\x00᠎ ​-_/\\<>|", "'s", " the", "<s>", "</s>", "<unk>", "<|endoftext|>", "ing", "   ", "\n\n", "▁", "İ", "ﬁ", "…", "\U0001f469‍\U0001f467"]


@pytest.fixture(scope="module")
def both():
    tok = alignment.tokenizers(*FILES)
    a = lambda t: [(i, tok.a_bytes[i]) for i in tok.a.encode(t, add_special_tokens=False).ids]
    b = lambda t: [(i, tok.b_bytes[i]) for i in tok.b.encode(t)]
    return a, b


def odd_texts(seed, n, longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def check(spark, docs, both, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = sorted(rows(align_tokenizers(df, *FILES, **options)), key=KEY)
    assert found == sorted(alignments(docs, *both), key=KEY)
    return found


def test_groups_of_random_ends():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.choice([1, 2, 5, 50, 400])
        a, b = ([*sorted(rng.sample(range(1, n), rng.randint(0, n - 1))), n] for _ in range(2))
        cuts = sorted(set(a) & set(b))
        found = shared_groups(np.array(a), np.array(b))
        assert [x.tolist() for x in found] == [[side.index(c) + 1 for c in cuts] for side in (a, b)]


def test_no_shared_end_in_a_long_interval():
    a, b = np.append(np.arange(1, 20001, 2), 20002), np.append(np.arange(2, 20001, 2), 20002)
    assert [x.tolist() for x in shared_groups(a, b)] == [[len(a)], [len(b)]]
    late = np.append(b[:-1], [20001, 20002])
    assert [x.tolist() for x in shared_groups(np.append(a[:-1], [20001, 20002]), late)] == [[len(a), len(a) + 1], [len(b), len(b) + 1]]


def test_odd_texts(spark, both):
    texts = [None, "", " ", "  ", "\n", "▁", "a▁b", " a", "a ", *odd_texts(1, 2500), "x" * 100_000, "ab \n" * 30_000, "\U0001f600" * 3000, *["le chat, le chien."] * 200]
    found = check(spark, [(i if i % 9 else None, t) for i, t in enumerate(texts)], both)
    assert sum(r[3] > 0 for r in found) > 2000 and any(r[1:] == (0, 0, 0, 0, 0, 0, "") for r in found)


@pytest.mark.parametrize("hot", [0, 1, 40])
def test_counts_of_pairs_beyond_the_table(spark, both, hot):
    check(spark, [(i, t) for i, t in enumerate([*odd_texts(3, 200), *["of the the", "the of"] * 30])], both, hot=hot)


def test_large_groups_are_counted_by_ids(monkeypatch, both):
    import pyarrow as pa

    texts = odd_texts(4, 300)
    plain = alignment.document_pairs(alignment.align(pa.array(texts), alignment.tokenizers(*FILES), False))
    monkeypatch.setattr(alignment, "LISTED", 1)
    counted = alignment.document_pairs(alignment.align(pa.array(texts), alignment.tokenizers(*FILES), False))
    assert all((x == y).all() for x, y in zip(plain, counted, strict=True))


def test_words_that_are_not_given_back(both):
    """A tokenizer that rewrites a character: texts with it have no tokens."""
    import pyarrow as pa

    class Rewrites(alignment.Tokenizers):
        def encode(self, chunks):
            a, b = super().encode(chunks)
            return a, super().encode([c.replace("q", "k") for c in chunks])[1]

    texts = ["a quick fox", "a fox", "q", "", None, "fox  box"]
    found = alignment.align(pa.array(texts), Rewrites(*FILES), True)
    sums = alignment.document_sums(found.stats, found.codes, found.bounds)
    assert sums[:, 2].tolist() == [0, len(token_groups("a fox", *both)), 0, 0, 0, len(token_groups("fox  box", *both))]


def test_empty_table_and_extra_columns(spark, both, no_docs, clashing, edge_rows):
    assert align_tokenizers(no_docs, *FILES).count() == 0
    wide = clashing.withColumns({"_row": clashing.doc_id, "_pairs": clashing.doc_id})
    assert sorted(rows(align_tokenizers(wide, *FILES))) == sorted(alignments([r[:2] for r in edge_rows], *both))


def test_groups_themselves(spark, both):
    docs = list(enumerate(["", None, "a  b", *odd_texts(5, 50)]))
    found = dict(rows(alignment.token_groups(spark.createDataFrame(docs, "doc_id long, text string"), *FILES)))
    assert {d: [(list(g["a"]), list(g["b"])) for g in v] for d, v in found.items()} == {d: token_groups(t, *both) for d, t in docs}


def test_query(spark, both, small, data_dir):
    docs = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    assert sorted(rows(queries.op12_alignment(spark, data_dir))) == sorted(alignments(docs, *both))
