import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment as A

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def by():
    return A.TwoEncoders(*PATHS)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def tokens(text, libraries, by):
    """Ids and byte ranges of both libraries' tokens of the whole text."""
    if not text:
        return [], []
    a, b = libraries
    whole, out = f" {text}".encode(), []
    for ids, of in ((a.encode(f" {text}", add_special_tokens=False).ids, by.bytes_a), (b.encode(text), by.bytes_b)):
        if b"".join(of[i] for i in ids) != whole:
            return [], []
        ends = np.cumsum([len(of[i]) for i in ids]).tolist()
        out.append(list(zip(ids, [0, *ends[:-1]], ends)))
    return out


def brute(texts, libraries, by):
    """The contract, token by token."""
    rows, count = [], Counter()
    for text in texts:
        a, b = tokens(text, libraries, by)
        links = []
        for i, s, e in a:
            links += [(i, j) for j, t, f in b if s < f and t < e]
        count.update(links)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [
            "|".join(",".join(str(i) for i, _, e in side if low < e <= high) for side in (a, b))
            for low, high in zip([0, *cuts[:-1]], cuts)
        ]
        rows.append((len(a), len(b), len(cuts), links, ";".join(groups)))
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [
        (na, nb, ng, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
         hashlib.sha256(g.encode()).hexdigest() if g else "")
        for na, nb, ng, links, g in rows
    ]


def fuzz(seed, n, length=50):
    r = random.Random(seed)
    marks = list("aaabcdeé tT\n\r\t'\"!.,0123$%&ñß") + ["  ", "\n\n", "\x1c", "\x85", "\xa0", "'s", "日本", "😀", "́"]
    marks += ["the", "ing", "    ", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "　", "​", "\x00", "ﬁ", " "]
    marks += [" ", " ", " \n ", "\n ", " word", "  "] + ["▁"] * (seed % 2)
    return ["".join(r.choice(marks) for _ in range(r.randint(0, length))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_tokens_equal_the_libraries(by, libraries, seed):
    assert by.by_units
    texts = fuzz(seed, 600) + [" ", "  ", "\n", "word " * 5, None]
    found = A.Aligned(pa.array(texts, pa.string()), by)
    for i, text in enumerate(texts):
        a, b = tokens(text, libraries, by)
        assert found.a[found.a_cuts[i] : found.a_cuts[i + 1]].tolist() == [t[0] for t in a], repr(text)
        assert found.b[found.b_cuts[i] : found.b_cuts[i + 1]].tolist() == [t[0] for t in b], repr(text)
        assert found.group_counts()[i] == len({t[2] for t in a} & {t[2] for t in b})


def test_whole_texts_without_proof(libraries):
    by = A.TwoEncoders(*PATHS)
    by.by_units, by.by_rank = False, None
    texts = fuzz(9, 50)
    found = A.Aligned(pa.array(texts), by)
    assert found.a.tolist() == [t[0] for x in texts for t in tokens(x, libraries, by)[0]]


def test_equal_hashes_of_different_units(by, monkeypatch):
    want = A.TwoEncoders(*PATHS).encode(pa.array(["one two  three one", "two"]))
    other = A.TwoEncoders(*PATHS)
    monkeypatch.setattr(A, "slice_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    got = other.encode(pa.array(["one two  three one", "two"]))
    assert all((x == y).all() for x, y in zip(got, want))


def random_ends(r, n, share):
    ends = np.cumsum([r.randint(1, 5) for _ in range(n)])
    other = sorted({*(e for e in ends.tolist() if r.random() < share), int(ends[-1]), *(r.randint(1, int(ends[-1])) for _ in range(n // 2))})
    return ends, np.array(other)


@pytest.mark.parametrize("share", [0, 0.01, 0.5, 1])
@pytest.mark.parametrize("small", [1, 4, 32])
def test_shared_groups(share, small):
    r = random.Random(4)
    for n in (1, 2, 3, 50, 3000):
        a, b = random_ends(r, n, share)
        last_a, last_b = A.shared_groups(a, b, np.array([0, 0, len(a)]), np.array([0, 0, len(b)]), small)
        want = np.intersect1d(a, b)
        assert a[last_a].tolist() == b[last_b].tolist() == want.tolist()


def test_no_shared_cut_in_a_long_text():
    a, b = np.arange(2, 400_002, 2), np.append(np.arange(1, 399_999, 2), 400_000)
    last_a, last_b = A.shared_groups(a, b, np.array([0, len(a)]), np.array([0, len(b)]))
    assert (last_a.tolist(), last_b.tolist()) == ([len(a) - 1], [len(b) - 1])


@pytest.mark.parametrize("head", [0, 40, 1 << 20])
def test_report(spark, by, libraries, head):
    texts = fuzz(3, 60) + [None, "", "▁", "the same text", "the same text", "word " * 20000, "x" * 20000]
    small = [t for t in texts if not t or len(t) < 10_000]
    rows = [(i if i else None, t, 7, "old") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int, pairs string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in A.report(df, *PATHS, head_pairs=head).collect()}
    assert len(got) == len(texts)
    want = brute(small, libraries, by)
    only = spark.createDataFrame([r for r in rows if not r[1] or len(r[1]) < 10_000], df.schema)
    of_small = {r["doc_id"]: tuple(r)[1:] for r in A.report(only, *PATHS, head_pairs=head).collect()}
    for (i, *_), w in zip([r for r in rows if not r[1] or len(r[1]) < 10_000], want):
        na, nb, ng, nl, best, total, digest = w
        assert of_small[i] == (na, nb, ng, nl, best, total, digest)
        assert got[i][:4] == (na, nb, ng, nl)
    assert A.report(df.limit(0), *PATHS).collect() == []


def test_documents_of_the_test_data(spark, small, by, libraries):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if len(r["text"] or "") < 4000)
    ids = [r[0] for r in rows]
    got = A.report(docs.where(docs.doc_id.isin(ids)), *PATHS).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute([r[1] for r in rows], libraries, by)
