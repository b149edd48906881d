import hashlib
import random

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    return B.Bpe(PATH)


def fuzz(seed, n, length=60):
    r = random.Random(seed)
    marks = list("aaabcdeé tT\n\r\t'\"!.,0123$%&ñß") + ["  ", "\n\n", "\x1c", "\x85", " ", "'s", "'ll", "日本", "😀", "́"]
    marks += ["the", "ing", "tion", "    ", "aaaa", "<|endoftext|>", "　", "​", "\x00", "ﬁ", "²", "Ⅷ", "٣"]
    return ["".join(r.choice(marks) for _ in range(r.randint(0, length))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(5))
def test_ids_equal_the_library(bpe, seed):
    for text in fuzz(seed, 400):
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text) == want, text
        assert bpe.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


def test_random_letters_and_long_pieces(bpe):
    r = random.Random(5)
    for n in (1, 10, 1000, 30000):
        for letters in ("ab", "a", "abcdefghijklmnopqrstuvwxyz", "=-", "é"):
            text = "".join(r.choice(letters) for _ in range(n))
            assert bpe.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_documents_of_the_test_data(bpe):
    texts = duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    for (text,) in texts:
        assert bpe.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_digests_and_ids(spark, monkeypatch):
    monkeypatch.setattr(B, "KNOWN_PIECES", 20)
    rows = list(enumerate(fuzz(7, 50))) + [(None, None), (3, ""), (3, ""), (9, "word " * 20000)]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, n_tokens int")

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    want = []
    for d, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    got = [tuple(r) for r in B.digests(df, PATH).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    with_ids = B.encode(df, PATH)
    assert with_ids.columns == [*df.columns, "ids"]
    assert sorted((r["ids"] for r in with_ids.collect()), key=len)[-1] == LIBRARY.encode("word " * 20000).ids
    assert B.digests(df.limit(0), PATH).collect() == []
