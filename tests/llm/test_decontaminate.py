import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import decontaminate as D
from tidemark.llm.tokens import WORD_PATTERN, suffix_array, text_buffer, word_hashes

UPPER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return re.findall(WORD_PATTERN, (text or "").translate(UPPER))


def brute(docs, items, size=10):
    wins = {}
    for key, text in items:
        w = words_of(text)
        if w:
            n = min(size, len(w))
            for i in range(len(w) - n + 1):
                wins.setdefault(tuple(w[i : i + n]), set()).add("" if key is None else str(key))
    widths = {len(w) for w in wins}
    out = []
    for key, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in widths:
            for i in range(len(w) - n + 1):
                if (ids := wins.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def random_case(seed):
    r = random.Random(seed)
    vocabulary = ["a", "b", "C", "é9", "x1"]
    text = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", ",", "\n"]) for _ in range(n))
    items = [(i, text(r.randint(0, 14))) for i in range(6)] + [(None, text(12)), (3, None), (4, "")]
    docs = [(i, text(r.randint(0, 60))) for i in range(20)]
    docs += [(None, items[2][1]), (7, None), (7, ""), (8, docs[0][1]), (8, docs[0][1])]
    docs += [(100 + i, text(5) + " " + (items[i % 7][1] or "") + " " + text(5)) for i in range(10)]
    return docs, items


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("block_chars", [1 << 20, 20])
def test_against_brute_force(spark, seed, block_chars):
    docs, items = random_case(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    found = D.matches(d, i, 5, block_chars=block_chars).mapInArrow(D._digest, D.DIGEST)
    got = sorted((tuple(r)[:6] for r in found.collect()), key=repr)
    assert got == brute(docs, items, 5)


def test_filter_keeps_columns_and_clean_rows(spark):
    docs, items = random_case(9)
    d = spark.createDataFrame([(*x, "e", "i") for x in docs], "doc_id long, text string, `llm:Extra` string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string")
    kept = D.without_contaminated(d, i, 5)
    assert kept.columns == d.columns
    clean = [r for r in brute(docs, items, 5) if not r[5]]
    assert sorted((r[0] for r in kept.collect()), key=repr) == sorted((r[0] for r in clean), key=repr)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(d, i).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [tuple(r)[1:3] for r in D.contamination(one, i).collect()] == [(3, 0)]


def test_suffix_array_and_longest_match():
    r = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        s = np.append(r.integers(0, 3, n - 1), 9)
        order = suffix_array(s)
        assert order.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    texts = ["the cat sat on the mat", "a cat sat on a mat today"]
    shard = D.Shard(*text_buffer(pa.array(texts)))
    queries = D.Queries.of([1], ["my cat sat on a hat"], 3)
    longest, place, _ = shard.search(queries)
    assert longest.tolist() == [0, 4, 3, 2, 1, 0]
    assert shard.row[place[1]] == 1


def test_words_equal_the_pattern():
    texts = ["Ab é-Z9_x", None, "", "日本 x", "a" * 5000, "A.b", "b"]
    _, firsts = word_hashes(*text_buffer(pa.array(texts)))
    assert np.diff(firsts).tolist() == [len(words_of(t)) for t in texts]
