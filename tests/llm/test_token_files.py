import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tidemark.llm import token_files as T

PATH = public_tokenizers.path("word_bpe_49k.json")


def want(rows):
    t = Tokenizer.from_file(PATH)
    ids = [(d, t.encode(x or "", add_special_tokens=False).ids + [2]) for d, x in rows]
    return [(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in ids]


def fuzz(seed, n):
    r = random.Random(seed)
    marks = ["a", "B", "é", "é", "́", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "1", "23", "'s", "'LL", "<|endoftext|>"]
    marks += ["<|startoftext|>", "日本", "Σ", "İ", "ǅ", "!", "?!", "​", "　", "the", "tion", "😀", "İx", "Å", "가"]
    return ["".join(r.choice(marks) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_files_hold_the_library_ids(spark):
    texts = fuzz(1, 300)
    rows = [(random.Random(i).randint(-50, 400), t) for i, t in enumerate(texts)]
    rows += [(None, "null id"), (None, None), (5, None), (6, ""), (7, "same"), (7, "same"), (8, "long " * 30000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, ids int")
    got = sorted((tuple(r) for r in T.round_trip(df, PATH).collect()), key=lambda x: x[1])
    keys = [(g[0] is not None, g[0] or 0) for g in got]
    assert keys == sorted(keys)
    starts = np.cumsum([0] + [g[2] for g in got])
    assert [g[1] for g in got] == starts[:-1].tolist()
    assert sorted(((g[0], *g[2:]) for g in got), key=repr) == sorted(want(rows), key=repr)


def test_bounded_memory_gives_the_same(monkeypatch):
    monkeypatch.setattr(T, "KNOWN_UNITS", 5)
    encoder = T.UnitEncoder(PATH, "<u2", 2)
    t = Tokenizer.from_file(PATH)
    for i in range(200):
        texts = [*fuzz(i, 20), "x" * 300, "a`b ` `", "Word, word. WORD!!! w*** w's x&y don't a-b", "", None]
        texts += ["<|STARTOFTEXT|> <|startoftext|>! J\u030c J. A\u030a \u1fef I\u0307", "a=\u0338 =\u0338 A=\u0338b"]
        ids, sizes = encoder.encode(pa.array(texts))
        got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def test_bases_are_prefix_sums(spark, tmp_path):
    df = spark.range(1000).selectExpr("id as doc_id", "repeat('word ', cast(id % 7 as int)) as text")
    m = T.write(df, str(tmp_path / "set"), PATH, part_bytes=2000)
    assert json.loads((tmp_path / "set" / "manifest.json").read_text()) == m
    total = 0
    for p in m["parts"]:
        assert p["base"] == total
        ids = np.memmap(tmp_path / "set" / f"{p['part']:08d}.bin", m["dtype"], "r")
        assert len(ids) == p["ids"]
        total += p["ids"]
    assert len(m["parts"]) > 3
    assert [r[0] for r in T.read(spark, str(tmp_path / "set")).orderBy("start").collect()] == list(range(1000))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.round_trip(df, PATH).collect() == []
