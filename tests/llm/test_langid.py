import random
import zlib

import pytest
import zstandard

from pyspark.sql import functions as F

from tidemark.llm import langid as L


def test_accuracy_on_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    contents = L.dictionaries(docs.where(~L.held_out()))
    assert set(contents) == {"en", "de", "fr", "es"}
    rows = L.predict(docs, contents).withColumn("held_out", L.held_out()).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 150 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["rejected"] for r in rows) <= 0.02 * len(rows)


def test_labels_of_the_held_out_fold_and_other_columns_do_not_matter(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    other = docs.withColumn("lang", F.when(L.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert L.dictionaries(docs.where(~L.held_out())) == L.dictionaries(other.where(~L.held_out()))


def test_odd_texts(spark):
    contents = {"en": b"the cat sat on the mat and the dog " * 50, "de": b"die katze sitzt auf der matte und der hund " * 50}
    rows = [(1, None), (2, ""), (3, "12 34 ... !"), (4, "THE CAT SAT!!"), (5, "die katze " * 50000), (4, "the cat sat"),
            (None, "der hund und die katze")]
    df = spark.createDataFrame([(*x, "old", 1.5) for x in rows], "doc_id long, text string, lang_pred string, SCORE double")
    got = sorted(((r["doc_id"], r["lang_pred"], r["rejected"]) for r in L.predict(df, contents).collect()), key=repr)
    want = [(1, "und", True), (2, "und", True), (3, "und", True), (4, "en", False), (4, "en", False), (5, "de", False),
            (None, "de", False)]
    assert got == sorted(want, key=repr)
    assert [r["lang_pred"] for r in L.predict(df, {}).collect()] == ["und"] * len(rows)
    assert L.predict(df.limit(0), contents).collect() == [] and L.dictionaries(df.limit(0).withColumn("lang", F.lit("x"))) == {}


def test_narrow_margins_are_rejected(spark):
    same = b"words that both dictionaries hold in the very same order " * 40
    text = "words that both dictionaries hold in the very same order " * 8
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = L.predict(df, {"a": same, "b": same}).collect()[0]
    assert row["rejected"] and row["score"] == 0 and row["lang_pred"] == "a"


def test_accepted_keeps_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit("1 2 3")}))
    kept = L.accepted(extra)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert -1 not in ids and len(ids) >= 0.98 * docs.count()


def test_short_texts_are_judged(spark):
    """Short texts of a language without a dictionary are mostly rejected, of one with it hardly; ties always."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    contents = L.dictionaries(docs.where(~L.held_out()))
    known, other = L.Classifier(contents), L.Classifier({k: v for k, v in contents.items() if k != "de"})
    held = docs.where(L.held_out() & (F.col("lang") == "de")).collect()
    texts = [" ".join(L.folded(r["text"]).split()[5:25]) for r in held]
    texts = [t for t in texts if 60 < len(t) < 200]
    assert len(texts) >= 20
    assert sum(known.predict(t)[2] for t in texts) <= 0.1 * len(texts)
    assert sum(other.predict(t)[2] for t in texts) >= 0.6 * len(texts)
    same = L.Classifier({"a": b"the cat sat on the mat " * 50, "b": b"the cat sat on the mat " * 50})
    assert same.predict("the cat sat")[1:] == (0.0, True)


@pytest.fixture(scope="module")
def held(spark):
    """Dictionaries of the other folds, and folded texts of the held-out fold."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    contents = L.dictionaries(docs.where(~L.held_out()))
    rows = docs.where(L.held_out() & F.col("lang").isNotNull()).collect()
    return contents, [(L.folded(r["text"] or ""), r["lang"]) for r in rows]


@pytest.mark.parametrize("words,rejected,right", [(1, 0.2, 0.85), (2, 0.12, 0.95), (3, 0.05, 0.96), (5, 0.03, 0.97), (20, 0.02, 0.98)])
def test_cuts_of_a_few_words(held, words, rejected, right):
    contents, texts = held
    r, known = random.Random(words), L.Classifier(contents)
    cuts = []
    while len(cuts) < 300:
        text, lang = r.choice(texts)
        found = text.split(" ")
        if len(found) >= words:
            i = r.randrange(len(found) - words + 1)
            cuts.append((" ".join(found[i : i + words]), lang))
    got = [known.predict(t) for t, _ in cuts]
    assert sum(g[2] for g in got) < rejected * len(cuts)
    assert sum(g[0] == lang for g, (_, lang) in zip(got, cuts)) >= right * len(cuts)


def brute(text, contents, margin=L.MARGIN_BYTES):
    """The rule, with the library called anew for every size."""
    letters = L.folded(text or "")
    if not letters or not contents:
        return "und", 0.0, True

    def size(content, frame):
        data = zstandard.ZstdCompressionDict(content + L.TAIL + L.FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=L.LEVEL)
        out = 0
        for i in range(0, len(letters), L.BLOCK):
            own = zstandard.ZstdCompressor(
                level=L.LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            out += len(own.compress(frame + b" " + letters[i : i + L.BLOCK].encode() + b" " + L.TAIL))
        return out

    sizes = [(size(c, L.FRAME), i, lang) for i, (lang, c) in enumerate(contents.items())]
    n = 1
    if sorted(sizes)[0][0] == sorted(sizes)[1][0]:
        n = 1 + len(L.FRAMES)
        sizes = [(s + sum(size(contents[lang], f) for f in L.FRAMES), i, lang) for s, i, lang in sizes]
    (best, _, lang), (second, *_) = sorted(sizes)[:2]
    return lang, (second - best) / second, (second - best) / n < margin * (second / (second + 50 * n)) ** 2


def test_predictions_equal_the_rule(spark, small, held):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    words = [(-1 - i, t.split(" ")[0]) for i, (t, _) in enumerate(held[1][:40])]
    odd = spark.createDataFrame([*words, (-100, None), (-101, "1"), (-102, "a " * 40_000)], docs.schema)
    rows = L.predict(docs.limit(60).unionByName(odd), held[0]).collect()
    assert len(rows) == 103
    for r in rows:
        assert (r["lang_pred"], r["score"], r["rejected"]) == brute(r["text"], held[0])


def test_every_label_is_learned(spark):
    """Long texts teach by a piece of them, and no language is left out."""
    rows = [("long", "ein sehr langer text " * 20_000)] * 2 + [(f"l{i}", f"wort{i} und satz{i} " * 30) for i in range(300)]
    contents = L.dictionaries(spark.createDataFrame(rows, "lang string, text string"))
    assert len(contents) == 301 and all(contents.values()) and len(contents["long"]) > 10_000
    bounded = L.dictionaries(spark.createDataFrame(rows, "lang string, text string"), all_bytes=301 * 1024)
    assert set(bounded) == set(contents) and max(map(len, bounded.values())) <= 2 * 1024


def test_no_margin_rejects_nothing_with_letters():
    same = L.Classifier({"a": b"the cat sat on the mat " * 50, "b": b"the cat sat on the mat " * 50})
    assert same.predict("the cat sat", margin=0) == ("a", 0.0, False)
