import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from test_decontaminate import brute as brute_hits
from test_ngram_join import brute as brute_groups
from test_secrets import brute as brute_secrets
from tidemark.session import materialize


@pytest.fixture(scope="module")
def tables(spark, small):
    """The input and what each stage kept."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out.append(materialize(stage(spark, out[-1], small)))
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(tables):
    assert all(t.columns == tables[0].columns for t in tables)


def test_language_keeps_clean_documents(tables):
    assert tables[1].count() >= 0.99 * tables[0].count()
    assert set(texts(tables[1])) <= set(texts(tables[0]))


def test_one_document_of_each_group(tables):
    before = texts(tables[1])
    groups = {d: g for d, g, _ in brute_groups(before)}
    assert sorted(d for d, _ in texts(tables[2])) == sorted(set(groups.values()))


def test_decontamination(spark, small, tables):
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    before = texts(tables[2])
    clean = {r[0] for r in brute_hits(before, items) if not r[5]}
    assert {d for d, _ in texts(tables[3])} == clean


def test_secrets_are_masked(tables):
    before, after = dict(texts(tables[3])), dict(texts(tables[4]))
    assert before.keys() == after.keys()
    for key, text in before.items():
        assert not brute_secrets(after[key])
        if not brute_secrets(text) and "[SECRET]" not in after[key]:
            assert after[key] == text
    changed = [k for k in before if before[k] != after[k]]
    assert changed and sum(bool(brute_secrets(before[k])) for k in changed) >= 0.9 * len(changed)


def test_ids_of_what_is_left(spark, small, tables):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: len(library.encode(t, add_special_tokens=False).ids) for d, t in texts(tables[4])}
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want
