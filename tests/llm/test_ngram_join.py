import random

import pytest

from test_decontaminate import words_of
from tidemark.llm import ngram_join as J


def grams(text, n=5):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n, 0) + 1)} if w else set()


def brute(rows, similarity=0.8):
    """(doc_id, least id of the group, links) by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    linked = [[False] * len(rows) for _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= similarity * len(a | b) - 1e-9:
                linked[i][j] = linked[j][i] = True
                root[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    least = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return sorted(((rows[i][0], least[find(i)], sum(linked[i])) for i in range(len(rows))), key=repr)


def near_copies(seed, n_groups=8):
    r = random.Random(seed)
    text = lambda n: [f"w{r.randint(0, 400)}" for _ in range(n)]
    rows = []
    for _ in range(n_groups):
        base = text(r.choice([6, 40, 120, 400]))
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 60))):
                copy[r.randrange(len(copy))] = "edit%d" % r.randint(0, 9)
            rows.append(" ".join(copy))
    rows += [rows[0].upper(), rows[0], None, "", "", "...", "one two", "one two", "three"]
    r.shuffle(rows)
    return list(enumerate(rows)) + [(3, rows[3]), (None, rows[5]), (None, "lonely words of nobody here")]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("tile, grams", [(2, 400_000), (384, 200), (384, 400_000)])
def test_groups_and_links_against_all_pairs(spark, monkeypatch, seed, tile, grams):
    monkeypatch.setattr(J, "TILE", tile)
    monkeypatch.setattr(J, "TILE_GRAMS", grams)
    rows = near_copies(seed)
    df = spark.createDataFrame([(*x, b"") for x in rows], "doc_id long, text string, class binary")
    got = sorted((tuple(r) for r in J.classify(df).collect()), key=repr)
    assert got == brute(rows)


def test_one_document_of_each_group_stays(spark):
    rows = near_copies(5)
    df = spark.createDataFrame([(*x, "k", 2) for x in rows], "doc_id long, text string, key string, band int")
    kept = J.one_of_each(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {g for (_, t), (_, g, _) in zip(rows, [None] * 0)}  # groups are read from the join itself
    groups = {(r["class_id"], r["doc_id"]) for r in J.classify(df).collect()}
    with_words = {d for d, t in rows if words_of(t)}
    want = {g for g, d in groups if d in with_words}
    alone = [d for d, t in rows if not words_of(t)]
    assert sorted(ids, key=repr) == sorted([*want, *alone], key=repr)


def test_empty_and_lonely_tables(spark):
    schema = "doc_id long, text string"
    assert J.classify(spark.createDataFrame([], schema)).collect() == []
    one = spark.createDataFrame([(5, "just these few words here today"), (6, None)], schema)
    assert sorted(tuple(r) for r in J.classify(one).collect()) == [(5, 5, 0), (6, 6, 0)]
    assert J.one_of_each(one).count() == 2


def test_chain_of_links_is_one_group(spark):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)], "a binary, b binary")
    got = J.connected(edges).collect()
    assert len(got) == 41 and {bytes(r["group"]) for r in got} == {b"\0"}


def test_bands_reach_the_recall():
    for similarity, recall in ((0.8, 0.9995), (0.5, 0.9), (0.95, 0.99), (1.0, 0.9)):
        bands, rows = J.bands_for(similarity, recall)
        assert 1 - (1 - similarity**rows) ** bands >= recall
