import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import surrogates as S

ROWS = [
    (1, "Write to Anna.Lee@Mail.example.com or anna.lee@mail.example.com, call +1 (310) 555-4510."),
    (2, "Call 310-555-4510 or (310) 555-4510 or +1 310 555 4511! Host 10.0.0.7, 10.0.0.8."),
    (3, "Card 4111 1111 1111 1111 and 4111111111111111 and 4663617622512349; SSN 078-05-1120."),
    (4, "Mr. John Smith met Mrs. Jane Smith. Frau Jane Doe. Госпожа Анна Иванова. Κυρία Άννα Παππά. MR SMITH. Mr SMITH"),
    (5, "nothing here: 12 34 5.6.7, v2.0. 1 2 3 4 5 6 7 8 9 10 11 12 13, 0641917ea4e9feb9cda83477b57ac2654884f485"),
    (6, None),
    (7, ""),
    (7, ""),
    (None, "IBAN DE89 3704 0044 0532 0130 00 or DE89370400440532013000"),
    (8, "a@b.cc c@b.cc b@b.cc " * 300),
]


@pytest.fixture(scope="module")
def result(spark):
    df = spark.createDataFrame([(*x, "s", 0) for x in ROWS], "doc_id long, text string, source string, n_chars long")
    return df, S.replaced(df, "k1").collect()


def test_formats_and_coreference(result):
    df, rows = result
    assert len(rows) == len(ROWS) and rows[0].asDict().keys() == dict.fromkeys(df.columns).keys()
    got = {r["doc_id"]: r["text"] for r in rows}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    assert (got[5], got[6], got[7]) == (ROWS[4][1], None, "")
    mails = re.findall(r"\S+@[\w.]+", got[1])
    assert mails[0].rstrip(",") == mails[1].rstrip(",") and re.fullmatch(r"[a-z]{4}\.[a-z]{3}@[a-z]{4}\.[a-z]{7}\.example", mails[0])
    phone = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4})\.$", got[1]).groups()
    assert "-".join(phone) != "310-555-4510"
    assert got[2].startswith(f"Call {'-'.join(phone)} or ({phone[0]}) {phone[1]}-{phone[2]} or +1 ")
    hosts = re.findall(r"\d+\.\d+\.\d+\.\d+", got[2])
    assert len(set(hosts)) == 2 and not {"10.0.0.7", "10.0.0.8"} & set(hosts)
    cards = re.match(r"Card (\d{4} \d{4} \d{4} \d{4}) and (\d{16}) and (\d{16}); SSN \d{3}-\d{2}-\d{4}\.$", got[3])
    assert cards[1].replace(" ", "") == cards[2] != cards[3] and luhn(cards[2])
    iban = got[None].split(" or ")
    assert iban[0].removeprefix("IBAN ").replace(" ", "") == iban[1] and iban[1].startswith("DE")


def luhn(number):
    d = [int(c) for c in reversed(number)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def test_names_keep_gender_script_and_person(result):
    text = {r["doc_id"]: r["text"] for r in result[1]}[4]
    m = re.match(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+)\. Frau (\w+) (\w+)\. Госпожа (\w+) (\w+)\. Κυρία (\w+) (\w+)\. ", text)
    john, smith, jane, smith2, jane2, doe, anna, ivanova, greek, _ = m.groups()
    assert smith == smith2 and jane == jane2 and len({john, jane, smith, doe}) == 4
    ends = S.SYLLABLES["latin"][1]
    assert any(john.lower().endswith(e) for e in ends["given_m"]) and any(jane.lower().endswith(e) for e in ends["given_f"])
    assert re.fullmatch("[А-Яа-я]+", anna + ivanova) and re.fullmatch("[Ͱ-Ͽ]+", greek)
    assert text.endswith(f"Mr {smith.upper()}")


def test_no_two_entities_share_a_surrogate(spark):
    # All letters of one place: fewer values than rounds of luck would need.
    rows = [("email", f"{a}@b.cc") for a in "abcdefghijklmnopqrstuvwxyz"] + [("ip", f"1.1.1.{i}") for i in range(10)]
    rows += [("given_m_latin", f"name{i}") for i in range(400)] + [("ssn", "123456789")]
    df = spark.createDataFrame(rows, "kind string, canon string")
    got = S.assign(df, "k").collect()
    assert sorted((r["kind"], r["canon"]) for r in got) == sorted(rows)
    made = {(r["kind"], r["surrogate"]) for r in got}
    assert len(made) == len(rows) and not made & set(rows)
    again = {(r["kind"], r["canon"], r["surrogate"]) for r in S.assign(df, "k").collect()}
    assert again == {(r["kind"], r["canon"], r["surrogate"]) for r in got}
    other = {(r["kind"], r["surrogate"]) for r in S.assign(df, "other").collect()}
    assert len(other & made) < len(rows) // 2


def test_test_data_loses_its_entities(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    old = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = S.replaced(docs, counts=True).collect()
    assert len(rows) == len(old)
    pattern = re.compile(r"[\w.]+@\w+(?:\.\w+)+|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d)", re.A)
    total = 0
    for r in rows:
        found = pattern.findall(old[r["doc_id"]])
        total += len(found)
        assert not any(x in r["text"] for x in found)
        n = sum(r[f"n_{k}"] for k in S.KINDS)
        assert n >= len(found) and (n > 0 or r["text"] == old[r["doc_id"]])
        assert pattern.sub("#", r["text"]) == pattern.sub("#", old[r["doc_id"]]) or n > len(found)
    assert total > 10


def test_numbers_of_two_countries_stay_two(spark):
    text = "Call +44 20 7946 0958 or (207) 946-0958, +1 207 946 0958. Also +49 30 1234, +49 (30) 1235 and +358 40 1234."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = S.replaced(df, "k").first().text
    m = re.fullmatch(
        r"Call \+44 (\d\d \d{4} \d{4}) or \((\d{3})\) (\d{3})-(\d{4}), \+1 (\d{3}) (\d{3}) (\d{4})\. "
        r"Also \+49 (\d\d \d{4}), \+49 \((\d\d)\) (\d{4}) and \+358 \d\d \d{4}\.",
        got,
    )
    assert m and m.groups()[1:4] == m.groups()[4:7] and m[1].replace(" ", "")[-10:] != "".join(m.groups()[1:4])
    assert m[8] != f"{m[9]} {m[10]}" and "7946" not in got


def test_names_are_found_again_without_a_title(spark):
    text = "Mr John Smith came. John Smith left, Smith's car too; JOHN. Blacksmith Johnson. Dr Ann O'Brien and Herr Prof. Dr. Kant! O'Brien’s, Kant."
    df = spark.createDataFrame([(1, text), (2, "John Smith")], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in S.replaced(df, "k").collect()}
    m = re.fullmatch(
        r"Mr (\w+) (\w+) came\. (\w+) (\w+) left, (\w+)'s car too; (\w+)\. Blacksmith Johnson\. "
        r"Dr (\w+) (\w+) and Herr Prof\. Dr\. (\w+)! (\w+)’s, (\w+)\.",
        rows[1],
    )
    john, smith, john2, smith2, smith3, upper, ann, brien, kant, brien2, kant2 = m.groups()
    assert john == john2 and upper == john.upper() and smith == smith2 == smith3 and brien == brien2 and kant == kant2
    assert len({"John", "Smith", "Ann", "Kant", john, smith, ann, brien, kant}) == 9
    assert rows[2] == "John Smith"


def test_short_numbers_get_longer_when_all_are_taken(spark):
    rows = [("phone", f"+35840{i:02d}") for i in range(100)] + [("phone", f"+358{i}0{j}{k}") for i in range(10) for j in range(10) for k in range(10)]
    df = spark.createDataFrame(rows, "kind string, canon string").distinct()
    got = S.assign(df, "k").collect()
    assert len({r.surrogate for r in got}) == len(got) == df.count()
    assert all(r.surrogate.startswith("+358") for r in got) and not {r.surrogate for r in got} & {r.canon for r in got}
    shown = S.written(F.lit("phone"), F.lit("+358 40 12"), F.lit("+358771234"), F.lit("+3584012"))
    assert spark.range(1).select(shown).first()[0] == "+358 77 1234"


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.replaced(df).collect() == []
    odd = spark.createDataFrame([(1, "x 10.1.2.3", 5, "p")], "doc_id long, text string, N_IP int, pieces string")
    row = S.replaced(odd, counts=True).collect()[0]
    assert row["n_ip"] == 1 and row["pieces"] == "p"
