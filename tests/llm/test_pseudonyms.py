"""Pseudonyms: validity, permutation, round trips and adversarial texts."""

import random

import pytest
from pyspark.sql import functions as F

from citeflow.llm import pii

DOCS = "doc_id long, text string"


def luhn(text):
    d = [int(c) for c in text if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def valid_iban(text):
    x = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def both_ways(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), DOCS)
    there = pii.pseudonymise(frame, "k")
    new = [r.text for r in there.orderBy("doc_id").collect()]
    back = [r.text for r in pii.pseudonymise(there, "k", inverse=True).orderBy("doc_id").collect()]
    assert back == texts
    return new


def test_national_numbers_stay_valid(spark):
    rng = random.Random(2)
    good = lambda t: t[:3] not in ("000", "666") and t[0] != "9" and t[4:6] != "00" and t[7:] != "0000"
    texts = list({f"{rng.randrange(1000):03}-{rng.choice([0, rng.randrange(100)]):02}-{rng.choice([0, rng.randrange(10000)]):04}" for _ in range(3000)})
    new = both_ways(spark, texts)
    assert len(set(new)) == len(texts) and [good(t) for t in new] == [good(t) for t in texts]
    assert sum(a == b for a, b in zip(texts, new)) < 40


def test_phones_keep_their_leads(spark):
    rng = random.Random(3)
    texts = [f"{rng.choice(['+1 ', '+49-', ''])}{rng.randrange(200, 1000)}-{rng.randrange(200, 1000)}-{rng.randrange(10000):04}" for _ in range(500)] + ["+4912345678901"[:13], "+1 (988) 555-2485"]
    for old, new in zip(texts, both_ways(spark, texts)):
        assert new != old and [c.isdigit() for c in new] == [c.isdigit() for c in old]
        assert old[0] != "+" or new[:2] == old[:2]
        digits = [c for c in new if c.isdigit()][-10:]
        assert old.startswith("+4912") or digits[0] > "1" and digits[3] > "1"


def test_cards_beside_other_numbers(spark):
    rng, texts = random.Random(4), []
    while len(texts) < 300:
        body = "".join(rng.choices("0123456789", k=15))
        card = next(body + c for c in "0123456789" if luhn(body + c))
        texts.append(f"{card} {rng.randrange(100, 1000)}" if len(texts) % 2 else f"{rng.randrange(10, 100)}-{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}")
    new = both_ways(spark, texts)
    assert all(a != b for a, b in zip(texts, new))
    for old, t in zip(texts, new):
        assert [len(x) for x in old.split(" ")] == [len(x) for x in t.split(" ")]
    plain = [(old, t) for old, t in zip(texts[1::2], new[1::2]) if not luhn(old)]
    assert len(plain) > 100 and all(luhn(t.split(" ")[0]) and t.split(" ")[1] == old.split(" ")[1] for old, t in plain)


def test_account_numbers(spark):
    texts = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR14 2004 1010 0505 0001 3M02 606", "GB82 WEST 1234 5698 7654 33"]
    new = both_ways(spark, texts)
    assert all(valid_iban(t) and t != o and t[:2] == o[:2] for o, t in zip(texts[:3], new)) and new[3] == texts[3]


def test_dates_in_a_row_of_numbers(spark):
    new = both_ways(spark, ["5 2023-01-05 1999-12-31"])
    assert "2023-01-05" not in new[0] and "1999-12-31" not in new[0]


@pytest.mark.parametrize("unit", [".b", "1", "1 ", "1-", "1.", "a@", "a.", "+1", "A1", "AB12 ", "password=", "AKIA", "1/", "(1) "])
def test_adversarial_texts(spark, unit):
    text = "x a@b" + unit * (1_000_000 // len(unit))
    assert len(pii.pseudonymise(spark.createDataFrame([(1, text), (2, None), (3, "")], DOCS), "k", found="n").where(F.col("doc_id") == 1).first().text) == len(text)


def test_key_is_a_setting(spark):
    assert pii.key_of(spark) == pii.TEST_KEY
    spark.conf.set(pii.KEY_SETTING, "other")
    try:
        assert pii.key_of(spark) == "other"
    finally:
        spark.conf.unset(pii.KEY_SETTING)
