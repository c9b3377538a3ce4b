import random
import re

from portcullis.llm import pii as P

KEY = b"k1"


def card(rng, n=16):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return body + str(P.luhn(body))


def test_permutation_is_a_bijection():
    for size in (1, 2, 3, 10, 97, 1000):
        got = [P.permute(KEY, "x", v, size) for v in range(size)]
        assert sorted(got) == list(range(size))
        assert [P.permute(KEY, "x", g, size, back=True) for g in got] == list(range(size))


def test_formats_stay_valid_linked_and_invertible():
    rng = random.Random(5)
    for _ in range(200):
        c = card(rng)
        values = {
            "email": f"{rng.choice(['Ann.Lee', 'b_77', 'x'])}.{rng.randint(10, 99)}@host{rng.randint(1, 9)}.example.org",
            "card": c, "ip": ".".join(str(rng.randint(0, 255)) for _ in range(4)),
            "ssn": f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
            "phone": f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
            "iso_date": f"{rng.randint(1950, 2020)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
            "day_date": f"{rng.randint(1, 28):02d}/{rng.randint(1, 12):02d}/{rng.randint(1950, 2020)}",
            "secret": "AKIA" + "".join(rng.choice("ABCDEFGHIJ234567") for _ in range(16))}
        text = " ; ".join(f"xx {v}, yy" for v in values.values())
        new, spans = P.pseudonymise(text, KEY)
        assert [s[2] for s in spans] == list(values) and len(new) == len(text)
        assert re.sub(r"[a-zA-Z0-9]", "", new) == re.sub(r"[a-zA-Z0-9]", "", text)
        for v in values.values():
            assert v not in new
        again, spans2 = P.pseudonymise(new, KEY, back=True)
        assert again == text and [s[2] for s in spans2] == list(values)
        parted = " ".join(c[i:i + 4] for i in range(0, 16, 4))
        assert P.pseudonymise(parted, KEY)[0].replace(" ", "") == P.pseudonymise(c, KEY)[0]
        assert P.pseudonymise(c, b"other")[0] != P.pseudonymise(c, KEY)[0]


def test_invalid_values_stay():
    for text in ["4111111111111112", "300.1.2.3", "1.2.3", "000-12-3456", "2021-02-30", "version 1.20.300.4000", "in 2019 and 42",
                 "GB00WEST12345698765432", "a@b", "12:30", "the token was lost"]:
        assert P.pseudonymise(text, KEY) == (text, [])
    assert P.pseudonymise("GB82 WEST 1234 5698 7654 32", KEY)[1] == [(0, 27, "iban")]


def test_secrets():
    for s in ['password=b7db7aa4a5fcc78305', 'token = "1beb58b8af68854f0e01b4ad40"', "sk-abcdefghij1234567890"]:
        new, spans = P.pseudonymise(f"a {s} b", KEY)
        assert spans and s not in new and P.pseudonymise(new, KEY, back=True)[0] == f"a {s} b"


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, 1, "u"), (2, "", 2, None), (3, "call +1 (212) 555-0101 " + "x " * 200000, 3, "u"),
                                  (None, "é 10.20.30.40 ß", 4, "u"), (None, "é 10.20.30.40 ß", 4, "u")],
                                 "doc_id long, text string, _pii_count int, n string").toDF("doc_id", "text", "n", "n")
    out = [tuple(r) for r in P.rewrite(docs, KEY).collect()]
    assert out[0] == (1, None, 1, "u", 0, "") and out[1] == (2, "", 2, None, 0, "")
    assert out[2][5] == "phone" and len(out[2][1]) == len("call +1 (212) 555-0101 ") + 400000
    assert out[3] == out[4] and out[3][1] == P.pseudonymise("é 10.20.30.40 ß", KEY)[0] != "é 10.20.30.40 ß"
    assert P.rewrite(docs.limit(0), KEY).count() == 0


def test_values_before_numbers_words_and_long_secrets():
    """A valid value counts although the longest match runs on into what follows it."""
    for value, kind, behind in [
            ("4111111111111111", "card", " 123"), ("4111 1111 1111 1111", "card", " 05/27"), ("4111-1111-1111-1111", "card", " 12 345 6"),
            ("GB82WEST12345698765432", "iban", " BIC DEUTDEFF"), ("GB82 WEST 1234 5698 7654 32", "iban", " EUR"),
            ("GB82WEST12345698765432", "iban", " EUR 100")]:
        text = f"pay {value}{behind}"
        new, spans = P.pseudonymise(text, KEY)
        assert spans[0] == (4, 4 + len(value), kind) and value not in new and len(new) == len(text), text
        assert P.pseudonymise(new, KEY, back=True)[0] == text
    # a failed card number may be a telephone number
    assert [s[2] for s in P.pseudonymise("0044 20 7946 0958", KEY)[1]] == ["phone"]
    for head in ("password=", "ghp_"):
        secret = "a1B2c3D4e5" * 30
        new, spans = P.pseudonymise(f"x {head}{secret} y", KEY)
        assert [s[2] for s in spans] == ["secret"] and secret[-100:] not in new
        assert P.pseudonymise(new, KEY, back=True)[0] == f"x {head}{secret} y"
    plain = "sk-" * 100_000 + "AKIA" + "ABCD" * 4
    assert [t[2] for t in P.pseudonymise(plain, KEY)[1]] == ["secret"]
