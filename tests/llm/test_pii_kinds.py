"""Kinds of personal data: titles, capitals, apostrophes, IBANs, IPv6 addresses, 15-digit cards; nothing else is touched."""

import ipaddress
import re

import pytest

from framelake.llm import pii


def swapped(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(df).orderBy("doc_id").collect()]


def luhn(x):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(x))) % 10


def iban_rest(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def test_names(spark):
    texts = ["Dr. Alice Brown met Prof. Weber", "M. Dupont et Mr. JOHN SMITH", "Mr. John Smith, Mr. O'Brien and MR. O'BRIEN", "Mrs. McDonald's CEO; Mr. Smith CEO",
             "Prof. Dr. Weber-Brown", "Dr. No", "The drive M. is M and Dr"]
    a, b, c, d, e, f, g = swapped(spark, texts)
    for gone in ("Alice", "Weber", "Dupont", "JOHN", "SMITH", "Smith", "O'Brien", "O'BRIEN", "McDonald"):
        assert gone not in "|".join((a, b, c, d, e))
    assert re.fullmatch(r"Dr\. [A-Z][a-z]{4} [A-Z][a-z]{4} met Prof\. [A-Z][a-z]{4}", a)
    john, smith = re.search(r"Mr\. (\w+) (\w+),", c).groups()
    assert re.fullmatch(r"M\. [A-Z][a-z]{5} et Mr\. " + f"{john.upper()} {smith.upper()}", b)
    first, second = re.search(r"Mr\. ([A-Z]'[A-Z][a-z]{4}) and MR\. ([A-Z]'[A-Z]{5})", c).groups()
    assert second == first.upper()
    assert re.fullmatch(r"Mrs\. [A-Z][a-z][A-Z][a-z]{5}'s CEO; Mr\. " + smith + " CEO", d)
    assert e == f"Prof. Dr. {re.search(r'Prof. (.+)$', a)[1]}-{re.search(r'Dr. .+ (.+) met', a)[1]}"
    assert f != "Dr. No" and g == texts[6]


def test_ibans(spark):
    good, bad = "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819"
    assert iban_rest(good) == 1 == iban_rest(bad)
    one, two, three = swapped(spark, [f"Pay {good} now", f"{good.replace(' ', '')}, {bad} or GB30NWBK60161331926819", "AB12 is short, Ab12CDEFGHIJKLMNOP too"])
    got = re.fullmatch(r"Pay (DE\d\d(?: \d{4}){4} \d\d) now", one)[1]
    plain, british, wrong = re.fullmatch(r"(DE\d{20}), (GB\d\d[A-Z]{4}\d{14}) or (GB\d\d[A-Z]{4}\d{14})", two).groups()
    assert got.replace(" ", "") == plain and iban_rest(got) == 1 and plain != good.replace(" ", "")
    assert iban_rest(british) == 1 and iban_rest(wrong) != 1 and british[4:] == wrong[4:] and british != bad
    assert three == "AB12 is short, Ab12CDEFGHIJKLMNOP too"


def test_ipv6(spark):
    texts = ["at 2001:db8:85a3:0:0:8a2e:370:7334, fe80::1ff:fe23:4567:890a and 2001:DB8::1.", "at 2001:db8::1 12:30:45 std::vector a::b:: 00:1a:2b:3c:4d:5e"]
    one, two = swapped(spark, texts)
    full, short, upper = re.fullmatch(r"at ([0-9a-f:]+), ([0-9a-f:]+) and ([0-9A-F:]+)\.", one).groups()
    for x, was in ((full, "2001:db8:85a3:0:0:8a2e:370:7334"), (short, "fe80::1ff:fe23:4567:890a"), (upper, "2001:DB8::1")):
        ipaddress.ip_address(x)
        assert x != was and x.split(":")[0] == was.split(":")[0] and [len(g) for g in x.split(":")] == [len(g) for g in was.split(":")]
    assert two.startswith(f"at {upper.lower()} 12:30:45 std::vector ") and two.endswith(" 00:1a:2b:3c:4d:5e")


def test_cards_of_15_digits(spark):
    one, two = swapped(spark, ["3782 822463 10005 or 371449635398431", "378282246310005, 378282246310006, 1234 567890 12345"])
    spaced, other = re.fullmatch(r"(37\d\d \d{6} \d{5}) or (37\d{13})", one).groups()
    same, wrong, left = re.fullmatch(r"(37\d{13}), (37\d{13}), (.+)", two).groups()
    assert spaced.replace(" ", "") == same != "378282246310005" and luhn(same) == luhn(other) == 0
    assert luhn(wrong) == luhn("378282246310006") and wrong[:14] == same[:14] and left == "1234 567890 12345"


def test_full_short_address_is_written_out(spark):
    sql = pii._surrogate_part("kind", "value", f"concat('k|', {pii.ATTEMPTS})")
    got = spark.createDataFrame([("ip6", f"fe80::{x}") for x in "0123456789abcdef"], "kind string, value string").selectExpr(f"{sql} AS s").collect()
    assert len({r.s for r in got}) == 16 and all(ipaddress.ip_address(r.s) and r.s.startswith("fe80:") for r in got)


def test_offenders_of_documents_without_id(spark, monkeypatch):
    """Collisions are solved by text, whatever the ids: equal entities stay equal among null and repeated ids."""
    names = [f"{a}u" for a in "BCDFGHJKLMNPQRSTVWXYZ"]
    rows = [(None if k % 2 else 7, f"Mr. {n}") for k, n in enumerate(names)] + [(None, "Ms. Wu"), (None, "Ms. Wu"), (None, None)]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(rows) and len({t[4:] for t in got if t}) == len(names) and not {t[4:] for t in got} & set(names)
    assert got.count(next(t for t in got if t.startswith("Ms"))) == 2


@pytest.mark.parametrize("text", ["", "plain words only", "12:30 and 3.14, 2024-01-02", "f(x)::g", "A1B2C3", "Mrs and Dr without more"])
def test_left_alone(spark, text):
    assert swapped(spark, [text]) == [text]
