"""Pseudonyms: an independent Feistel network, and runs that break careless patterns."""

import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from corpuskit.llm import pii
from corpuskit.llm.queries import KEY

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def feistel(kind, value, a, b):
    def mix(*parts):
        return int(hashlib.sha256("|".join(map(str, (KEY, kind, *parts))).encode()).hexdigest()[:14], 16)

    left, right = divmod(value, b)
    for i in range(10):
        if i % 2 == 0:
            left = (left + mix(a, b, i, right) % a) % a
        else:
            right = (right + mix(a, b, i, left) % b) % b
    return left * b + right


def scrambled(kind, value):
    def moved(half, digest):
        out = ""
        for i, c in enumerate(half):
            for alphabet in (DIGITS, LOWER, UPPER):
                if c in alphabet:
                    c = alphabet[(alphabet.index(c) + int(digest[i % 32 * 2 : i % 32 * 2 + 2], 16)) % len(alphabet)]
                    break
            out += c
        return out

    middle = -(-len(value) // 2)
    left, right = value[:middle], value[middle:]
    for i in range(10):
        digest = lambda other: hashlib.sha256("|".join((KEY, kind, str(i), other)).encode()).hexdigest()  # noqa: B023, E731
        if i % 2 == 0:
            left = moved(left, digest(right))
        else:
            right = moved(right, digest(left))
    return left + right


def expected(value):
    if "@" in value:
        last = re.search(r"\.[A-Za-z]+$", value)[0]
        return scrambled("email", value[: -len(last)]) + last
    if re.fullmatch(r"(\d+\.){3}\d+", value):
        n = 0
        for octet in value.split("."):
            n = n * 256 + int(octet)
        n = feistel("address", n, 65536, 65536)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if re.fullmatch(r"\d{16}", value):
        body = value[0] + f"{feistel('card', int(value[1:15]), 10**7, 10**7):014d}"
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(body + "0")))
        return body + str(-total % 10)
    area, group, serial = map(int, value.split("-"))
    place = ((area - (2 if area > 666 else 1)) * 99 + group - 1) * 9999 + serial - 1
    place = feistel("social", place, 898 * 99, 9999)
    first, second, third = place // (99 * 9999), place % (99 * 9999) // 9999, place % 9999
    return f"{first + (2 if first >= 665 else 1):03d}-{second + 1:02d}-{third + 1:04d}"


def test_pseudonyms_are_those_of_an_independent_network(spark):
    values = ["alice.b@example.com", "Bob-9@sub.example.org", "192.168.7.250", "8.8.8.8", "4041894974608795", "4111111111111111", "123-45-6789", "899-99-9999", "667-01-0001"]
    rows = spark.createDataFrame([(i, f"see {v} here, and {v}") for i, v in enumerate(values)], "i int, text string")
    got = {r.i: r.text for r in pii.pseudonymise(rows, KEY).collect()}
    assert got == {i: f"see {expected(v)} here, and {expected(v)}" for i, v in enumerate(values)}


MEGA = 1 << 20


@pytest.mark.parametrize("text", [
    "a" * MEGA + " 1", "1" * MEGA, "." * MEGA + "1", "x@" + "a." * (MEGA // 2) + "1", "x@" + "a-" * (MEGA // 2) + ".com", "@" * MEGA, "a@" * (MEGA // 2),
    "x@" + "b" * MEGA + ".com", "1." * (MEGA // 2), "token " * (MEGA // 6) + "=", "token" + " " * MEGA + "x", "+1 " * (MEGA // 3), "12-" * (MEGA // 3), "DE12 " * (MEGA // 5),
])
def test_long_runs(spark, text):
    start = time.time()
    row = pii.pseudonymise(spark.createDataFrame([(text,)], "text string"), KEY).first()
    assert len(row.text) == len(text) and time.time() - start < 30


def test_deep_domains_and_long_local_parts(spark):
    texts = ["x@" + "a." * 30 + "com", "x@" + "a." * 2000 + "com", "y" * 100 + "@b.co", "x@" + "a." * 2000 + "1"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").withColumn("__done", F.lit(5))
    got = {r.i: r for r in pii.pseudonymise(rows, KEY).collect()}
    assert got[0].n_pseudonyms == 1 and got[0].text != texts[0] and got[2].n_pseudonyms == 1 and got[2].text[:36] == "y" * 36
    assert got[3].n_pseudonyms == 0 and got[0]["__done"] == 5
