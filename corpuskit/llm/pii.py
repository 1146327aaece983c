"""Format-preserving pseudonyms by keyed Feistel permutations.

Each value that is found and validated is permuted within its format under a
key: a card number becomes another with a right check digit, a date another
date of the range, an address another address.  A permutation maps equal values
to equal pseudonyms in all documents and different ones to different ones.

Everything is a column expression over one text; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.exprs import let

ROUNDS = 10
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Dates from 1900-01-01 to 2100-12-31, as a product of two moduli.
FIRST_DAY, DAY_MODULI = "1900-01-01", (142, 517)
LAST_DAY = "2100-12-31"

#: What each kind looks like; the first that fits at a place counts.  Every repetition is bounded or possessive, so a
#: run of any length is passed in linear time and without recursion: a local part has 64 characters at most, a label 63.
SHAPES = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}+@(?:[A-Za-z0-9\-]{1,63}+\.){1,32}[A-Za-z]{2,}+",
    "secret": r"(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?i:password|passwd|secret|token|api_?key)[\x20\x09]*+[=:][\x20\x09]*+[\"']?[A-Za-z0-9_\-]{8,}+)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "address": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z/.\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z])",
    "social": r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}|\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9A-Za-z])",
}
ANY = "|".join(SHAPES.values())
#: No value is without one of these; most texts have none and are left at once.
HINT = r"[0-9@]|(?i:password|passwd|secret|token|api_?key)"


def _mix(key: str, *parts: Column) -> Column:
    """56 keyed bits of a round, as a long."""
    said = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(said, 256), 1, 14), 16, 10).cast("long")


def permuted(key: str, kind: str, value: Column, a: Column | int, b: Column | int) -> Column:
    """A permutation of the numbers below ``a * b``: an alternating Feistel network."""
    a, b = (F.lit(m).cast("long") if isinstance(m, int) else m for m in (a, b))
    pair = lambda left, right: F.struct(left.alias("l"), right.alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        left = pair((acc["l"] + _mix(key, F.lit(kind), a, b, i, acc["r"]) % a) % a, acc["r"])
        right = pair(acc["l"], (acc["r"] + _mix(key, F.lit(kind), a, b, i, acc["l"]) % b) % b)
        return F.when(i % 2 == 0, left).otherwise(right)

    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    exact = let(value.cast("long"), lambda v: pair(F.call_function("div", v, b), v % b))
    return F.aggregate(rounds, exact, turn, lambda x: x["l"] * b + x["r"])


def _shifted(half: Column, digest: Column) -> Column:
    """Each letter or digit moved within its own alphabet by a byte of ``digest``."""

    def move(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for alphabet in (DIGITS, LOWER, UPPER):
            at = F.call_function("locate", c, F.lit(alphabet))
            out = F.when(at > 0, F.substring(F.lit(alphabet), (at - 1 + by) % len(alphabet) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), move), "")


def scrambled(key: str, kind: str, value: Column) -> Column:
    """A permutation of the strings with the same classes of characters in the same places."""
    digest = lambda i, other: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other), 256)

    def turn(acc: Column, i: Column) -> Column:
        left = F.struct(_shifted(acc["l"], digest(i, acc["r"])).alias("l"), acc["r"].alias("r"))
        right = F.struct(acc["l"].alias("l"), _shifted(acc["r"], digest(i, acc["l"])).alias("r"))
        return F.when(i % 2 == 0, left).otherwise(right)

    middle = F.ceil(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), middle).alias("l"), F.substring(value, middle + 1, F.length(value)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda x: F.concat(x["l"], x["r"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(value: Column, characters: Column, holes: str) -> Column:
    """``value`` with the characters of class ``holes`` replaced in order."""
    def fill(made: Column) -> Column:
        place = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), f"[^{holes}]", ""))
        parts = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c, i: F.when(c.rlike(f"[{holes}]"), F.substring(made, place(i), F.lit(1))).otherwise(c))
        return F.array_join(parts, "")

    return let(characters, fill)


def _ten(n: Column) -> Column:
    """A power of ten as a long (below 10^19)."""
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _digit_permutation(key: str, kind: str, digits: Column) -> Column:
    """Digits to as many digits (18 at most at a time, which ``digits`` must not exceed)."""
    half = F.floor(F.length(digits) / 2).cast("int")
    moved = permuted(key, kind, digits.cast("long"), _ten(F.length(digits) - half), _ten(half))
    return F.lpad(moved.cast("string"), F.length(digits), "0")


def _luhn_sum(digits: Column) -> Column:
    """Sum of Luhn's weighted digits, the last digit counting once."""
    d = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(d, F.lit(0), lambda s, x: s + x)


def _card(key: str, value: Column) -> Column:
    def of(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), _digit_permutation(key, "card", F.substring(d, F.lit(2), F.length(d) - 2)))
        made = let(body, lambda b: F.concat(b, ((10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(_luhn_sum(d) % 10 == 0, _refilled(value, made, "0-9")).otherwise(value)

    return let(_digits(value), of)


def _address(key: str, value: Column) -> Column:
    def of(octets: Column) -> Column:
        number = lambda x: ((x[0].cast("long") * 256 + x[1].cast("long")) * 256 + x[2].cast("long")) * 256 + x[3].cast("long")
        made = let(permuted(key, "address", number(octets), 65536, 65536), lambda v: F.concat_ws(".", *[(F.shiftright(v, s) % 256).cast("string") for s in (24, 16, 8, 0)]))
        valid = F.forall(octets, lambda o: (o.cast("int") <= 255) & ((F.length(o) == 1) | ~o.startswith("0")))
        return F.when(valid, made).otherwise(value)

    return let(F.split(value, r"\."), of)


def _date(key: str, value: Column) -> Column:
    """Day before month only where it can't be the other way round."""
    def with_layout(layout: str, otherwise: Column) -> Column:
        def of(day: Column) -> Column:
            number = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
            made = F.date_add(F.lit(FIRST_DAY).cast("date"), permuted(key, "date", number, *DAY_MODULI).cast("int"))
            good = day.isNotNull() & (day >= F.lit(FIRST_DAY).cast("date")) & (day <= F.lit(LAST_DAY).cast("date"))
            return F.when(good, F.date_format(made, layout)).otherwise(otherwise)

        return let(F.call_function("try_to_timestamp", value, F.lit(layout)).cast("date"), of)

    return (
        F.when(value.rlike("^[0-9]{4}-"), with_layout("yyyy-MM-dd", value)).when(value.rlike("^[0-9]{4}/"), with_layout("yyyy/MM/dd", value))
        .when(value.contains("."), with_layout("dd.MM.yyyy", value)).otherwise(with_layout("MM/dd/yyyy", with_layout("dd/MM/yyyy", value)))
    )


def _social(key: str, value: Column) -> Column:
    def of(d: Column) -> Column:
        area, group, serial = F.substring(d, 1, 3).cast("long"), F.substring(d, 4, 2).cast("long"), F.substring(d, 6, 4).cast("long")
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        place = (F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1) * 9999 + serial - 1

        def written(v: Column) -> Column:
            first = let((v - v % (99 * 9999)) / (99 * 9999), lambda x: F.when(x >= 665, x + 2).otherwise(x + 1).cast("int"))
            second = (((v % (99 * 9999)) - v % 9999) / 9999 + 1).cast("int")
            return F.format_string("%03d-%02d-%04d", first, second, (v % 9999 + 1).cast("int"))

        return F.when(valid, let(permuted(key, "social", place, 898 * 99, 9999), written)).otherwise(value)

    return let(_digits(value), of)


def _phone(key: str, value: Column) -> Column:
    """North American numbers stay such numbers; others keep their country code."""
    def of(d: Column) -> Column:
        local = F.substring(d, -10, 10)
        american = local.rlike("^[2-9][0-9]{2}[2-9]") & ((F.length(d) == 10) & ~value.startswith("+") | (F.length(d) == 11) & value.startswith("+1"))
        place = ((F.substring(local, 1, 3).cast("long") - 200) * 800 + F.substring(local, 4, 3).cast("long") - 200) * 10000 + F.substring(local, 7, 4).cast("long")

        def written(v: Column) -> Column:
            line = v % 10000
            head = (v - line) / 10000
            area = (head - head % 800) / 800 + 200
            return F.format_string("%03d%03d%04d", area.cast("int"), (head % 800 + 200).cast("int"), line.cast("int"))

        home = F.concat(F.substring(d, F.lit(1), F.length(d) - 10), let(permuted(key, "phone", place, 80000, 80000), written))
        # Digits up to the first separator, or two (one for 1 and 7) if there is none.
        apart = F.length(F.regexp_extract(value, r"^\+([0-9]{1,3})(?![0-9])", 1))
        code = F.when(value.startswith("+"), F.when(apart > 0, apart).when(value.rlike(r"^\+[17]"), 1).otherwise(2)).otherwise(0)
        abroad = let(code, lambda n: F.concat(F.substring(d, F.lit(1), n), _digit_permutation(key, "phone", F.substring(d, n + 1, F.length(d)))))
        valid = F.length(d).between(7, 15)
        return F.when(valid, _refilled(value, F.when(american, home).otherwise(abroad), "0-9")).otherwise(value)

    return let(_digits(value), of)


def _mod97(text: Column) -> Column:
    number = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[A-Z]"), F.call_function("ascii", c) - 55).otherwise(c.cast("int")))
    return F.aggregate(number, F.lit(0), lambda acc, x: (acc * F.when(x > 9, 100).otherwise(10) + x) % 97)


def _iban(key: str, value: Column) -> Column:
    def of(plain: Column) -> Column:
        country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        made = let(scrambled(key, "iban", body), lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        valid = F.length(plain).between(15, 34) & (_mod97(F.concat(body, F.substring(plain, 1, 4))) == 1)
        return F.when(valid, _refilled(value, made, "A-Z0-9")).otherwise(value)

    return let(F.replace(value, F.lit(" "), F.lit("")), of)


def _email(key: str, value: Column) -> Column:
    last = F.regexp_extract(value, r"\.[A-Za-z]{2,}$", 0)
    return F.concat(scrambled(key, "email", F.substring(value, F.lit(1), F.length(value) - F.length(last))), last)


def _secret(key: str, value: Column) -> Column:
    head = F.regexp_extract(value, r"^(?:AKIA|[^=:]*[=:][\x20\x09]*[\"']?)", 0)
    return F.concat(head, scrambled(key, "secret", F.substring(value, F.length(head) + 1, F.length(value))))


MAKERS: dict[str, Callable[[str, Column], Column]] = {
    "email": _email, "secret": _secret, "iban": _iban, "address": _address, "date": _date, "social": _social, "phone": _phone, "card": _card,
}


def pseudonym(key: str, value: Column) -> Column:
    """The pseudonym of one found value; itself if it isn't valid."""
    # The lookarounds see only the value here, so they hold.
    out = value
    for kind in reversed(SHAPES):
        out = F.when(value.rlike(f"^(?:{SHAPES[kind]})$"), MAKERS[kind](key, value)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_pseudonyms") -> DataFrame:
    """``docs`` with the personal values of each text replaced, and their number.

    Found: e-mail addresses, access keys and passwords, IBANs (mod 97), IPv4
    addresses, dates from 1900 to 2100, social security numbers, phone numbers
    and card numbers (Luhn).  What looks like one but is not valid stays.  A
    pseudonym has its value's length and layout, but for an address or the
    digits of an octet.  Equal values get equal pseudonyms in every row and
    run with the same key.

    NULL and empty texts stay as they are, with no pseudonyms.  Other columns
    stay; one named ``count_col`` is replaced.  Rows are taken one by one, so
    repeated rows and empty tables need no care; an unbroken run of a megabyte
    takes seconds.  Of a longer local part than mail allows only the last 64
    characters are taken.
    """
    text = F.col(text_col)
    held = "__done"
    while held in docs.columns:
        held += "_"

    def replaced(found: Column) -> Column:
        made = F.transform(found, lambda m: let(m, lambda v: pseudonym(key, v)))
        n = lambda new: F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
        joined = lambda new: F.array_join(F.zip_with(F.split(text, ANY, -1), F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
        return let(made, lambda new: F.struct(joined(new).alias("text"), n(new).cast("long").alias("n")))

    done = F.when(text.rlike(HINT), let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda f: F.when(F.size(f) > 0, replaced(f))))
    out = docs.withColumn(held, done)
    return out.withColumns({
        text_col: F.coalesce(F.col(f"{held}.text"), text), count_col: F.coalesce(F.col(f"{held}.n"), F.lit(0)).cast("long"),
    }).drop(held)
