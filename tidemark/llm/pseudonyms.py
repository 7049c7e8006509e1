"""Format-preserving pseudonyms for personal data, in DataFrame expressions only.

A text is split at its candidate values by one pattern; every candidate that passes its own
validity test is replaced by a keyed permutation of itself within the same format, and the
pieces are joined again. The permutation is a Feistel network: halves of the value move each
other, character by character within its class (digit, lower, upper letter), or by modular
addition where the format has a numeric range. It is a bijection, so equal values stay equal
across documents and different values stay different.

A run of digit groups may hold more than a card number (an expiry year, a phone number). It
is cut at its groups: from the left, the longest stretch of 13 to 19 digits with a valid check
digit is a card number; what is left is searched for phone and social security numbers.
Stretches after the run's first group start at a group of four digits or more.

Kinds: payment card numbers (check digit valid; separators free, first digit kept, check
digit recomputed), social security numbers, phone numbers (country digits kept), IPv4
addresses, calendar dates 1900-01-01 to 2100-01-02 (ISO, or month/day/year), e-mail
addresses (the name before ``@``), access key ids and named secrets (``password=...``).

Defined results: null text stays null with no finds; candidates that fail their test stay as
they are; all other columns, whatever their names, pass through unchanged; repeated rows and
very long texts are treated alike, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
# Dates are permuted among 319 x 229 days from this one on.
FIRST_DAY, DAY_HIGH, DAY_LOW = "1900-01-01", 319, 229
# Areas of a social security number without 000, 666 and 9xx.
AREAS, GROUPS, SERIALS = 898, 99, 9999

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
SECRET = r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api[_-]?key)\x20{0,2}[=:]\x20{0,2}[\"']?[A-Za-z0-9+/_.~-]{6,}+"
ACCESS = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
ISO_DATE = r"(?<![\w.+/-])\d{4}-\d{2}-\d{2}(?!(?!T\d)[\w/-])"
US_DATE = r"(?<![\w.+/-])\d{1,2}/\d{1,2}/\d{4}(?![\w/-])"
SSN = r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-])"
IPV4 = r"(?<![\w.+-])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)"
PHONE = (r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,3}"
         r"|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-])")
CARD = r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])"
# Values of other kinds that may stand beside a card number: a run of digit groups ends before them.
OTHER = (r"(?!\d{4}-\d{2}-\d{2}(?!\d)|\d{1,2}/\d{1,2}/\d{4}|\d{3}-\d{2}-\d{4}(?![\w-])|\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
         r"|\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?![\w-])|[A-Za-z0-9._%+-]{1,64}+@)")
GROUP = r"\d++(?!\w|-(?!\d))"
RUN = rf"(?<![\w.+-])(?=\d(?:[ -]?\d){{12}}){OTHER}{GROUP}(?:(?:-|\x20{OTHER}){GROUP})*+"
ANY = "|".join((EMAIL, SECRET, ACCESS, ISO_DATE, US_DATE, SSN, IPV4, RUN, PHONE))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digest(key: str, label: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), *[p.cast("string") for p in parts]), 512)


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substr(digest, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _moved(half: Column, digest: Column, letters: Column) -> Column:
    """Every letter and digit moved within its class by the digest; the rest stays."""

    def with_digest(d: Column) -> Column:
        def move(c: Column, i: Column) -> Column:
            code, step = F.ascii(c), _byte(d, i)

            def within(first: int, size: Column | int) -> Column:
                return F.char(F.pmod(code - first + step, size if isinstance(size, Column) else F.lit(size)) + first)

            return (F.when(c.between("0", "9"), within(48, 10)).when(c.between("a", "z"), within(97, letters))
                    .when(c.between("A", "Z"), within(65, 26)).otherwise(c))

        return F.array_join(F.transform(F.split(half, ""), move), "")

    return _let(digest, with_digest)


def permute_text(value: Column, key: str, label: str) -> Column:
    """Keyed bijection of a string onto strings with the same classes in the same places.

    Values of lower-case hexadecimal digits only stay so.
    """
    half = F.floor(F.length(value) / 2).cast("int")
    letters = F.when(value.rlike("^[0-9a-f]*$"), 6).otherwise(26)
    start = F.struct(F.substr(value, F.lit(1), half).alias("a"), F.substr(value, half + 1, F.length(value)).alias("b"))

    def round_(acc: Column, r: Column) -> Column:
        odd = r % 2 == 1
        moved = _moved(F.when(odd, acc["b"]).otherwise(acc["a"]),
                       _digest(key, label, r, F.when(odd, acc["a"]).otherwise(acc["b"])), letters)
        return F.struct(F.when(odd, acc["a"]).otherwise(moved).alias("a"), F.when(odd, moved).otherwise(acc["b"]).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda acc: F.concat(acc["a"], acc["b"]))


def permute_number(value: Column, high: int, low: int, key: str, label: str) -> Column:
    """Keyed bijection of 0 .. high*low-1 onto itself by modular additions of the two parts."""
    start = F.struct(F.floor(value / low).cast("long").alias("a"), F.pmod(value, F.lit(low)).cast("long").alias("b"))

    def round_(acc: Column, r: Column) -> Column:
        odd = r % 2 == 1
        step = F.conv(F.substring(_digest(key, label, r, F.when(odd, acc["a"]).otherwise(acc["b"])), 1, 12), 16, 10).cast("long")
        return F.struct(F.when(odd, acc["a"]).otherwise(F.pmod(acc["a"] + step, F.lit(high))).cast("long").alias("a"),
                        F.when(odd, F.pmod(acc["b"] + step, F.lit(low))).otherwise(acc["b"]).cast("long").alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda acc: acc["a"] * low + acc["b"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    def with_digits(all_digits: Column) -> Column:
        def put(c: Column, i: Column) -> Column:
            before = F.length(_digits(F.substr(shape, F.lit(1), i + 1)))
            return F.when(c.between("0", "9"), F.substr(all_digits, before, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.split(shape, ""), put), "")

    return _let(digits, with_digits)


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is not doubled."""
    def of(all_digits: Column) -> Column:
        n = F.length(all_digits)

        def add(acc: Column, i: Column) -> Column:
            d = F.substr(all_digits, n - i + 1, F.lit(1)).cast("int")
            twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
            return acc + F.when(i % 2 == 0, twice).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)

    return _let(digits, of)


def _card(value: Column, key: str) -> tuple[Column, Column]:
    digits = _digits(value)
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), permute_text(F.substr(digits, F.lit(2), F.length(digits) - 2), key, "card"))
    moved = _let(body, lambda b: F.concat(b, F.pmod(-_luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
    return value.rlike(f"^(?:{CARD})$") & (_luhn_sum(digits) % 10 == 0), _refill(value, moved)


def _run_parts(run: Column) -> Column:
    """A run of digit groups cut into card numbers, phone numbers, social security numbers and the text between."""
    def marked(groups: Column) -> Column:
        def stretch(i: Column, n: Column) -> Column:
            return F.array_join(F.slice(groups, i, n), "")

        def card(n: Column, i: Column) -> Column:
            return _let(_digits(stretch(i, n)), lambda d: F.length(d).between(13, 19) & (_luhn_sum(d) % 10 == 0))

        def step(acc: Column, i: Column) -> Column:
            group = F.get(groups, i - 1)
            may = (i >= acc["next"]) & ((i == 1) | (F.length(_digits(group)) >= 4))
            sizes = F.when(may, F.filter(F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - i + 1)), lambda n: card(n, i)))

            def taken(n: Column) -> Column:
                found = F.regexp_replace(stretch(i, n), "^([ -]?)(.*)$", "$1;$2;")
                return F.struct(
                    F.when(n.isNotNull(), F.concat(acc["text"], found)).when(i >= acc["next"], F.concat(acc["text"], group))
                    .otherwise(acc["text"]).alias("text"),
                    F.coalesce(i + n, acc["next"]).alias("next"))

            return _let(F.array_max(sizes), taken)

        return F.aggregate(F.sequence(F.lit(1), F.size(groups)), F.struct(F.lit("").alias("text"), F.lit(1).alias("next")), step,
                           lambda acc: acc["text"])

    parts = F.split(_let(F.regexp_extract_all(run, F.lit("[ -]?[0-9]+"), F.lit(0)), marked), ";")
    # Every second part is a card number.
    return F.flatten(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.array(p)).otherwise(
        F.split(F.regexp_replace(p, f"{SSN}|{PHONE}", ";$0;"), ";"))))


def _ssn(value: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.substr(value, F.lit(a), F.lit(b)).cast("int") for a, b in ((1, 3), (5, 2), (8, 4)))
    valid = value.rlike(f"^(?:{SSN})$") & area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = ((area - F.when(area > 666, 2).otherwise(1)) * GROUPS + group - 1).cast("long") * SERIALS + serial - 1

    def shown(moved: Column) -> Column:
        high = F.floor(moved / SERIALS)
        at = F.floor(high / GROUPS)
        return F.format_string("%03d-%02d-%04d", at + F.when(at >= 665, 2).otherwise(1), F.pmod(high, F.lit(GROUPS)) + 1,
                               F.pmod(moved, F.lit(SERIALS)) + 1)

    return valid, _let(permute_number(index, AREAS * GROUPS, SERIALS, key, "ssn"), shown)


def _ipv4(value: Column, key: str) -> tuple[Column, Column]:
    part = F.split(value, r"\.")
    octet = [F.get(part, F.lit(i)).try_cast("long") for i in range(4)]
    valid = value.rlike(f"^(?:{IPV4})$") & (F.greatest(*octet) <= 255)
    moved = permute_number(((octet[0] * 256 + octet[1]) * 256 + octet[2]) * 256 + octet[3], 65536, 65536, key, "ipv4")
    return valid, _let(moved, lambda m: F.concat_ws(".", *[F.pmod(F.floor(m / 256**i), F.lit(256)).cast("string") for i in (3, 2, 1, 0)]))


def _date(value: Column, key: str, pattern: str, form: str, read: str) -> tuple[Column, Column]:
    day = F.try_to_timestamp(value, F.lit(read)).cast("date")
    index = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
    moved = permute_number(index, DAY_HIGH, DAY_LOW, key, "date").cast("int")
    valid = value.rlike(f"^(?:{pattern})$") & index.between(0, DAY_HIGH * DAY_LOW - 1)
    return valid, F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), moved), form)


def _phone(value: Column, key: str) -> tuple[Column, Column]:
    digits = _digits(value)
    n = F.length(digits)
    kept = F.greatest(n - 10, F.lit(0))
    moved = F.concat(F.substr(digits, F.lit(1), kept), permute_text(F.substr(digits, kept + 1, n), key, "phone"))
    return value.rlike(f"^(?:{PHONE})$") & n.between(8, 15), _refill(value, moved)


def _after(value: Column, key: str, label: str, head: str) -> Column:
    """The value with what follows the head pattern permuted."""
    first = F.regexp_extract(value, f"^({head})", 1)
    return F.concat(first, permute_text(F.substr(value, F.length(first) + 1, F.length(value)), key, label))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one candidate; the candidate itself where it is not valid."""
    name = F.substring_index(value, "@", 1)
    out = F.when(value.rlike(f"^(?:{EMAIL})$"),
                 F.concat(permute_text(name, key, "email"), F.substr(value, F.length(name) + 1, F.length(value))))
    out = out.when(value.rlike(f"^(?:{SECRET})$"), _after(value, key, "secret", r"[A-Za-z_-]+\x20{0,2}[=:]\x20{0,2}[\"']?"))
    out = out.when(value.rlike(f"^(?:{ACCESS})$"), _after(value, key, "access", "AKIA|ASIA"))
    for valid, moved in (_date(value, key, ISO_DATE, "yyyy-MM-dd", "yyyy-MM-dd"), _date(value, key, US_DATE, "M/d/yyyy", "M/d/yyyy"),
                         _ssn(value, key), _ipv4(value, key), _card(value, key), _phone(value, key)):
        out = out.when(valid, moved)
    return out.otherwise(value)


def pseudonymised(df: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """All columns with ``text`` pseudonymised; ``found``, if named, counts the replaced values."""
    source = F.col(f"`{text}`")
    values = F.regexp_extract_all(source, F.lit(ANY), F.lit(0))

    def parts(v: Column) -> Column:
        return F.when(v.rlike(f"^(?:{RUN})$"), _run_parts(v)).otherwise(F.array(v))

    pairs = F.transform(values, lambda v: F.transform(parts(v), lambda p: F.struct(p.alias("was"), pseudonym(p, key).alias("now"))))

    def rebuilt(p: Column) -> Column:
        joined = F.zip_with(F.split(source, ANY), p, lambda b, v: F.concat(b, F.coalesce(F.array_join(v["now"], ""), F.lit(""))))
        changed = F.aggregate(F.flatten(p), F.lit(0), lambda n, v: n + F.when(v["was"] == v["now"], 0).otherwise(1))
        return F.struct(F.array_join(joined, "").alias("text"), changed.alias("n"))

    # No candidate can do without one of these characters: other texts are left alone at once.
    whole = F.when(source.rlike("[0-9@=:]"), _let(pairs, rebuilt))
    if found is None:
        return df.withColumn(text, F.coalesce(whole["text"], source))
    part = "pseudonymised text"
    out = df.withColumn(part, whole)
    return out.withColumn(text, F.coalesce(F.col(f"`{part}`.text"), source)).withColumn(
        found, F.coalesce(F.col(f"`{part}`.n"), F.lit(0))).drop(part)
