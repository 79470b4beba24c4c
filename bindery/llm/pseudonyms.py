"""Format-preserving pseudonyms for personal data, with built-in functions only.

A validated number or date is a point of a finite domain: all card numbers of
its length and first digit, all days of two centuries, and so on. A keyed
Feistel network permutes the domain, so the pseudonym is valid in the same
format, equal values get equal pseudonyms in every document, and different
values stay different. Separators stay where they are. The local part of a
mail address is permuted letter by letter within its character classes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

ROUNDS = 8
#: Fixed formats, tried in this order at each place of the text.
PATTERNS = {
    # scanned once a word, without going back
    "mail": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,254}+(?<=[A-Za-z0-9])@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}",
    "iso_date": r"(?<![\d.-])\d{4}-\d{2}-\d{2}(?![\d-])",
    "us_date": r"(?<![\d/])\d{1,2}/\d{1,2}/\d{4}(?![\d/])",
    "dot_date": r"(?<![\d.])\d{1,2}\.\d{1,2}\.\d{4}(?![\d])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d])(?!\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d(])(?:\+1[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-]?)\d{3}[ .-]?|\(\d{3}\) ?\d{3}[ .-]|[2-9]\d{2}[ .-][2-9]\d{2}[ .-])\d{4}(?!\d)",
    "foreign_phone": r"(?<![\w+])\+[2-9](?:[ .()-]{0,2}\d){6,14}(?![\d@])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
}
KINDS = tuple(PATTERNS)
#: Country codes of one, two and three digits.
COUNTRY_CODE = r"^(?:7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Days from 1900-01-01 to 2099-12-31 (17 * 4297).
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)


def _prf(key: str, kind: str, turn: Column, value: Column) -> Column:
    """48 pseudo-random bits."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the pairs of ``0..a-1`` and ``0..b-1``, as ``struct<l, r>``."""

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (s["l"] + _prf(key, kind, i, s["r"])) % a).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + _prf(key, kind, i, s["l"])) % b).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _filled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in order."""

    def step(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct((s["k"] + digit.cast("int")).alias("k"), F.concat(s["out"], F.when(digit, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(form, ""), F.struct(F.lit(1).alias("k"), F.lit("").alias("out")), step, lambda s: s["out"])


def _padded(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _number(digits: Column, start: int, size: int) -> Column:
    return F.substring(digits, start, size).cast("long")


def luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn check, the last digit being the check digit."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + (c.cast("int") >= 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda s, v: s + v)


def _card(m: Column, key: str) -> Column:
    def new(digits: Column) -> Column:
        # the first digit stays, the last is the check digit
        n = F.length(digits) - 2
        u, v = F.floor(n / 2).cast("int"), (n - F.floor(n / 2)).cast("int")
        pair = feistel(
            F.substring(digits, F.lit(2), u), F.substring(digits, u + 2, v), F.pow(F.lit(10.0), u).cast("long"), F.pow(F.lit(10.0), v).cast("long"), key, "card"
        )
        body = _let(pair, lambda p: F.concat(F.substring(digits, 1, 1), _padded(p["l"], u), _padded(p["r"], v)))
        return _let(body, lambda x: F.concat(x, ((10 - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))

    digits = F.regexp_replace(m, "[^0-9]", "")
    return F.when(luhn_sum(digits) % 10 == 0, _filled(m, new(digits)))


def _phone(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        pair = feistel(_number(d, 1, 6), _number(d, 7, 4), F.lit(1_000_000), F.lit(10_000), key, "phone")
        return _let(pair, lambda p: F.concat(_padded(p["l"], 6), _padded(p["r"], 4)))

    digits = F.regexp_replace(m, "[^0-9]", "")
    return _filled(m, F.when(F.length(digits) == 11, F.concat(F.lit("1"), new(F.substring(digits, 2, 10)))).otherwise(new(digits)))


def _foreign_phone(m: Column, key: str) -> Column:
    """The country code stays, the digits after it are permuted."""

    def new(digits: Column) -> Column:
        code = F.regexp_extract(digits, COUNTRY_CODE, 0)
        n = F.length(digits) - F.length(code)
        u, v = F.floor(n / 2).cast("int"), (n - F.floor(n / 2)).cast("int")
        left, right = F.substring(digits, F.length(code) + 1, u), F.substring(digits, F.length(code) + 1 + u, v)
        pair = feistel(left, right, F.pow(F.lit(10.0), u).cast("long"), F.pow(F.lit(10.0), v).cast("long"), key, "foreign_phone")
        return _let(pair, lambda p: F.concat(code, _padded(p["l"], u), _padded(p["r"], v)))

    return _filled(m, _let(F.regexp_replace(m, "[^0-9]", ""), new))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = _number(m, 1, 3), _number(m, 5, 2), _number(m, 8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - (area > 666).cast("int")  # 898 areas
    pair = feistel(place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9_999), key, "ssn")

    def shown(p: Column) -> Column:
        place = F.floor(p["l"] / 99)
        return F.concat_ws("-", _padded(place + 1 + (place >= 665).cast("int"), 3), _padded(p["l"] % 99 + 1, 2), _padded(p["r"] + 1, 4))

    return F.when(valid, _let(pair, shown))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    valid = F.forall(octets, lambda x: x <= 255)
    pair = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65_536), F.lit(65_536), key, "ip")
    return F.when(valid, _let(pair, lambda p: F.concat_ws(".", F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)))


def _date(m: Column, key: str, kind: str) -> Column:
    iso = F.split(m, r"[./-]")
    y, mo, d = {"iso_date": (0, 1, 2), "us_date": (2, 0, 1), "dot_date": (2, 1, 0)}[kind]
    day = F.try_to_date(F.concat_ws("-", iso[y], F.lpad(iso[mo], 2, "0"), F.lpad(iso[d], 2, "0")), "yyyy-MM-dd")
    number = F.date_diff(day, F.to_date(F.lit(FIRST_DAY)))
    valid = number.between(0, DAYS[0] * DAYS[1] - 1)
    pair = feistel(F.floor(number / DAYS[1]), number % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date")
    new = F.date_add(F.to_date(F.lit(FIRST_DAY)), _let(pair, lambda p: p["l"] * DAYS[1] + p["r"]).cast("int"))
    short = m.rlike(r"(^|[./])\d[./]")  # a day or month was written with one digit
    forms = {"iso_date": ("yyyy-MM-dd", "yyyy-MM-dd"), "us_date": ("M/d/yyyy", "MM/dd/yyyy"), "dot_date": ("d.M.yyyy", "dd.MM.yyyy")}[kind]
    return F.when(valid, F.when(short, F.date_format(new, forms[0])).otherwise(F.date_format(new, forms[1])))


def _mail(m: Column, key: str) -> Column:
    """Feistel over the characters: each moves within its class by a keyed amount."""
    local = F.substring_index(m, "@", 1)
    half = F.floor(F.length(local) / 2).cast("int")

    def moved(part: Column, other: Column, i: Column) -> Column:
        def one(c: Column, at: Column) -> Column:
            step = _prf(key, "mail", F.concat_ws(".", i, at), other)
            low, size = F.ascii(F.when(c.between("0", "9"), "0").when(c.between("a", "z"), "a").otherwise("A")), F.when(c.between("0", "9"), 10).otherwise(26)
            return F.when(c.rlike("[A-Za-z0-9]"), F.char((F.ascii(c) - low + step) % size + low)).otherwise(c)

        return F.array_join(F.transform(F.split(part, ""), one), "")

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, moved(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(moved(s["r"], s["l"], i)).alias("r"))

    start = F.struct(F.substring(local, F.lit(1), half).alias("l"), F.substring(local, half + 1, F.length(local)).alias("r"))
    new = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))
    return F.concat(new, F.lit("@"), F.substring_index(m, "@", -1))


def pseudonym_of(m: Column, kind: str, key: str) -> Column:
    """The pseudonym of a match, or null if it is no valid value of its kind."""
    makers = {"mail": _mail, "ip": _ip, "ssn": _ssn, "phone": _phone, "foreign_phone": _foreign_phone, "card": _card}
    return makers[kind](m, key) if kind in makers else _date(m, key, kind)


#: Marks put around matches, and what stands for these characters in a text while they are in use.
OPEN, NEXT, ESCAPE = "\x01", "\x02", "\x03"
ESCAPED = {ESCAPE: ESCAPE + "\x04", OPEN: ESCAPE + "\x05", NEXT: ESCAPE + "\x06"}


def _swapped(text: Column, pairs: dict[str, str]) -> Column:
    for old, new in pairs.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The input's rows and columns with pseudonyms in the text, and ``n_values``, their number.

    ``key`` selects the permutation; keep it secret (it is part of the plan, so
    plans are secret too); an empty one is refused. Null texts stay null, with
    0 values; empty texts stay empty; values that fail their check (Luhn,
    calendar, octets, ranges) stay as they are. A column ``n_values`` of the
    input is replaced. Rows are independent, so null, repeated or odd ids do
    not matter; an empty table gives no rows; a text is one row's work.
    """
    if not key:
        raise ValueError("a key is needed")
    keep = [c for c in docs.columns if c != "n_values"]
    text = F.col(f"`{text_col}`").cast("string")
    # one scan of the text: each match comes back between marks, in the place of its kind
    pattern = "|".join(f"({p})" for p in PATTERNS.values())
    marked = OPEN + NEXT.join(f"${i + 1}" for i in range(len(KINDS))) + OPEN
    rare = reduce(lambda a, b: a | b, (F.contains(text, F.lit(c)) for c in ESCAPED))
    safe = F.when(rare, _swapped(text, ESCAPED)).otherwise(text)

    def value(m: Column) -> Column:
        """A match and its pseudonym, of the one kind that is not empty."""
        kinds = F.split(m, NEXT, -1)
        made = lambda i: makers[i](F.element_at(kinds, i + 1))
        makers = [lambda x, n=n: pseudonym_of(x, n, key) for n in KINDS]
        new = reduce(lambda out, i: out.when(F.element_at(kinds, i + 1) != "", made(i)), range(1, len(KINDS)), F.when(F.element_at(kinds, 1) != "", made(0)))
        return F.struct(F.array_join(kinds, "").alias("old"), new.alias("new"))

    parts, found = free("parts", docs), free("found", docs)
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.split(F.regexp_replace(safe, F.lit(pattern), F.lit(marked)), OPEN, -1).alias(parts))
    # pieces of the text and matches take turns
    matches = F.transform(F.filter(parts, lambda x, i: i % 2 == 1), value)
    rows = rows.select(*(F.col(f"`{c}`") for c in keep), F.col(parts), F.when(F.size(parts) > 1, matches).alias(found))
    gaps = F.filter(parts, lambda x, i: i % 2 == 0)
    new = F.zip_with(gaps, F.col(found), lambda g, f: F.concat(g, F.coalesce(f["new"], f["old"], F.lit(""))))
    joined = F.array_join(new, "")
    new_text = F.when(F.col(found).isNull(), F.col(f"`{text_col}`")).otherwise(F.when(F.contains(joined, F.lit(ESCAPE)), _swapped(joined, {v: k for k, v in reversed(ESCAPED.items())})).otherwise(joined))
    changed = F.size(F.filter(F.col(found), lambda f: f["new"].isNotNull()))
    return rows.select(*(new_text.alias(c) if c == text_col else F.col(f"`{c}`") for c in keep), F.when(F.col(found).isNull(), 0).otherwise(changed).cast("long").alias("n_values"))
