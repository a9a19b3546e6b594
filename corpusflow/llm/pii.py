"""Personal data replaced by format-preserving pseudonyms, with DataFrame functions only.

Candidates are found by one pattern. Those that hold as what they look like (card numbers by
their check digit, accounts by theirs, dates by the calendar, addresses and numbers by their
ranges) are replaced by another value of the same format: a keyed Feistel network permutes the
format's whole range, so equal values get equal pseudonyms in every document, different ones
stay different, and check digits and dates stay valid. Whatever fails validation is left as it
is, and so is a value that touches a letter or digit (but for the time of a timestamp) or goes on
as a longer number. Without the key the values cannot be computed back; keep it out of logs.

Every round adds a keyed digest of one half to the other half, modulo that half's range, which
permutes any range that is a product of two numbers: ten to the digits, 2^16 x 2^16 for
addresses, 189 x 773 for the 146,097 days of 400 years. Letters and digits of names and accounts
are shifted within their own class.

Rows are worked on by themselves, without a shuffle and without Python. A null text stays null
with nothing found; empty, repeated and very long texts and empty tables need no special case.
A column named like the result is replaced, others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.frames import fresh, without

ROUNDS = 10
FIRST_DAY = "1800-01-01"  # 400 years have 146,097 days wherever they begin
DAYS = (189, 773)

# Bounded as mail names and domains are, so that no text makes the search quadratic or deep.
EMAIL = r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,127}"
ACCOUNT = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
ISO_DATE = r"\d{4}-\d{2}-\d{2}"
POINT_DATE = r"\d{1,2}\.\d{1,2}\.\d{4}"
SLASH_DATE = r"\d{1,2}/\d{1,2}/\d{4}"
SOCIAL = r"\d{3}-\d{2}-\d{4}"
ADDRESS = r"\d{1,3}(?:\.\d{1,3}){3}"
CARD = r"(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})"
PHONE = (
    r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}"
    r"|\(\d{3}\) ?\d{3}[.-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})"
)
KINDS = {
    "email": EMAIL,
    "account": ACCOUNT,
    "iso_date": ISO_DATE,
    "point_date": POINT_DATE,
    "slash_date": SLASH_DATE,
    "social": SOCIAL,
    "address": ADDRESS,
    "card": CARD,
    "phone": PHONE,
}
# What a longer value of the same kind would go on with; a comma ends every value.
LONGER = {
    "email": r"[.-]\p{N}",
    "point_date": r"\.\p{N}",
    "social": r"-\p{N}",
    "address": r"\.\p{N}",
    "card": r"[.-]\p{N}",
    "phone": r"[.-]\p{N}",
}
TIME = r"(?=[Tt]\d{2}(?!\p{L})|[Zz](?![\p{L}\p{N}]))"  # of a timestamp, or its zone


def _ended(kind: str) -> str:
    longer = f"|{LONGER[kind]}" if kind in LONGER else ""
    apart = rf"(?![\p{{L}}\p{{N}}@]{longer})"
    return KINDS[kind] + (f"(?:{apart}|{TIME})" if kind.endswith("date") else apart)


CANDIDATE = r"(?<![\p{L}\p{N}+])(?:" + "|".join(map(_ended, KINDS)) + ")"


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def permuted(x: Column, a: Column, b: Column, tweak: Column, key: str) -> Column:
    """Keyed permutation of 0 <= x < a * b (at most 10^18)."""

    def turn(s: Column, i: Column) -> Column:
        drawn = _number(F.substring(_digest(key, tweak, i, s["r"]), 1, 15))
        bound = F.when(i % 2 == 0, a).otherwise(b)
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + drawn, bound).alias("r"))

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        F.struct(_div(x, b).alias("l"), (x % b).alias("r")),
        turn,
        lambda s: s["l"] * b + s["r"],
    )


def permuted_digits(digits: Column, tweak: str, key: str) -> Column:
    """A string of 1 to 18 digits as another one of the same length."""
    n = F.length(digits)

    def power(k: Column) -> Column:
        return F.pow(F.lit(10.0), k).cast("long")

    half = _div(n, F.lit(2)).cast("int")
    moved = permuted(
        digits.cast("long"),
        power(n - half),
        power(half),
        F.concat(F.lit(tweak), n.cast("string")),
        key,
    )
    return F.lpad(moved.cast("string"), n, "0")


def shifted(text: Column, tweak: str, key: str) -> Column:
    """A string as another one with digits, small and capital letters in the same places."""

    def shift(part: Column, other: Column, i: Column) -> Column:
        def character(j: Column) -> Column:
            c = F.substr(part, j, F.lit(1))
            draw = _digest(key, F.lit(tweak), i, _div(j, F.lit(16)), other)
            step = _number(F.substr(draw, (j % 16).cast("int") * 4 + 1, F.lit(4)))

            def turned(first: str, size: int) -> Column:
                start = ord(first)
                return F.char(F.pmod(F.ascii(c) - start + step, F.lit(size)) + start)

            return (
                F.when(c.between("0", "9"), turned("0", 10))
                .when(c.between("a", "z"), turned("a", 26))
                .when(c.between("A", "Z"), turned("A", 26))
                .otherwise(c)
            )

        places = F.sequence(F.lit(1), F.length(part))
        return F.when(F.length(part) == 0, part).otherwise(
            F.array_join(F.transform(places, character), "")
        )

    half = _div(F.length(text) + 1, F.lit(2)).cast("int")
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        F.struct(
            F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r")
        ),
        lambda s, i: F.struct(s["r"].alias("l"), shift(s["l"], s["r"], i).alias("r")),
        lambda s: F.concat(s["l"], s["r"]),
    )


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refilled(shape: Column, new: Column, old: str = "0-9") -> Column:
    """``shape`` with its characters of the class ``old`` replaced by those of ``new``, in order."""

    def character(i: Column) -> Column:
        c = F.substr(shape, i, F.lit(1))
        seen = F.length(F.regexp_replace(F.substr(shape, F.lit(1), i), f"[^{old}]", ""))
        return F.when(c.rlike(f"[{old}]"), F.substr(new, seen, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), character), "")


def luhn_digit(payload: Column) -> Column:
    """Check digit of a string of digits: every second one from the right counts double."""
    n = F.length(payload)

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(payload, n - i + 1, F.lit(1)).cast("int")
        double = digit * 2
        return total + F.when(
            i % 2 == 1, F.when(double > 9, double - 9).otherwise(double)
        ).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def account_digits(body: Column, country: Column) -> Column:
    """Check digits of an account: 98 less its number with letters as 10 to 35, modulo 97."""
    text = F.concat(body, country, F.lit("00"))

    def add(rest: Column, i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        letter = c.between("A", "Z")
        value = F.when(letter, F.ascii(c) - 55).otherwise(c.try_cast("int"))
        return (rest * F.when(letter, 100).otherwise(10) + value) % 97

    rest = F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _email(hit: Column, key: str) -> Column:
    name = F.substring_index(hit, "@", 1)
    return F.concat(shifted(name, "email", key), F.lit("@"), F.substring_index(hit, "@", -1))


def _account(hit: Column, key: str) -> Column:
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    country, body = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
    holds = account_digits(body, country) == F.substr(plain, F.lit(3), F.lit(2))
    moved = shifted(body, "account", key)
    new = F.concat(country, account_digits(moved, country), moved)
    return F.when(holds, refilled(hit, new, "A-Z0-9"))


def _date(hit: Column, key: str, part: tuple[int, int, int], separator: str) -> Column:
    """``part`` holds the places of year, month and day between the separators."""
    year, month, day = (F.split_part(hit, F.lit(separator), F.lit(p)) for p in part)
    y, m, d = (c.cast("int") for c in (year, month, day))
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    holds = y.between(1800, 2199) & m.between(1, 12) & d.between(1, last)
    first = F.lit(FIRST_DAY).cast("date")
    number = F.datediff(F.make_date(y, m, d), first).cast("long")
    moved = permuted(number, F.lit(DAYS[0]), F.lit(DAYS[1]), F.lit("date"), key)
    new = F.date_add(first, moved.cast("int"))
    fields = {
        part[0]: F.year(new).cast("string"),
        part[1]: F.lpad(F.month(new).cast("string"), 2, "0"),
        part[2]: F.lpad(F.dayofmonth(new).cast("string"), 2, "0"),
    }
    # A field written without a leading zero stays so.
    for place, old in ((part[1], month), (part[2], day)):
        fields[place] = F.when(F.length(old) == 2, fields[place]).otherwise(
            fields[place].cast("int").cast("string")
        )
    return F.when(holds, F.concat_ws(separator, *[fields[p] for p in (1, 2, 3)]))


def _slash_date(hit: Column, key: str) -> Column:
    """Month first; where that is no date, day first."""
    return F.coalesce(_date(hit, key, (3, 1, 2), "/"), _date(hit, key, (3, 2, 1), "/"))


def _social(hit: Column, key: str) -> Column:
    area, group, serial = (
        F.split_part(hit, F.lit("-"), F.lit(p)).cast("long") for p in (1, 2, 3)
    )
    holds = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas
    moved = permuted(
        (place * 99 + group - 1) * 9999 + serial - 1,
        F.lit(898 * 99),
        F.lit(9999),
        F.lit("social"),
        key,
    )
    front = _div(moved, F.lit(9999))
    new_place = _div(front, F.lit(99))
    new_area = F.when(new_place >= 665, new_place + 2).otherwise(new_place + 1)
    return F.when(
        holds,
        F.concat_ws(
            "-",
            F.lpad(new_area.cast("string"), 3, "0"),
            F.lpad((front % 99 + 1).cast("string"), 2, "0"),
            F.lpad((moved % 9999 + 1).cast("string"), 4, "0"),
        ),
    )


def _address(hit: Column, key: str) -> Column:
    parts = [F.split_part(hit, F.lit("."), F.lit(p)).cast("long") for p in (1, 2, 3, 4)]
    holds = (parts[0] <= 255) & (parts[1] <= 255) & (parts[2] <= 255) & (parts[3] <= 255)
    number = ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3]
    moved = permuted(number, F.lit(65536), F.lit(65536), F.lit("address"), key)
    new = [_div(moved, F.lit(256**k)) % 256 for k in (3, 2, 1, 0)]
    return F.when(holds, F.concat_ws(".", *[n.cast("string") for n in new]))


def _card(hit: Column, key: str) -> Column:
    digits = only_digits(hit)
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    holds = luhn_digit(body) == F.substr(digits, F.length(digits))
    moved = permuted_digits(body, "card", key)
    return F.when(holds, refilled(hit, F.concat(moved, luhn_digit(moved))))


def _phone(hit: Column, key: str) -> Column:
    """The country code stays where a separator marks its end."""
    code = F.regexp_extract(hit, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substr(hit, F.length(code) + 1)
    digits = only_digits(rest)
    holds = F.length(digits).between(6, 18) & (F.length(only_digits(hit)) <= 18)
    return F.when(holds, F.concat(code, refilled(rest, permuted_digits(digits, "phone", key))))


PSEUDONYMS = {
    "email": _email,
    "account": _account,
    "iso_date": lambda hit, key: _date(hit, key, (1, 2, 3), "-"),
    "point_date": lambda hit, key: _date(hit, key, (3, 2, 1), "."),
    "slash_date": _slash_date,
    "social": _social,
    "address": _address,
    "card": _card,
    "phone": _phone,
}


def pseudonym(hit: Column, key: str) -> Column:
    """Kind and replacement of a candidate; both null where it does not hold as anything."""
    chosen = None
    for kind, pattern in KINDS.items():
        new = F.struct(
            F.lit(kind).alias("kind"), PSEUDONYMS[kind](hit, key).alias("value")
        )
        fits = hit.rlike(f"^(?:{pattern})$")
        chosen = F.when(fits, new) if chosen is None else chosen.when(fits, new)
    return chosen


def pseudonymize(
    docs: DataFrame, key: str, text: str = "text", found: str = "pii"
) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``found``: the kinds replaced, in text order."""
    value = F.col(text)
    may_hold = value.rlike("[0-9@]")
    hits, made = fresh(docs, "hits", "new")
    new = F.col(made)
    replaced = docs.select(
        *without(docs, [found]),
        F.when(may_hold, F.regexp_extract_all(value, F.lit(CANDIDATE), 0)).alias(hits),
    ).withColumn(
        made,
        F.when(F.size(hits) > 0, F.transform(hits, lambda h: pseudonym(h, key))),
    )
    gaps = F.split(value, CANDIDATE)
    rebuilt = F.array_join(
        F.transform(
            gaps,
            lambda gap, i: F.concat(
                gap,
                F.coalesce(F.get(new, i)["value"], F.get(F.col(hits), i), F.lit("")),
            ),
        ),
        "",
    )
    held = F.filter(new, lambda h: h["value"].isNotNull())
    out = [
        F.when(new.isNotNull(), rebuilt).otherwise(value).alias(c)
        if c.lower() == text.lower()
        else F.col(c)
        for c in without(docs, [found])
    ]
    kinds = F.coalesce(
        F.transform(held, lambda h: h["kind"]), F.array().cast("array<string>")
    ).alias(found)
    return replaced.select(*out, kinds)
