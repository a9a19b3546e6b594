"""Pseudonyms against a plain Python form of the same network, and their formats."""

import datetime
import hashlib
import re

from pyspark.sql import functions as F

from corpusflow.llm import pii

KEY = "test key"


def digest(*parts):
    return hashlib.sha256("|".join(map(str, [KEY, *parts])).encode()).hexdigest()


def feistel(x, a, b, tweak):
    left, right = divmod(x, b)
    for i in range(pii.ROUNDS):
        drawn = int(digest(tweak, i, right)[:15], 16)
        left, right = right, (left + drawn) % (a if i % 2 == 0 else b)
    return left * b + right


def feistel_digits(text, tweak):
    n = len(text)
    half = n // 2
    return str(feistel(int(text), 10 ** (n - half), 10**half, f"{tweak}{n}")).zfill(n)


def luhn(text):
    total = 0
    for i, c in enumerate(reversed(text)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def masked(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [(r["text"], r["pii"]) for r in pii.pseudonymize(df, KEY).orderBy("doc_id").collect()]


def test_network_equals_plain_form_and_permutes(spark):
    a, b = 9, 7
    x = F.col("id")
    rows = spark.range(a * b).select(
        "id", pii.permuted(x, F.lit(a), F.lit(b), F.lit("t"), KEY).alias("y")
    )
    found = {r["id"]: r["y"] for r in rows.collect()}
    assert found == {i: feistel(i, a, b, "t") for i in range(a * b)}
    assert sorted(found.values()) == list(range(a * b))


def test_strings_permute_within_their_shape(spark):
    rows = spark.range(26 * 10).select(
        F.concat(F.char(F.lit(97) + F.col("id") % 26), F.lit("."), (F.col("id") / 26).cast("int").cast("string")).alias("s")
    )
    found = [r["y"] for r in rows.select(pii.shifted(F.col("s"), "t", KEY).alias("y")).collect()]
    assert len(set(found)) == 260 and all(re.fullmatch(r"[a-z]\.\d", y) for y in found)


def test_cards(spark):
    ((text, kinds), (again, _), (wrong, none)) = masked(
        spark, "4041894974608795, 4041-8949-7460-8795", "x 4041894974608795 y", "4041894974608796"
    )
    new, spaced = text.split(", ")
    assert kinds == ["card", "card"] and new != "4041894974608795" and luhn(new)
    assert spaced.replace("-", "") == new and again == f"x {new} y"
    assert new[:-1] == feistel_digits("404189497460879", "card")
    assert (wrong, none) == ("4041894974608796", [])


def test_dates(spark):
    ((text, kinds),) = masked(spark, "2024-02-29 2023-02-29 29.2.2024 12/31/2001 31/12/2001 1799-01-01")
    iso, bad, point, month_first, day_first, early = text.split(" ")
    assert kinds == ["iso_date", "point_date", "slash_date", "slash_date"]
    assert (bad, early) == ("2023-02-29", "1799-01-01")
    first = datetime.date(1800, 1, 1)
    wanted = first + datetime.timedelta(
        feistel((datetime.date(2024, 2, 29) - first).days, *pii.DAYS, "date")
    )
    assert iso == wanted.isoformat()
    assert point == f"{wanted.day:02d}.{wanted.month}.{wanted.year}"
    assert datetime.datetime.strptime(month_first, "%m/%d/%Y") == datetime.datetime.strptime(day_first, "%d/%m/%Y")


def test_all_days_permute(spark):
    n = pii.DAYS[0] * pii.DAYS[1]
    first = datetime.date(1800, 1, 1)
    assert (datetime.date(2200, 1, 1) - first).days == n


def test_other_kinds(spark):
    ((text, kinds),) = masked(
        spark,
        "Mail bo.42@mail8.example.com, call +1 (988) 555-2485 or (988) 555-2485; 42.144.35.254. "
        "DE89 3704 0044 0532 0130 00; 123-45-6789; 666-45-6789; 300.1.1.1",
    )
    assert kinds == ["email", "phone", "phone", "address", "account", "social"]
    m = re.fullmatch(
        r"Mail ([a-z]{2}\.\d{2})@mail8\.example\.com, call \+1 (\(\d{3}\) \d{3}-\d{4}) or (\(\d{3}\) \d{3}-\d{4}); "
        r"(\d+\.\d+\.\d+\.\d+)\. (DE\d{2} \d{4} \d{4} \d{4} \d{4} \d{2}); (\d{3}-\d{2}-\d{4}); 666-45-6789; 300\.1\.1\.1",
        text,
    )
    assert m and m[2] == m[3]
    plain = m[5].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    number = (42 << 24) + (144 << 16) + (35 << 8) + 254
    new = feistel(number, 65536, 65536, "address")
    assert m[4] == ".".join(str(new >> s & 255) for s in (24, 16, 8, 0))


def test_rows_and_timestamps(spark):
    cells = ["1990-01-02", "4111111111111111", "10.0.0.1", "123-45-6789", "3.4.1990", "5/6/1990",
             "DE89370400440532013000", "(988) 555-2485", "+47 22 33 44 55", "a.b@c1.example"]
    kinds = ["iso_date", "card", "address", "social", "point_date", "slash_date", "account",
             "phone", "phone", "email"]
    alone = [masked(spark, c)[0] for c in cells]
    assert [k for _, k in alone] == [[k] for k in kinds]
    new = [t for t, _ in alone]
    for i in range(len(cells)):  # every value before every other and before a plain number
        old_row, new_row = (",".join([*r[i:], *r[:i], "7"]) for r in (cells, new))
        assert masked(spark, old_row) == [(new_row, kinds[i:] + kinds[:i])]
    date = new[0]
    rests = ["T03:04:05Z", "T03:04:05.678+02:00", "t0304", "T03", "Z", "-1", ".5", " 03:04:05,123"]
    for text, found in masked(spark, *(cells[0] + r for r in rests)):
        assert found == ["iso_date"] and text.startswith(date)
    ((log, found),) = masked(
        spark, "1990-01-02T03:04:05Z,10.0.0.1,10.0.0.1-10.0.0.1;1990-01-02-1990-01-02,3.4.1990-3.4.1990"
    )
    assert log == (
        f"{date}T03:04:05Z,{new[2]},{new[2]}-{new[2]};{date}-{date},{new[4]}-{new[4]}"
    )
    assert len(found) == 8


def test_longer_numbers_and_words_are_left(spark):
    texts = ["4111111111111111.5", "4111-1111-1111-1111-1", "123-45-6789-1", "3.4.1990.5",
             "988-555-2485-1", "1990-01-02nd", "1990-01-02Tue", "1990-01-021", "4111111111111111a"]
    assert masked(spark, *texts) == [(t, []) for t in texts]


def test_other_key_other_values_and_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "4041894974608795")], "doc_id int, text string")
    a, b = (pii.pseudonymize(df, k).first()["text"] for k in ("a", "b"))
    assert a != b
    plan = pii.pseudonymize(df, "a")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_nothing_left_of_planted_values(spark):
    from corpusflow.llm import queries

    sf_dir = "/root/testdata/sf0.01"
    before = {r["doc_id"]: r["text"] for r in queries.documents(spark, sf_dir).collect()}
    values = re.compile(r"[\w.]+@[\w.]+\w|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b")
    for row in queries.op9_pii(spark, sf_dir).collect():
        old = values.findall(before[row["doc_id"]])
        new = values.findall(row["text"])
        # Sixteen digits with a wrong check digit are no card and stay.
        decoys = {v for v in old if re.fullmatch(r"\d{16}", v) and not luhn(v)}
        assert len(old) == len(new) and set(old) & set(new) == decoys
        assert values.sub("", before[row["doc_id"]]) == values.sub("", row["text"])


LONG_RUNS = ["a.", "-", "_", "%", ".", "+", "x@a.", "x@", "1.", "AA11 ", "+1 "]


def test_long_runs_of_symbols_neither_overflow_nor_take_long(spark):
    """A megabyte of each, with a card behind it that must still be found."""
    import time

    texts = [unit * (1_000_000 // len(unit)) + " 4111111111111111 " for unit in LONG_RUNS]
    texts.append("x@" + "a." * 500_000 + "com 4111111111111111 ")
    masked(spark, "warm")
    begin = time.perf_counter()
    found = masked(spark, *texts)
    assert time.perf_counter() - begin < 5 * len(texts)
    assert all("card" in kinds and "4111111111111111" not in text for text, kinds in found)


def test_bounds_of_mail_addresses(spark):
    ok = ["john.doe@mail.example.com", "a" * 64 + "@b.de", "x@" + "y" * 63 + ".org", "x@" + "a." * 100 + "com"]
    for text, kinds in masked(spark, *ok):
        assert kinds == ["email"] and text not in ok
    for text, kinds in masked(spark, "a" * 65 + "@b.de", "x@" + "y" * 64 + ".org"):
        assert kinds == []
    [(text, kinds)] = masked(spark, "-" * 70 + "john@example.org")
    assert kinds == ["email"] and "john" not in text and text.endswith("@example.org")
