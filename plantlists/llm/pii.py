"""Format-preserving pseudonyms for personal data, in SQL expressions only.

A validated value is permuted within its own format by a keyed Feistel network, so the same value always gets the same
pseudonym, in every document, and different values of one kind stay different:

* numbers of 9 to 19 digits, as a run, in groups, or written as telephone numbers: the digits are permuted, separators stay. The
  digits but the last are permuted; the last one's distance from the right (Luhn) check digit is 0 exactly if it was 0 before, so
  payment cards become cards, other numbers become numbers that are none, and two ways to write a number stay linked;
* IBANs with right check digits: digits and letters are moved, the country stays, the check digits become right ones;
* dates (ISO, d.m.y, and m/d/y where the second field can't be a month): the day number is permuted within 1900-2099, or within its
  century elsewhere. A date is written like the value, with leading zeros only where the value has them or can't show it;
* IPv4 addresses: the 32-bit value is permuted;
* e-mail addresses (up to 64 characters before the sign, RFC 5321): name and host are permuted letter by letter within letters and
  digit by digit within digits, so dots stay.

A d/m/y and an m/d/y date may get pseudonyms that read the same; they are kinds of their own.

The network works on a number below a bound N: it is split as a * L + b, and each of ROUNDS rounds adds a keyed digest of one
half to the other modulo that half's size. Each round can be undone, so the whole is a permutation of 0..N-1.

All patterns have bounded repetitions or none that can be split in two ways, so texts of any length and make take linear time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Public, for tests and the registered query only: who knows the key can undo all pseudonyms. A production key comes from the caller's secret store.
KEY = "example-key"
_EMAIL = r"[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,24}"
_IP = r"(?:\d{1,3}\.){3}\d{1,3}"
_ISO = r"\d{4}-\d{2}-\d{2}"
_DMY = r"\d{1,2}[./]\d{1,2}[./]\d{4}"
_GROUPED = r"(?=(?:\d[ -]?){9})\d{2,6}(?:[ -]\d{2,6}){2,5}"
_DOTTED = r"\d{3}\.\d{3}\.\d{4}"
_RUN = r"\d{9,19}"
_PHONE = r"\+\d[\d ().-]{6,18}\d|\(\d{2,5}\) ?\d{3,4}[ .-]\d{4}"
_IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
#: All formats, the longer ones first. Values do not continue into letters or digits on either side.
PATTERN = rf"(?<![A-Za-z0-9._%+-])(?:{_EMAIL}|{_PHONE}|{_IBAN})(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:{_IP}(?!\.?\d)|{_ISO}|{_DMY}|{_DOTTED}|{_GROUPED}|{_RUN})(?![A-Za-z0-9])"


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x computed once, and named in the expression instead of copied."""
    return F.transform(F.array(x), use)[0]


def _digest(key: str, tag: str, x: Column) -> Column:
    """56 bits of a keyed digest of x."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|{tag}|"), x.cast("string")), 256), 1, 14), 16, 10).cast("long")


def _rounds(a: Column, b: Column, left: Column, right: Column, key: str, tag: str, salt: Column) -> Column:
    """The struct (a, b) after all rounds: even ones move a by a digest of b, odd ones b by a digest of a."""

    def step(s: Column, k: Column) -> Column:
        digest = lambda x: _digest(key, tag, F.concat_ws("|", k, salt, x))
        even = k % 2 == 0
        return F.struct(F.when(even, F.pmod(s["a"] + digest(s["b"]), left)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(F.pmod(s["b"] + digest(s["a"]), right)).alias("b"))

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), F.struct(a.alias("a"), b.alias("b")), step)


def permuted(x: Column, left: Column, right: Column, key: str, tag: str, salt: Column | None = None) -> Column:
    """Feistel permutation of 0 <= x < left * right (numbers below 2**52)."""
    moved = lambda x: _rounds(F.floor(x / right).cast("long"), F.pmod(x, right).cast("long"), left, right, key, tag, F.lit("") if salt is None else salt)
    return _let(_let(x, moved), lambda out: out["a"] * right + out["b"])


def _permuted_digits(digits: Column, key: str, tag: str) -> Column:
    """A string of 1 to 36 digits, permuted among strings of its length: halves of at most 18 digits move each other."""

    def moved(s: Column) -> Column:
        a, b = s["d"].substr(F.lit(1), s["n"] - s["low"]).cast("long"), F.coalesce(s["d"].substr(s["n"] - s["low"] + 1, s["low"]).try_cast("long"), F.lit(0))
        left, right = (F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("long") for k in (s["n"] - s["low"], s["low"]))
        both = lambda out: F.concat(F.lpad(out["a"].cast("string"), s["n"] - s["low"], F.lit("0")), F.when(s["low"] > 0, F.lpad(out["b"].cast("string"), s["low"], F.lit("0"))).otherwise(""))
        return _let(_rounds(a, b, left, right, key, tag, s["n"]), both)

    return _let(_let(digits, lambda d: F.struct(d.alias("d"), F.length(d).alias("n"), F.floor(F.length(d) / 2).cast("int").alias("low"))), moved)


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits where every second one from the right, the last one's neighbour first, is doubled (9 taken off above 9)."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(d, F.lit(0), lambda s, x: s + x)


def _refilled(value: Column, digits: Column, places: str = "[0-9]") -> Column:
    """value with its digits (or other characters of `places`) replaced, in order, by those of digits."""
    cells = F.transform(F.split(value, ""), lambda c: F.struct(c.alias("c"), c.rlike(places).cast("int").alias("d")))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def filled(new: Column) -> Column:
        step = lambda s, x: F.struct(F.concat(s["out"], F.when(x["d"] == 1, new.substr(s["next"], F.lit(1))).otherwise(x["c"])).alias("out"), (s["next"] + x["d"]).alias("next"))
        return F.aggregate(cells, start, step, lambda s: s["out"])

    return _let(digits, filled)


def _number(digits: Column, key: str) -> Column:
    """A string of 9 to 19 digits moved among strings of its length; what ends in the right check digit still does, and nothing else."""

    def moved(d: Column) -> Column:
        body = d.substr(F.lit(1), F.length(d) - 1)
        off = F.pmod(F.substring(d, -1, 1).cast("int") - _check_digit(body), F.lit(10))
        new = F.struct(_permuted_digits(body, key, "number").alias("body"), off.alias("off"))
        off = lambda m: F.when(m["off"] == 0, F.lit(0)).otherwise(1 + F.pmod(m["off"] - 1 + _digest(key, "last", m["body"]), F.lit(9)))
        return _let(new, lambda m: F.concat(m["body"], F.pmod(_check_digit(m["body"]) + off(m), F.lit(10)).cast("int").cast("string")))

    return _let(digits, moved)


def _check_digit(body: Column) -> Column:
    return F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10))


def _mod97(text: Column) -> Column:
    """The number that a string of digits and letters (A = 10 ... Z = 35) stands for, modulo 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.split(text, ""), value), F.lit(0), lambda r, v: F.pmod(F.when(v > 9, r * 100).otherwise(r * 10) + v, F.lit(97)))


def _iban(value: Column, key: str) -> Column:
    def moved(s: Column) -> Column:
        letter = lambda m: lambda c, i: F.when(c.rlike("[A-Z]"), F.char(65 + F.pmod(F.ascii(c) - 65 + _digest(key, "iban-letter", F.concat_ws("|", s["country"], m, i)), F.lit(26)))).otherwise(c)
        account = lambda m: _refilled(F.array_join(F.transform(F.split(s["account"], ""), letter(m)), ""), m)
        check = lambda a: F.lpad((98 - _mod97(F.concat(a, s["country"], F.lit("00")))).cast("string"), 2, F.lit("0"))
        new = _let(F.when(s["digits"] == "", "").otherwise(_permuted_digits(s["digits"], key, "iban")), account)
        return _let(new, lambda a: F.concat(s["country"], check(a), a))

    plain = F.replace(value, F.lit(" "), F.lit(""))
    country, account = F.substring(plain, 1, 2), plain.substr(F.lit(5), F.length(plain) - 4)
    valid = F.length(plain).between(15, 34) & (_mod97(F.concat(account, F.substring(plain, 1, 4))) == 1) & F.substring(plain, 3, 2).between("02", "98")
    parts = F.struct(country.alias("country"), account.alias("account"), F.regexp_replace(account, "[^0-9]", "").alias("digits"))
    return F.when(valid, _refilled(value, _let(parts, moved), "[A-Z0-9]")).otherwise(value)


def pseudonym(value: Column, key: str = KEY) -> Column:
    """The pseudonym of one found value; a value that fails its format's test comes back unchanged."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    numbers = F.when(F.length(digits).between(9, 19), _refilled(value, _number(digits, key))).otherwise(value)
    octets = F.transform(F.split(value, r"\."), lambda o: o.try_cast("long"))
    address = F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o)
    dotted = lambda x: F.concat_ws(".", *(F.pmod(F.shiftrightunsigned(x, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)))
    moved = _let(permuted(address, F.lit(1 << 16), F.lit(1 << 16), key, "ip"), dotted)
    sound = F.forall(octets, lambda o: o.between(0, 255)) & (F.concat_ws(".", octets.cast("array<string>")) == value)
    return (
        F.when(value.contains("@"), _email(value, key))
        .when(value.rlike("^[A-Z]"), _iban(value, key))
        .when(value.rlike(rf"^{_IP}$"), F.when(sound, moved).otherwise(value))
        .when(value.rlike(rf"^(?:{_ISO}|{_DMY})$"), _date(value, key))
        .otherwise(numbers)
    )


def _moved_day(parsed: Column, key: str) -> Column:
    """The date of the permuted day number, in 1900-2099 or in the date's century; null for years before 1."""

    def range_of(d: Column) -> Column:
        year = F.year(d)
        century = year - F.pmod(year, F.lit(100))
        # days of a range as a product of two: 11 * 6641 = 73051 is two more than 1900-2099 has, 75 * 487 and 92 * 397 are the centuries
        near, whole = year.between(1900, 2099), F.pmod(century, F.lit(400)) == 0
        left, right = F.when(near, 11).when(whole, 75).otherwise(92), F.when(near, 6641).when(whole, 487).otherwise(397)
        return F.struct(d.alias("d"), near.alias("near"), F.when(near, 1900).otherwise(century).alias("first"), left.cast("long").alias("left"), right.cast("long").alias("right"))

    def moved(r: Column) -> Column:
        begin = F.make_date(r["first"], F.lit(1), F.lit(1))
        once = lambda x: permuted(x, r["left"], r["right"], key, "date", r["first"])
        # the two numbers beyond the range are walked through, so the days among themselves are permuted
        walk = lambda y: F.when(r["near"] & (y >= 73_049), once(y)).otherwise(y)
        return F.date_add(begin, _let(_let(once(F.datediff(r["d"], begin).cast("long")), walk), walk).cast("int"))

    return F.when(F.year(parsed) >= 1, _let(_let(parsed, range_of), moved))


def _date(value: Column, key: str) -> Column:
    """A date in the value's own order of fields, marks and use of leading zeros."""
    fields = F.split(value, r"[-./]")
    iso, month_first = value.contains("-"), value.contains("/") & (fields[1].cast("int") > 12)
    order = F.struct(
        F.when(iso, fields[0]).otherwise(fields[2]).alias("year"), F.when(iso | ~month_first, fields[1]).otherwise(fields[0]).alias("month"), F.when(iso, fields[2]).when(month_first, fields[1]).otherwise(fields[0]).alias("day"),
        iso.alias("iso"), month_first.alias("month_first"), F.regexp_extract_all(value, F.lit(r"[-./]"), F.lit(0)).alias("marks"),
    )

    def written(o: Column) -> Column:
        parsed = F.try_to_date(F.concat_ws("-", o["year"], F.lpad(o["month"], 2, F.lit("0")), F.lpad(o["day"], 2, F.lit("0"))), "yyyy-MM-dd")
        bare = lambda own, other: (F.length(own) == 1) | ((F.length(other) == 1) & ~own.startswith("0"))
        padded = lambda x, own, other: F.when(bare(own, other), x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, F.lit("0")))

        def whole(new: Column) -> Column:
            y, m, d = F.lpad(F.year(new).cast("string"), 4, F.lit("0")), padded(F.month(new), o["month"], o["day"]), padded(F.day(new), o["day"], o["month"])
            fields = F.when(o["iso"], F.array(y, m, d)).when(o["month_first"], F.array(m, d, y)).otherwise(F.array(d, m, y))
            return F.concat(fields[0], o["marks"][0], fields[1], o["marks"][1], fields[2])

        return _let(_moved_day(parsed, key), whole)

    return F.coalesce(_let(order, written), value)


def _email(value: Column, key: str) -> Column:
    """Letters and digits of the address moved by keyed amounts that hang on the whole shape and on all characters before.

    Each character is moved within its class by a digest of what stands before it, so the first place where two addresses
    differ still differs and the map can be undone from left to right. The top-level name stays.
    """
    low = F.lower(value)
    name = F.regexp_replace(low, r"\.[a-z]+$", "")
    tail = F.regexp_extract(low, r"(\.[a-z]+)$", 1)
    chars = F.transform(F.split(name, ""), lambda c, i: F.struct(c.alias("c"), F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|mail|"), name.substr(F.lit(1), i)), 256), 1, 8), 16, 10).cast("long").alias("by")))
    letters, digits = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("0123456789")
    moved = F.transform(
        chars,
        lambda x: F.when(x["c"].rlike("[a-z]"), letters.substr((F.pmod(F.ascii(x["c"]) - 97 + x["by"], F.lit(26)) + 1).cast("int"), F.lit(1)))
        .when(x["c"].rlike("[0-9]"), digits.substr((F.pmod(F.ascii(x["c"]) - 48 + x["by"], F.lit(10)) + 1).cast("int"), F.lit(1)))
        .otherwise(x["c"]),
    )
    return F.concat(F.array_join(moved, ""), tail)


def pseudonymised(docs: DataFrame, key: str = KEY, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, text with pseudonyms, n_found (values met), n_changed, values (their pseudonyms, in order).

    A null text stays null with no values. Values keep their places and lengths but for dates written without leading zeros. Texts
    without a digit or an at sign pass unchanged. A null or repeated doc_id is a row like others, repeated rows give equal rows,
    an empty table gives an empty table. Other columns are ignored. Without a key the public KEY is used.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    some = F.col("text").rlike("[0-9@]")
    found = F.when(some, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = source.withColumn("found", F.coalesce(found, F.array().cast("array<string>")))
    rows = rows.withColumn("values", F.transform("found", lambda v: pseudonym(v, key)))
    between = F.split("text", PATTERN, -1)
    woven = F.concat(F.concat_ws("", F.flatten(F.zip_with(between, "values", lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))))))
    changed = F.size(F.filter(F.zip_with("found", "values", lambda a, b: a != b), lambda x: x))
    return rows.select("doc_id", F.when(F.size("found") == 0, F.col("text")).otherwise(woven).alias("text"), F.size("found").alias("n_found"), changed.alias("n_changed"), "values")
