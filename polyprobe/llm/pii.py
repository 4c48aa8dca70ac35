"""Format-preserving pseudonyms for personal data and secrets, as column expressions only.

Every match is replaced by a keyed permutation of itself within its own format,
so the same value becomes the same pseudonym in every document and distinct
values stay distinct.  Strings run through a Feistel network whose halves are
characters: each round shifts the letters and digits of one half by a stream
drawn from the other, and letters stay letters of the same case and digits
digits.  Numbers with rules of their own are permuted as pairs (a, b) with
``0 <= a < A`` and ``0 <= b < B`` whose product counts exactly the valid values,
so no result is invalid and none has to be retried:

* card numbers (13-19 digits, Luhn): all digits but the last, which is recomputed
* IPv4 addresses: two 16-bit halves
* social security numbers: 898 areas x 99 groups by 9,999 serials
* dates: the 146,097 = 189 x 773 days of 1700-01-01 to 2099-12-31; dates with
  "/" that only read day first stay among those, so that no pseudonym reads
  both ways: days 13 to 28 by 4,800 months, days 29, 30 and 31 by the years and
  the months that have them, 29 February by the 97 leap years

Numbers and dates that fail validation are left as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
_DAYS = (189, 773)
_FIRST_DAY = "1700-01-01"

#: What is looked for; earlier kinds win where several could start at one place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "secret": r"(?<![\p{L}\p{N}])AKIA[0-9A-Z]{16}(?![\p{L}\p{N}])"
              r"|(?<![\p{L}\p{N}])(?i:password|passwd|token|secret|api[_-]?key) ?[=:] ?[\"']?[A-Za-z0-9_-]{8,}",
    "date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/])\d{1,2}/\d{1,2}/\d{4}(?![\d/])"
            r"|(?<![\d.])\d{1,2}\.\d{1,2}\.\d{4}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "phone": r"(?<!\d)\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
             r"|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<!\d)\d{13,19}(?!\d)|(?<![\d-])\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?![\d-])"
            r"|(?<![\d-])\d{4}([ -])\d{6}\2\d{5}(?![\d-])",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _draw(key: str, *parts: Column) -> Column:
    """Whole number below 2**60 from the key and the parts."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def permuted_pair(a: Column, b: Column, size_a: int, size_b: int, key: str) -> Column:
    """Keyed permutation of the pairs below (size_a, size_b), as a struct (a, b)."""
    def step(state: Column, i: Column) -> Column:
        x, y = state["a"], state["b"]
        return F.when(i % 2 == 0, F.struct(F.pmod(x + _draw(key, i, y), F.lit(size_a).cast("bigint")).alias("a"),
                                           y.alias("b"))) \
            .otherwise(F.struct(x.alias("a"), F.pmod(y + _draw(key, i, x), F.lit(size_b).cast("bigint")).alias("b")))

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _shifted(text: Column, other: Column, i: Column, key: str) -> Column:
    """Letters and digits of ``text`` moved within their kind by a stream drawn from ``other``."""
    def char(c: Column, at: Column) -> Column:
        code = F.ascii(c)
        def moved(first: str, n: int) -> Column:
            return F.char(F.lit(ord(first)) + F.pmod(code - ord(first) + _draw(key, i, at, other), F.lit(n)))
        return F.when(c.between("0", "9"), moved("0", 10)).when(c.between("a", "z"), moved("a", 26)) \
            .when(c.between("A", "Z"), moved("A", 26)).otherwise(c)

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.split(text, ""), char), "")).otherwise(text)


def permuted_text(text: Column, key: str) -> Column:
    """Keyed permutation of strings that keeps length, case, kinds of characters and all other characters."""
    def step(state: Column, i: Column) -> Column:
        return F.struct(state["b"].alias("a"), _shifted(state["a"], state["b"], i, key).alias("b"))

    def run(t: Column) -> Column:
        half = F.floor(F.length(t) / 2).cast("int")
        start = F.struct(F.substring(t, F.lit(1), half).alias("a"),
                         F.substring(t, half + 1, F.length(t)).alias("b"))
        end = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
        return _bound(end, lambda e: F.concat(e["a"], e["b"]))

    return _bound(text, run)


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum; ``doubled`` is 1 if every second digit from the right is doubled, 0 if every first is."""
    def value(c: Column, at: Column) -> Column:
        d = c.cast("int") * F.when(at % 2 == doubled, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    values = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(values, F.lit(0), lambda s, v: s + v)


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    def char(c: Column, at: Column) -> Column:
        seen = F.length(F.regexp_replace(F.substring(shape, F.lit(1), at + 1), r"\D", ""))
        return F.when(c.between("0", "9"), F.substring(digits, seen, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(shape, ""), char), "")


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, r"\D", "")

    def run(d: Column) -> Column:
        body = permuted_text(F.substring(d, F.lit(1), F.length(d) - 1), key + "card")
        full = _bound(body, lambda p: F.concat(p, F.pmod(-_luhn_sum(p, 0), F.lit(10)).cast("string")))
        return F.when(_luhn_sum(d, 1) % 10 == 0, _refilled(m, full)).otherwise(m)

    return _bound(digits, run)


def _ip(m: Column, key: str) -> Column:
    def run(p: Column) -> Column:
        n = [p[i].cast("int") for i in range(4)]
        pair = permuted_pair(n[0] * 256 + n[1], n[2] * 256 + n[3], 1 << 16, 1 << 16, key + "ip")
        out = _bound(pair, lambda q: F.concat_ws(".", *[(x).cast("string") for h in ("a", "b") for x in (
            F.shiftright(q[h], 8), q[h].bitwiseAND(F.lit(255)))]))
        return F.when(F.greatest(*n) < 256, out).otherwise(m)

    return _bound(F.split(m, r"\."), run)


def _ssn(m: Column, key: str) -> Column:
    def run(p: Column) -> Column:
        area, group, serial = (p[i].cast("int") for i in range(3))
        index = area - 1 - (area > 666).cast("int")
        pair = permuted_pair(index * 99 + group - 1, serial - 1, 898 * 99, 9999, key + "ssn")

        def shown(q: Column) -> Column:
            at = F.floor(q["a"] / 99)
            return F.format_string("%03d-%02d-%04d", at + 1 + (at >= 665).cast("int"), q["a"] % 99 + 1, q["b"] + 1)

        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        return F.when(valid, _bound(pair, shown)).otherwise(m)

    return _bound(F.split(m, "-"), run)


_FIRST_YEAR = int(_FIRST_DAY[:4])
_LEAP_YEARS = [y for y in range(_FIRST_YEAR, _FIRST_YEAR + 400) if y % 4 == 0 and (y % 100 or y % 400 == 0)]
_MONTHS_WITH = {29: [1, *range(3, 13)], 30: [1, *range(3, 13)], 31: [1, 3, 5, 7, 8, 10, 12]}


def _late_day(day: Column, key: str) -> Column:
    """Permutation of the dates after the twelfth of their month among themselves."""
    y, m, d = F.year(day) - _FIRST_YEAR, F.month(day), F.dayofmonth(day)
    early = _bound(permuted_pair(y * 12 + m - 1, d - 13, 4800, 16, key + "date28"), lambda q: F.make_date(
        (F.floor(q["a"] / 12) + _FIRST_YEAR).cast("int"), (q["a"] % 12 + 1).cast("int"), (q["b"] + 13).cast("int")))
    leap = F.lit(_LEAP_YEARS)
    moved = F.when(d <= 28, early).when((d == 29) & (m == 2), _bound(
        permuted_pair(F.array_position(leap, F.year(day)) - 1, F.lit(0), len(_LEAP_YEARS), 1, key + "date2"),
        lambda q: F.make_date(F.get(leap, q["a"].cast("int")), F.lit(2), F.lit(29))))

    def on(last: int, months: list[int]) -> Callable[[Column], Column]:
        return lambda q: F.make_date((q["a"] + _FIRST_YEAR).cast("int"), F.get(F.lit(months), q["b"].cast("int")), F.lit(last))

    for last, months in _MONTHS_WITH.items():
        pair = permuted_pair(y, F.array_position(F.lit(months), m) - 1, 400, len(months), f"{key}date{last}")
        moved = moved.when(d == last, _bound(pair, on(last, months)))
    return moved


def _date(m: Column, key: str) -> Column:
    def run(p: Column) -> Column:
        mark = F.regexp_extract(m, r"\D", 0)
        # Year first with "-", day first with ".", and with "/" the month first if that is a date, else the day.
        y = F.when(mark == "-", p[0]).otherwise(p[2])
        def day_of(month: Column, day: Column) -> Column:
            return F.try_to_date(F.concat_ws("-", y, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
        us = day_of(p[0], p[1])
        day = F.when(mark == "-", day_of(p[1], p[2])).when(mark == "/", F.coalesce(us, day_of(p[1], p[0]))) \
            .otherwise(day_of(p[1], p[0]))
        day_first = (mark == ".") | ((mark == "/") & us.isNull())
        at = F.datediff(day, F.lit(_FIRST_DAY).cast("date"))
        pair = permuted_pair(F.floor(at / _DAYS[1]), at % _DAYS[1], *_DAYS, key + "date")
        any_day = _bound(pair, lambda q: F.date_add(F.lit(_FIRST_DAY).cast("date"),
                                                    (q["a"] * _DAYS[1] + q["b"]).cast("int")))
        new = F.when((mark == "/") & us.isNull(), _late_day(day, key)).otherwise(any_day)

        def shown(d: Column) -> Column:
            wide = (F.length(p[0]) == 2) & (F.length(p[1]) == 2)
            day_text = F.when(wide, F.date_format(d, "dd")).otherwise(F.date_format(d, "d"))
            month_text = F.when(wide, F.date_format(d, "MM")).otherwise(F.date_format(d, "M"))
            return F.when(mark == "-", F.date_format(d, "yyyy-MM-dd")) \
                .when(day_first, F.concat(day_text, mark, month_text, mark, F.date_format(d, "yyyy"))) \
                .otherwise(F.concat(month_text, mark, day_text, mark, F.date_format(d, "yyyy")))

        ok = at.between(0, _DAYS[0] * _DAYS[1] - 1)
        return F.when(F.coalesce(ok, F.lit(False)), _bound(new, shown)).otherwise(m)

    return _bound(F.split(m, r"\D"), run)


def _after(m: Column, head: str, key: str) -> Column:
    """Permute what follows the part that ``head`` matches at the start."""
    start = F.regexp_extract(m, head, 0)
    return _bound(start, lambda s: F.concat(s, permuted_text(F.substring(m, F.length(s) + 1, F.length(m)), key)))


def pseudonym(m: Column, key: str) -> Column:
    """Pseudonym of one match of any kind."""
    def is_kind(kind: str) -> Column:
        return m.rlike(f"^(?:{PATTERNS[kind]})$")

    email = _bound(F.split(m, "@"), lambda p: F.concat(permuted_text(p[0], key + "email"), F.lit("@"), p[1]))
    return F.when(F.contains(m, F.lit("@")), email) \
        .when(m.startswith("AKIA"), _after(m, "^AKIA", key + "secret")) \
        .when(is_kind("secret"), _after(m, r"^[^=:]+[=:] ?[\"']?", key + "secret")) \
        .when(is_kind("date"), _date(m, key)).when(is_kind("ssn"), _ssn(m, key)).when(is_kind("ip"), _ip(m, key)) \
        .when(is_kind("card"), _card(m, key)) \
        .otherwise(_after(m, r"^(?:\+\d{1,3}(?=\D))?", key + "phone"))


def pseudonymise(text: Column, key: str) -> Column:
    """Struct of the text with every match replaced (``text``) and the number of values that changed (``n_replaced``)."""
    def run(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(_ANY), F.lit(0))
        between = F.split(t, _ANY, -1)

        def joined(new: Column) -> Column:
            # One more piece than matches: the last is followed by nothing.
            return F.array_join(F.zip_with(between, new, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")

        def both(old: Column) -> Column:
            return _bound(F.transform(old, lambda m: pseudonym(m, key)), lambda new: F.struct(
                joined(new).alias("text"),
                F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x)).cast("bigint")
                .alias("n_replaced")))

        return _bound(found, both)

    clean = F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("n_replaced"))
    # Only texts that hold a match are taken apart; every kind holds one of these signs.
    return F.when(F.coalesce(text.rlike("[0-9@=:]|AKIA") & text.rlike(_ANY), F.lit(False)), _bound(text, run)) \
        .otherwise(clean)


def mask(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_replaced") -> DataFrame:
    """``docs`` with its text column pseudonymised and, unless ``count_col`` is None, a count of replaced values.

    A null text stays null and an empty one empty, both with count 0; repeated
    rows are treated alike; other columns pass through, but one that already
    has the name of ``count_col`` is replaced.  A projection: no shuffle, no
    Python, any number of rows and any length of text.
    """
    names = [c for c in docs.columns if c != count_col]
    held = "masked"
    while held in names:
        held += "_"
    out = docs.select(*[f"`{c}`" for c in names if c != text_col], pseudonymise(F.col(text_col), key).alias(held))
    return out.select(*[F.col(f"{held}.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
                      *([F.col(f"{held}.n_replaced").alias(count_col)] if count_col else []))
