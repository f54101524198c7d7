"""Format-preserving pseudonyms for personal data, in SQL functions alone.

Matches that pass their format's test are permuted within the format by a keyed
Feistel network, so equal values get equal pseudonyms in every document, and
different values of a format different ones: card numbers stay valid by Luhn,
account numbers by their check digits, dates are dates, addresses addresses. A
match that fails the test stays as it is.

Defined results: a null text stays null; repeated rows give a row each; an
empty table gives no rows; all columns are kept, whatever their names, and text
alone is changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d]|[.-]\d)"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"
SOCIAL = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
DATE = r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d)"
SECRET = r"""(?<!\w)AKIA[0-9A-Z]{16}(?!\w)|(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?[A-Za-z0-9_+/.-]{6,}["']?"""
ANY = "|".join((EMAIL, IP, IBAN, DATE, SOCIAL, PHONE, CARD, SECRET))
MAYBE = r"[0-9@]|(?i:password|passwd|pwd|secret|token|api[_-]?key)"

# The dates from 1900-01-01 that one era of the permutation spans: two primes' product.
_DAYS_LEFT, _DAYS_RIGHT = 271, 269


def _prf(secret: str, round_: Column, other: Column, place: Column) -> Column:
    """A number under 65536 that key, round, other half and place decide."""
    digest = F.sha2(F.concat(F.lit(secret + "|"), round_.cast("string"), F.lit("|"), other), 256)
    return F.conv(F.substr(digest, F.pmod(place * 3, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("long")


def _shifted(char: Column, by: Column) -> Column:
    """A letter or digit moved within its class; anything else as it is."""
    code = F.ascii(char)

    def moved(first: int, size: int) -> Column:
        return F.char((F.lit(first) + (code - first + by) % size).cast("long"))

    return F.when(char.between("0", "9"), moved(48, 10)).when(char.between("a", "z"), moved(97, 26)).when(char.between("A", "Z"), moved(65, 26)).otherwise(char)


def permuted(text: Column, secret: str) -> Column:
    """text with its ASCII letters and digits permuted, each within its class and place."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    half = (F.size(chars) / 2).cast("int")
    start = F.struct(F.slice(chars, F.lit(1), half).alias("a"), F.slice(chars, half + 1, F.size(chars) - half).alias("b"))

    def step(state: Column, round_: Column) -> Column:
        other = F.array_join(state["b"], "")
        return F.struct(state["b"].alias("a"), F.transform(state["a"], lambda c, j: _shifted(c, _prf(secret, round_, other, j))).alias("b"))

    rounds = F.array(*[F.lit(r) for r in range(ROUNDS)])
    return F.aggregate(rounds, start, step, lambda s: F.concat(F.array_join(s["a"], ""), F.array_join(s["b"], "")))


def in_format(m: Column, new: Column) -> Column:
    """m with its letters and digits, in order, replaced by those of new: separators stay, and don't matter to the permutation."""
    chars = F.filter(F.split(m, ""), lambda c: c != "")

    def put(c: Column, j: Column) -> Column:
        place = F.length(F.regexp_replace(F.substr(m, F.lit(1), j + 1), "[^A-Za-z0-9]", ""))
        return F.when(c.rlike("[A-Za-z0-9]"), F.substr(new, place, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(chars, put), "")


def permuted_number(number: Column, left: int, right: int, secret: str) -> Column:
    """A permutation of the numbers from 0 to left * right - 1."""

    def step(state: Column, round_: Column) -> Column:
        size = F.when(round_ % 2 == 0, F.lit(left)).otherwise(F.lit(right))
        return F.struct(state["b"].alias("a"), F.pmod(state["a"] + _prf(secret, round_, state["b"].cast("string"), F.lit(0)) + 65536 * _prf(secret, round_, state["b"].cast("string"), F.lit(7)), size.cast("long")).alias("b"))

    start = F.struct(F.floor(number / right).cast("long").alias("a"), (number % right).cast("long").alias("b"))
    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), start, step, lambda s: s["a"] * right + s["b"])


def _luhn_sum(digits: Column, check_included: bool) -> Column:
    """The sum of Luhn's test over a string of digits."""
    backwards = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    doubled = 1 if check_included else 0

    def value(c: Column, j: Column) -> Column:
        v = c.cast("int")
        return F.when(j % 2 == doubled, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v)

    return F.aggregate(F.transform(backwards, value), F.lit(0), lambda a, b: a + b)


def _card(m: Column, secret: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = permuted(F.substr(digits, F.lit(1), F.length(digits) - 1), secret + "card")

    def with_check(b: Column) -> Column:
        return in_format(m, F.concat(b, F.pmod(-_luhn_sum(b, False), F.lit(10)).cast("string")))

    made = F.element_at(F.transform(F.array(body), with_check), 1)
    return F.when(_luhn_sum(digits, True) % 10 == 0, made).otherwise(m)


def _remainder(plain: Column) -> Column:
    """An account number's characters, letters as 10 to 35, modulo 97."""

    def step(a: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(plain, ""), lambda c: c != ""), F.lit(0), step)


def _iban(m: Column, secret: str) -> Column:
    plain = F.regexp_replace(m, " ", "")
    country, rest = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))

    def with_check(r: Column) -> Column:
        check = F.lit(98) - _remainder(F.concat(r, country, F.lit("00")))
        return in_format(m, F.concat(country, F.lpad(check.cast("string"), 2, "0"), r))

    made = F.element_at(F.transform(F.array(permuted(rest, secret + "account")), with_check), 1)
    valid = _remainder(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))) == 1
    return F.when(valid, made).otherwise(m)


def _ip(m: Column, secret: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    made = F.transform(
        F.array(permuted_number(number, 65536, 65536, secret + "address")),
        lambda n: F.concat_ws(".", *[(F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)]),
    )
    return F.when(F.forall(parts, lambda x: x < 256), F.element_at(made, 1)).otherwise(m)


def _date(m: Column, secret: str) -> Column:
    parts = F.split(m, "[-/.]")
    iso = m.rlike(r"^\d{4}")
    a, b, c = (F.element_at(parts, k) for k in (1, 2, 3))

    def parsed(year: Column, month: Column, day: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")

    day_first, month_first = parsed(c, b, a), parsed(c, a, b)
    date = F.when(iso, parsed(a, b, c)).otherwise(F.coalesce(day_first, month_first))
    days, span = F.datediff(date, F.lit("1900-01-01").cast("date")).cast("long"), _DAYS_LEFT * _DAYS_RIGHT
    era = F.floor(days / span)
    new = F.date_add(F.lit("1900-01-01").cast("date"), (era * span + permuted_number(days - era * span, _DAYS_LEFT, _DAYS_RIGHT, secret + "date")).cast("int"))
    mark = F.when(m.contains("/"), F.lit("/")).otherwise(F.lit("."))

    def shown(d: Column) -> Column:
        day, month, year = (F.date_format(d, p) for p in ("dd", "MM", "yyyy"))
        numbers = F.when(day_first.isNotNull(), F.concat_ws("-", day, month, year)).otherwise(F.concat_ws("-", month, day, year))
        return F.when(iso, F.concat_ws("-", year, month, day)).otherwise(F.replace(numbers, F.lit("-"), mark))

    return F.when(date.isNotNull(), F.element_at(F.transform(F.array(new), shown), 1)).otherwise(m)


def pseudonym(m: Column, secret: str) -> Column:
    """What stands for one match of ANY."""
    whole = lambda pattern: m.rlike(f"^(?:{pattern})$")
    at = F.instr(m, "@")
    email = F.concat(permuted(F.substr(m, F.lit(1), at - 1), secret + "email"), F.substr(m, at))
    lead = F.length(F.regexp_extract(m, r"^(?:\+\d{1,3}(?=[ .(-])|\+\d)?", 0))
    local = F.substr(m, lead + 1)
    phone = F.concat(F.substr(m, F.lit(1), lead), in_format(local, permuted(F.regexp_replace(local, "[^0-9]", ""), secret + "phone")))
    name = F.length(F.regexp_extract(m, r"""^(?:AKIA|[A-Za-z_-]+["']?\s*[=:]\s*["']?)""", 0))
    hidden = F.concat(F.substr(m, F.lit(1), name), permuted(F.substr(m, name + 1), secret + "secret"))
    return (
        F.when(whole(EMAIL), email)
        .when(whole(IP), _ip(m, secret))
        .when(whole(IBAN), _iban(m, secret))
        .when(whole(DATE), _date(m, secret))
        .when(whole(SOCIAL), permuted(m, secret + "social"))
        .when(whole(PHONE), phone)
        .when(whole(CARD), _card(m, secret))
        .when(whole(SECRET), hidden)
        .otherwise(m)
    )


def pseudonymised(docs: DataFrame, secret: str, counted: str | None = None) -> DataFrame:
    """docs with the personal data in text replaced, and the number of values replaced in the column `counted`.

    `secret` decides the permutations: without it pseudonyms can't be led back
    or linked with those of another corpus, so give one that nobody can guess.
    """
    text, own = F.col("text"), "_" * (1 + max(map(len, docs.columns)))
    matches, made = f"{own}m", f"{own}n"
    some = text.rlike(MAYBE)
    rows = docs.withColumn(matches, F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    rows = rows.withColumn(made, F.transform(matches, lambda m: pseudonym(m, secret)))
    between = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(between, F.col(made), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    columns = [(F.when(F.size(matches) > 0, joined).otherwise(text)).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != counted]
    if counted is not None:
        changed = F.size(F.filter(F.zip_with(matches, made, lambda a, b: a != b), lambda x: x))
        columns.append(F.when(text.isNull(), F.lit(None).cast("int")).otherwise(F.when(some, changed).otherwise(0)).alias(counted))
    return rows.select(*columns)


def found(docs: DataFrame, secret: str) -> DataFrame:
    """(doc_id, text, n_found): the pseudonymised texts and how many values were replaced in each."""
    return pseudonymised(docs.select("doc_id", "text"), secret, counted="n_found")
