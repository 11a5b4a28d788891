"""Operator 10: personal data as format-preserving pseudonyms. DataFrame functions only.

Found values are validated (Luhn sum, octets up to 255, dates of the calendar) and
replaced by a keyed permutation of their own format: a Feistel network whose rounds add a
keyed SHA-256 of one half to the other, modulo the halves' sizes. So a card stays a valid
card with the same separators, a date a valid date, and equal values stay equal in all
documents, while different ones stay different:

* cards: 13 to 19 digits, plain or in groups (4-4-4-4, 4-4-4-4-3 or 4-6-5); all but the check digit are permuted, and
  the check digit is computed anew;
* phones: the last ten digits (all, where fewer), with sign, brackets and blanks kept;
* social security numbers (ddd-dd-dddd): the nine digits;
* IPv4 addresses: 16 and 16 bits;
* dates of the years 1800 to 2199 (146,097 days = 189 x 773), in the form they have.

Mail addresses, access keys and secrets assigned to a token, secret, key or password
(32 hexadecimal digits or more, or 24 mixed base64 characters) have no numeric format;
they get a keyed digest in their own form. Numbers that fail validation stay as they are.

Everything is done within a row: nothing is shuffled. The key is a parameter; DEFAULT_KEY
is for tests and demonstrations only.

Defined cases: null text stays null, with n_found 0; empty text stays empty; rows that
repeat give repeated results; an empty table gives an empty result; other columns pass
through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import let

DEFAULT_KEY = "demonstration key: pass your own"
ROUNDS = 10

# What the kinds look like. The order decides where two begin at one place.
_MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}"
_KEY = r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|xox[abprs]-[A-Za-z0-9-]{10,72})(?![A-Za-z0-9])"
_NAME = r"(?i:token|secret|key|password|passwd|pwd)[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?"
_VALUE = r"(?:[0-9A-Fa-f]{32,}+|(?=[A-Za-z0-9+/_-]*?[0-9])(?=[A-Za-z0-9+/_-]*?[a-z])(?=[A-Za-z0-9+/_-]*?[A-Z])[A-Za-z0-9+/_-]{24,}+={0,2})(?![A-Za-z0-9+/_=-])"
_SECRET = rf"{_NAME}(?!(?:AKIA|ASIA|ghp_|sk-|xox[abprs]-)){_VALUE}"
_IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
_DATE = r"(?:(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!\d)|(?<![\d./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\d|[./-]\d))"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
# without separators or with blanks: area and exchange begin with 2 to 9
_LOCAL = r"(?<!\d)\(\d{3}\) ?\d{3}[-. ]\d{4}|(?<![\d-])\d{3}[-.]\d{3}[-.]\d{4}|(?<![\d.-])(?<!\d )[2-9]\d{2} [2-9]\d{2} \d{4}|(?<![\w.+/-])[2-9]\d{2}[2-9]\d{6}(?![\w/-])"
_CARD = rf"(?<!\d)(?:\d{{13,19}}|\d{{4}}(?:[ -]\d{{4}}){{3}}(?:[ -](?!{_IP}|{_SSN}|(?:{_LOCAL})(?!\d))\d{{3}})?|\d{{4}}[ -]\d{{6}}[ -]\d{{5}})(?!\d)"
# A phone ends at a complete number, so that what follows keeps its own kind: after 3-3-4 digits behind the country's,
# else before a group where another kind begins, and at 15 digits.
_OTHER = f"(?!{_MAIL}|{_IP}|{_DATE}|{_SSN})"
_DIGIT = r"[ .()-]{0,3}\d"
_PHONE = (
    r"(?:\+\d{1,3}[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    rf"|\+\d{{1,3}}[ .-]?{_OTHER}(?:\(\d{{1,4}}\)|\d{{1,4}})(?:[ .-]?{_OTHER}\d{{2,4}}){{2}}(?:[ .-]?{_OTHER}(?!{_CARD}|(?:{_LOCAL})(?!\d))\d{{2,4}}){{0,2}}"
    rf"(?<!\+{_DIGIT * 16}{f'(?:{_DIGIT})?' * 7})|{_LOCAL})(?!\d)"
)
ANY = "|".join((_MAIL, _KEY, _SECRET, _IP, _DATE, _SSN, _PHONE, _CARD))
#: Texts without any of these hold nothing that ANY finds.
HINT = r"[0-9@]|ghp_|sk-|xox|AKIA|ASIA|[A-Fa-f]{32}"


def _keyed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]).cast("binary"), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: Column) -> Column:
    """struct(l, r): a permutation of the pairs below (left_size, right_size); rounds change the halves in turn."""

    def turn(s: Column, i: Column) -> Column:
        new_l = F.pmod(s["l"] + F.pmod(_number(_keyed(key, kind, i, s["r"])), left_size), left_size)
        new_r = F.pmod(s["r"] + F.pmod(_number(_keyed(key, kind, i, s["l"])), right_size), right_size)
        even = i % 2 == 0
        return F.struct(F.when(even, new_l).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(new_r).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 18 digits as another of the same length."""

    def of(d: Column) -> Column:
        n = F.length(d)
        a = F.floor(n / 2).cast("int")
        size = lambda k: F.pow(F.lit(10), k).cast("long")
        halves = feistel(F.substring(d, F.lit(1), a).cast("long"), F.substring(d, a + 1, n - a).cast("long"), size(a), size(n - a), key, F.concat(F.lit(kind), n.cast("string")))
        return let(halves, lambda h: F.concat(F.lpad(h["l"].cast("string"), a, "0"), F.lpad(h["r"].cast("string"), n - a, "0")))

    return let(digits, of)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def with_digits(value: Column, digits: Column) -> Column:
    """value with its digits, in order, taken from digits; all else stays."""
    at = lambda i: F.substring(value, i, F.lit(1))
    place = lambda i: F.length(digits_of(F.substring(value, F.lit(1), i)))
    return let(digits, lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.when(at(i).between("0", "9"), F.substring(d, place(i), F.lit(1))).otherwise(at(i))), ""))


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Sum of digits where, from the right, every second one is doubled (and digits of it added)."""
    n = F.length(digits)

    def one(i: Column) -> Column:
        digit = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return F.when(i % 2 == (1 if doubled_last else 0), twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + one(i))


def is_card(value: Column) -> Column:
    return let(digits_of(value), lambda d: F.length(d).between(13, 19) & (luhn_sum(d, False) % 10 == 0))


def card(value: Column, key: str) -> Column:
    body = let(digits_of(value), lambda d: permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card"))
    return with_digits(value, let(body, lambda b: F.concat(b, F.pmod(10 - luhn_sum(b, True) % 10, F.lit(10)).cast("string"))))


def phone(value: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        head = F.greatest(F.length(d) - 10, F.lit(0))
        return F.concat(F.substring(d, F.lit(1), head), permute_digits(F.substring(d, head + 1, F.length(d) - head), key, "phone"))

    return with_digits(value, let(digits_of(value), of))


def ip(value: Column, key: str) -> Column:
    def of(o: Column) -> Column:
        word = lambda i: o[i].cast("long") * 256 + o[i + 1].cast("long")
        return let(feistel(word(0), word(2), F.lit(65536), F.lit(65536), key, F.lit("ip")), lambda h: F.concat_ws(".", *[x.cast("long").cast("string") for x in (F.floor(h["l"] / 256), h["l"] % 256, F.floor(h["r"] / 256), h["r"] % 256)]))

    octets = F.split(value, r"\.")
    return F.when(F.forall(octets, lambda x: x.cast("int") <= 255), let(octets, of)).otherwise(value)


def date(value: Column, key: str) -> Column:
    """Dates of the calendar, year first or last; day before month where both readings are dates."""
    parts = F.split(value, "[-/.]")
    mark = F.regexp_extract(value, "[-/.]", 0)
    year_first = F.length(parts[0]) == 4
    # written without zeros where a month or day has one digit
    padded = F.length(value) == 10
    as_date = lambda y, m, d: F.concat_ws("-", parts[y], F.lpad(parts[m], 2, "0"), F.lpad(parts[d], 2, "0")).try_cast("date")
    found = F.array(F.when(year_first, as_date(0, 1, 2)), F.when(~year_first, as_date(2, 1, 0)), F.when(~year_first, as_date(2, 0, 1)))

    def of(f: Column) -> Column:
        which = F.when(f[0].isNotNull(), 0).when(f[1].isNotNull(), 1).when(f[2].isNotNull(), 2)
        day = F.datediff(F.coalesce(f[0], f[1], f[2]), F.lit("1800-01-01").cast("date"))
        moved = let(feistel(F.floor(day / 773), day % 773, F.lit(189), F.lit(773), key, F.lit("date")), lambda h: F.date_add(F.lit("1800-01-01").cast("date"), (h["l"] * 773 + h["r"]).cast("int")))

        def text(t: Column) -> Column:
            short = lambda p: F.when(padded, p).otherwise(F.regexp_replace(p, "^0", ""))
            y, m, d = F.substring(t, 1, 4), short(F.substring(t, 6, 2)), short(F.substring(t, 9, 2))
            joined = lambda *p: F.concat(p[0], mark, p[1], mark, p[2])
            return F.when(which == 0, joined(y, m, d)).when(which == 1, joined(d, m, y)).otherwise(joined(m, d, y))

        return F.when(day.between(0, 146096), let(moved.cast("string"), text)).otherwise(value)

    return let(found, of)


def _letters(digest: Column, n: int, upper: bool = False) -> Column:
    return F.substring(F.translate(digest, "0123456789abcdef", "ABCDEFGHIJKLMNOP" if upper else "abcdefghijklmnop"), 1, n)


def pseudonym(value: Column, key: str) -> Column:
    """What stands for a value that ANY found."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    mail = F.concat(_letters(_keyed(key, F.lit("mail"), F.lower(value)), 16), F.lit("@mail.invalid"))
    head = F.regexp_extract(value, r"^(AKIA|ASIA|ghp_|sk-|xox.-)", 1)
    secret = F.concat(head, F.rpad(_letters(_keyed(key, F.lit("key"), value), 64, upper=True), F.greatest(F.length(value) - F.length(head), F.lit(1)), "A"))
    named = F.regexp_extract(value, f"^{_NAME}", 0)

    def digest(v: Column) -> Column:
        """As long as v: of v's hexadecimal digits, or letters."""
        full = _keyed(key, F.lit("secret"), v)
        of_hex = F.when(v.rlike("[A-F]"), F.upper(full)).otherwise(full)
        return F.rpad(F.when(v.rlike("^[0-9A-Fa-f]+$"), of_hex).otherwise(_letters(full, 64)), F.length(v), F.when(v.rlike("^[0-9A-Fa-f]+$"), of_hex).otherwise(_letters(full, 64)))

    # the first 16 digits are a card where the 19 are none: the last group is something else
    first = F.substring(value, 1, 19)
    grouped = whole(r"\d{4}(?:[ -]\d{4}){3}[ -]\d{3}") & ~is_card(value) & is_card(first)
    return (
        F.when(F.instr(value, "@") > 0, mail)
        .when(head != "", secret)
        .when(named != "", F.concat(named, let(F.substring(value, F.length(named) + 1, F.length(value)), digest)))
        .when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), ip(value, key))
        .when(whole(r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[/.]\d{1,2}[/.]\d{4}"), date(value, key))
        .when(whole(r"\d{3}-\d{2}-\d{4}"), with_digits(value, permute_digits(digits_of(value), key, "ssn")))
        .when(grouped, F.concat(card(first, key), F.substring(value, 20, 4)))
        .when(whole(_CARD), F.when(is_card(value), card(value, key)).otherwise(value))
        .otherwise(phone(value, key))
    )


def pseudonymise(docs: DataFrame, key: str = DEFAULT_KEY, count: str | None = None) -> DataFrame:
    """docs with the text's values replaced; count names a further column for how many were (long)."""
    text = F.col("text").cast("string")

    def of(found: Column) -> Column:
        new = F.transform(found, lambda m: pseudonym(m, key))
        gaps = F.split(text, ANY, -1)
        joined = F.array_join(F.zip_with(gaps, new, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
        changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
        return F.struct(joined.alias("text"), changed.cast("long").alias("n"))

    able = text.rlike(HINT)
    done = docs.withColumn("__done", F.when(able, let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda f: F.when(F.size(f) > 0, of(f)))))
    columns = [F.coalesce("__done.text", text).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return done.select(*columns, *([F.coalesce("__done.n", F.lit(0)).cast("long").alias(count)] if count else []))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(common.table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_found")
