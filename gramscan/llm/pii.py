"""Format-preserving pseudonyms for personal numbers and dates, in SQL expressions only.

Values that pass their format's validity rule are replaced by a keyed permutation of the
same format, so equal values stay linked across documents and no value is kept as it was
by rule.  A Feistel network of mixed radix a x b permutes 0..ab-1: eight rounds add a keyed
SHA-256 value of one half to the other, modulo its radix.

    card     13 to 19 digits that pass Luhn: the digits before the check digit are permuted,
             then the check digit is set anew; separators stay
    iban     two letters, two check digits and up to 30 letters and digits that pass mod 97: the
             digits after the check digits are permuted, then these are set anew; letters stay
    phone    10 to 15 digits in the form +c (ddd) ddd-dddd and alike: the digits after a leading
             country code.  (ddd) ddd-dddd and ddd-ddd-dddd without one, where the first digit is
             2 to 9: all digits, within that rule
    ssn      ddd-dd-dddd with an area of 001 to 899 but 666, no group 00 and no serial 0000: the
             number among the 898 x 99 x 9,999 of that rule
    ip       four numbers up to 255: the 32-bit address
    date     yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy that exists within 1800-2199: the day among the
             146,097 of the 400 years (189 x 773), hence always a date that exists
    email    the local part becomes 16 hexadecimal digits of a keyed hash (its length is not kept)
    secret   the value after token, key, secret or password becomes hexadecimal digits alike

Patterns take time in proportion to the text and no stack, whatever it holds: unbounded repetitions
are possessive, and one that could begin anywhere in a run may only begin at the run's start.

A text is cut at the matches once, each match is replaced, and the pieces are joined again.
Everything runs within Spark's own expressions: no Python, no shuffle.  Null and empty
texts give an empty text and no findings.  The key must be kept secret; with it the
numbers and dates can be turned back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

ROUNDS = 8
#: What must not stand before, the value, what must not stand after.  Order decides which kind a match has.
KINDS = {
    "email": (r"(?<![\w.+-])", r"[\w.+-]++@[\w-]++(?:\.[\w-]++)++", ""),
    "secret": ("", r"(?i:\b(?:token|api[_-]?key|secret|password)\b\s*+[=:]\s*+)\"?[A-Za-z0-9/+_-]{8,}+\"?", ""),
    "iban": (r"(?<![A-Za-z0-9])", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", r"(?![A-Za-z0-9])"),
    "phone": (r"(?<![\d+-])", r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])\d{3}[ .-]\d{4})", r"(?!\d|-\d)"),
    "ip": (r"(?<![\d.])", r"\d{1,3}(?:\.\d{1,3}){3}", r"(?!\d|\.\d)"),
    "date": (r"(?<!\d)", r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4})", r"(?!\d)"),
    "ssn": (r"(?<![\d-])", r"\d{3}-\d{2}-\d{4}", r"(?![\d-])"),
    "card": (r"(?<![\d-])", r"\d(?:[ -]?\d){12,18}", r"(?![\d-])"),
}
PATTERN = "|".join(map("".join, KINDS.values()))


def _round(key: str, kind: Column, i: Column, half: Column, radix: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, i.cast("string"), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), radix)


def feistel(value: Column, a: Column | int, b: Column | int, key: str, kind: Column | str) -> Column:
    """A keyed permutation of 0..ab-1."""
    a, b, kind = (x if isinstance(x, Column) else F.lit(x) for x in (a, b, kind))
    whole = F.call_function("div", value, b)  # a quotient of doubles is inexact from 2^53 on
    start = F.struct(whole.alias("l"), F.pmod(value, b).cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + _round(key, kind, i * 2, s["r"], a), a)
        return F.transform(F.array(left), lambda l: F.struct(l.alias("l"), F.pmod(s["r"] + _round(key, kind, i * 2 + 1, l, b), b).alias("r")))[0]

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS // 2 - 1)), start, step, lambda s: s["l"] * b + s["r"])


def _digits_permuted(digits: Column, key: str, kind: Column | str) -> Column:
    """A permutation of the digit strings of each length up to 18; an empty string stays."""
    powers = F.array(*[F.lit(10**k).cast("long") for k in range(10)])

    def new(n: Column) -> Column:
        half = F.floor(n / 2).cast("int")
        name = F.concat(kind if isinstance(kind, Column) else F.lit(kind), n.cast("string"))
        return F.lpad(feistel(digits.cast("long"), F.get(powers, half), F.get(powers, n - half), key, name).cast("string"), n, F.lit("0"))

    return _let(F.length(digits), lambda n: F.when(n == 0, "").when(n <= 18, new(n)))


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    """Luhn's sum; double_last: the check digit is still to come."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == (0 if double_last else 1), F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _filled(form: Column, digits: Column) -> Column:
    """The form with its digits replaced, one by one, by the given ones."""
    chars = F.split(form, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + is_digit.cast("int")).alias("at"))

    return F.aggregate(chars, start, step, lambda s: s["out"])


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        return _let(_digits_permuted(body, key, "card"), lambda p: _filled(m, F.concat(p, F.pmod(F.lit(10) - _luhn_sum(p, True) % 10, F.lit(10)).cast("string"))))

    return _let(F.regexp_replace(m, "[^0-9]", ""), lambda d: F.when(_luhn_sum(d, False) % 10 == 0, new(d)).otherwise(m))


def _remainder(text: Column) -> Column:
    """Modulo 97, with letters as two digits."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: F.when(c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def _iban(m: Column, key: str) -> Column:
    """The digits after the check digits in two parts: the last 18, then the others under these."""
    land, form = F.substring(m, 1, 2), F.substring(m, F.lit(5), F.length(m))

    def new(d: Column) -> Column:
        last = F.substring(d, F.greatest(F.length(d) - 17, F.lit(1)), F.lit(18))
        first = F.substring(d, F.lit(1), F.greatest(F.length(d) - 18, F.lit(0)))
        permuted = _let(_digits_permuted(last, key, "iban"), lambda p: F.concat(_digits_permuted(first, key, F.concat(F.lit("iban"), p)), p))
        check = lambda f: F.lpad((F.lit(98) - _remainder(F.concat(F.translate(f, " ", ""), land, F.lit("00")))).cast("string"), 2, "0")
        return _let(_let(permuted, lambda p: _filled(form, p)), lambda f: F.concat(land, check(f), f))

    valid = _remainder(F.translate(F.concat(form, F.substring(m, 1, 4)), " ", "")) == 1
    return F.when(valid & (F.length(F.translate(m, " ", "")) <= 34), _let(F.regexp_replace(form, "[^0-9]", ""), new)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^\+\d{1,3}", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    abroad = _let(F.regexp_replace(rest, "[^0-9]", ""), lambda d: F.when(F.length(d).between(7, 14), F.concat(code, _filled(rest, _digits_permuted(d, key, "phone")))).otherwise(m))
    at_home = _let(feistel(F.regexp_replace(m, "[^0-9]", "").cast("long") - 2 * 10**9, 80_000, 100_000, key, "phone"), lambda v: _filled(m, (v + 2 * 10**9).cast("string")))
    return F.when(m.startswith("+"), abroad).otherwise(at_home)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    number = (area - F.when(area < 666, 1).otherwise(2)) * (99 * 9999) + (group - 1) * 9999 + serial - 1

    def text(v: Column) -> Column:
        place = F.call_function("div", v, F.lit(99 * 9999))
        parts = (place + F.when(place < 665, 1).otherwise(2), F.pmod(F.call_function("div", v, F.lit(9999)), F.lit(99)) + 1, F.pmod(v, F.lit(9999)) + 1)
        return F.concat_ws("-", *[F.lpad(p.cast("string"), n, "0") for p, n in zip(parts, (3, 2, 4), strict=True)])

    return F.when(valid, _let(feistel(number, 898, 99 * 9999, key, "ssn"), text)).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    new = feistel(value, 1 << 16, 1 << 16, key, "ip")
    text = _let(new, lambda v: F.concat_ws(".", *[F.pmod(F.floor(v / (1 << s)), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]))
    return F.when(F.forall(parts, lambda x: x <= 255), text).otherwise(m)


def _date(m: Column, key: str) -> Column:
    german = F.substring(m, 3, 1) == "."
    sep = F.when(german, ".").otherwise(F.substring(m, 5, 1))
    iso = F.when(german, F.concat(F.substring(m, 7, 4), F.lit("-"), F.substring(m, 4, 2), F.lit("-"), F.substring(m, 1, 2))).otherwise(F.translate(m, "/", "-"))
    first = F.to_date(F.lit("1800-01-01"))

    def new(day: Column) -> Column:
        number = F.datediff(day, first).cast("long")
        moved = _let(feistel(number, 189, 773, key, "date"), lambda k: F.date_add(first, k.cast("int")))
        shape = lambda d: F.when(german, F.date_format(d, "dd.MM.yyyy")).otherwise(F.concat(F.date_format(d, "yyyy"), sep, F.date_format(d, "MM"), sep, F.date_format(d, "dd")))
        return F.when(day.isNotNull() & number.between(0, 146_096), _let(moved, shape)).otherwise(m)

    return _let(F.try_to_date(iso, "yyyy-MM-dd"), new)


def _email(m: Column, key: str) -> Column:
    return F.concat(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.regexp_extract(m, "@.*$", 0))


def _secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^[A-Za-z_-]+\s*[=:]\s*\"?", 0)
    value = F.rtrim(F.regexp_replace(F.substring(m, F.length(head) + 1, F.length(m)), "\"$", ""))
    return F.concat(head, F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), value), 256), 1, 32), F.when(m.endswith("\""), "\"").otherwise(""))


def kind_of(m: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(F.regexp_like(m, F.lit(f"^(?:{KINDS[kind][1]})$")), F.lit(kind)).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    of = {"email": _email, "secret": _secret, "iban": _iban, "phone": _phone, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card}
    out = m
    for name, new in of.items():
        out = F.when(kind == name, new(m, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (pseudonyms in place), n_found (values replaced), kinds (sorted, comma-joined), found (kind and pseudonym of each)."""
    rows = fresh(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = F.transform(F.regexp_extract_all("text", F.lit(PATTERN), 0), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    found = F.transform(found, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), pseudonym(x["m"], x["kind"], key).alias("new")))
    cut = rows.select("doc_id", "text", F.when(F.regexp_like("text", F.lit(r"[@\d]|(?i:token|key|secret|password)")), found).alias("found"))
    pieces = F.split("text", PATTERN, -1)
    joined = F.array_join(F.flatten(F.zip_with(pieces, "found", lambda p, f: F.array(F.coalesce(p, F.lit("")), F.coalesce(f["new"], F.lit(""))))), "")
    changed = F.filter("found", lambda x: x["m"] != x["new"])
    some = F.col("found").isNotNull() & (F.size("found") > 0)
    return cut.select(
        "doc_id",
        F.when(some, joined).otherwise(F.col("text")).alias("text"),
        F.when(some, F.size(changed)).otherwise(0).cast("long").alias("n_found"),
        F.when(some, F.array_join(F.array_sort(F.array_distinct(F.transform(changed, lambda x: x["kind"]))), ",")).otherwise("").alias("kinds"),
        F.when(some, F.transform(changed, lambda x: F.struct(x["kind"].alias("kind"), x["new"].alias("pseudonym")))).alias("found"),
    )
