"""Format-preserving pseudonyms for personal data, in DataFrame expressions only.

Validated values are permuted by keyed Feistel networks inside their own format: a card number becomes another number
with a correct check digit, a date another date, an address with four octets another such address. The permutation
depends on the key and the kind of value alone, so a value has the same pseudonym in every document and two values never
share one (day-first and month-first dates that read the same aside). Numbers that fail validation stay as they are.

Kinds: email (local part; the domain stays), card (13 to 19 digits, Luhn), iban (mod 97), ipv4, phone (international or
in US form, as many digits as its country has; one number has one pseudonym however it is spelled, and keeps its country
code and its spelling), ssn (US ranges), date (years 1 to 9999; it stays in its range of DATE_RANGES), secret
(hexadecimal after a word like token or password, in any case).

Null text gives null text and no values; an empty text stays empty. Texts of any length are treated whole; repeated rows
give repeated results; other columns pass through, and columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archloom.llm.common import free, let

#: Rounds of each Feistel network, both halves changed four times.
ROUNDS = 8
FIRST_DAY, DATE_SIDE = "1900-01-01", 270
#: Ranges of dates that are permuted apart: the first day, counted from FIRST_DAY, and two sides whose product is the days.
#: Their first days are 0001-01-01, 1600-01-01, 1900-01-01, 2099-08-05 and 2200-01-01; the last ends with 9999-12-31.
DATE_RANGES = [(-693595, 654, 893), (-109573, 1387, 79), (0, DATE_SIDE, DATE_SIDE), (DATE_SIDE**2, 91, 403), (109573, 233, 12227)]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Characters of an IBAN by country, and digits after the country code of phone numbers: those values end there, whatever
#: follows. Other countries have the general shapes.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
PHONE_DIGITS = {8: "45 47 65", 9: "27 31 33 34 41 48 61", 10: "1 7 20 44 52 90 91", 11: "86"}
#: Country calling codes of one and of two digits; all others have three.
PHONE_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: A leading zero for calls within the country, which isn't part of the number.
TRUNK = r"[ .-]?\(0\)"


def _iban_shape() -> str:
    each = [rf"(?:{'|'.join(c.split())})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items()]
    known = "|".join(c for codes in IBAN_LENGTHS.values() for c in codes.split())
    other = rf"(?!{known}|[0-9A-F]{{32}})[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
    return rf"(?<![\w+])(?:{'|'.join([*each, other])})(?!\w)"


def _phone_shape() -> str:
    known = [rf"\+(?:{'|'.join(codes.split())})(?:{TRUNK})?(?:[ .-]?\(?\d\)?){{{n}}}(?![\w-])" for n, codes in PHONE_DIGITS.items()]
    other = rf"\+\d{{1,3}}(?:{TRUNK})?[ .-]?\(?\d{{2,4}}\)?(?:[ .-]?\d{{2,4}}){{2}}(?:[ .-]?\d{{2,4}}(?![./:]\d))?"
    return rf"(?<![\w+])(?:{'|'.join(known)}|{other}|\(\d{{3}}\) ?\d{{3}}-\d{{4}}|\d{{3}}-\d{{3}}-\d{{4}})(?![\w-])"


#: Fixed shapes of values; what they match is validated afterwards.
SHAPES = {
    "email": r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}(?![A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]{32})(?<=\b(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key) ?[=:] ?[\"']?)[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])",
    "iban": _iban_shape(),
    "ipv4": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)",
    "phone": _phone_shape(),
    "ssn": r"(?<![\w+-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": r"(?<![\w./+-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?:(?![\w/-])|(?=T\d{2}(?!\d)))",
    "card": r"(?<![\w+])(?:\d{4}(?<s>[ -]?)\d{4}\k<s>\d{4}\k<s>\d{4}|\d{4}(?<u>[ -]?)\d{6}\k<u>\d{5}|\d{13,19})(?!\w)",
}
_WITH_DIGITS = [v for k, v in SHAPES.items() if k not in ("email", "secret", "iban")]
ANY = "|".join([*(SHAPES[k] for k in ("email", "secret", "iban")), f"(?=[0-9+(])(?:{'|'.join(_WITH_DIGITS)})"])


def _noise(key: str, kind: str | Column, step: Column, of: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), step.cast("string"), of), 256)


def permute_string(text: Column, key: str, kind: str | Column, letters: int = 26) -> Column:
    """Digits go to digits and letters to letters of their case, other characters stay. Halves are the even and the odd
    places; in turn, each is shifted by amounts drawn from the other. Time is in proportion to the length."""

    def one(chars: Column, step: Column) -> Column:
        rest = F.array_join(F.filter(chars, lambda c, i: (i + 1) % 2 != step % 2), "")

        def char(c: Column, p: Column, noise: Column) -> Column:
            by = F.conv(noise.substr(((p / 2).cast("int") % 21) * 3 + 1, F.lit(3)), 16, 10).cast("int")
            moved = lambda base, n: F.char((F.ascii(c) - base + by) % n + base)
            return F.when(p % 2 != step % 2, c).when(c.between("0", "9"), moved(48, 10)).when(c.between("a", "z"), moved(97, letters)).when(c.between("A", "Z"), moved(65, letters)).otherwise(c)

        return let(_noise(key, kind, step, rest), lambda noise: F.transform(chars, lambda c, i: char(c, i + 1, noise)))

    return F.when(F.length(text) > 0, F.array_join(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.split(text, ""), one), "")).otherwise(text)


def permute_pair(left: Column, right: Column, n: int, m: int, key: str, kind: str) -> Column:
    """A keyed permutation of all pairs of a number under n and a number under m."""

    def one(pair: Column, step: Column) -> Column:
        turn = step % 2 == 0
        fixed = F.when(turn, pair["b"]).otherwise(pair["a"])
        by = F.conv(_noise(key, kind, step, fixed.cast("string")).substr(1, 12), 16, 10).cast("long")
        return F.struct(F.when(turn, (pair["a"] + by) % n).otherwise(pair["a"]).alias("a"), F.when(turn, pair["b"]).otherwise((pair["b"] + by) % m).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("a"), right.cast("long").alias("b")), one)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum, where places count from the right from 0 and those of the parity `doubled` count double."""

    def worth(digits: Column, n: Column, p: Column) -> Column:
        d = digits.substr(p, F.lit(1)).cast("int")
        return F.when((n - p) % 2 == doubled, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return let(digits, lambda s: F.aggregate(F.transform(F.sequence(F.lit(1), F.length(s)), lambda p: worth(s, F.length(s), p)), F.lit(0), lambda a, x: a + x))


def mod97(text: Column) -> Column:
    """Letters count as two digits, A as 10."""

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return let(text, lambda s: F.aggregate(F.split(s, ""), F.lit(0), step))


def _refill(shape: Column, chars: Column, kept: str) -> Column:
    """The characters of chars in the places of shape that match kept, in order."""
    def fill(c: Column, p: Column, chars: Column) -> Column:
        before = F.length(F.regexp_replace(shape.substr(F.lit(1), p + 1), f"[^{kept[1:]}", ""))
        return F.when(c.rlike(kept), chars.substr(before, F.lit(1))).otherwise(c)

    return let(chars, lambda x: F.array_join(F.transform(F.split(shape, ""), lambda c, p: fill(c, p, x)), ""))


def _day(text: Column) -> Column:
    """The date a value stands for: year first, else day first, else month first."""
    parts = F.split(text, "[-/.]")
    iso = text.rlike(r"^\d{4}-")
    build = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    return F.when(iso, F.try_to_date(text, "yyyy-MM-dd")).otherwise(F.coalesce(build(parts[2], parts[1], parts[0]), build(parts[2], parts[0], parts[1])))


def phone_parts(value: Column) -> tuple[Column, Column, Column]:
    """What stays of a number as written (country code and trunk zero), its country code (+1 in US form), and the rest."""
    code = F.regexp_extract(value, PHONE_CODE, 0)
    head = F.concat(code, F.regexp_extract(value.substr(F.length(code) + 1, F.length(value)), f"^{TRUNK}", 0))
    return head, F.when(code == "", "+1").otherwise(code), value.substr(F.length(head) + 1, F.length(value))


def _is_phone(value: Column) -> Column:
    """As many digits as the country has, or 7 to 15 with the country code where that isn't known."""
    _, code, rest = phone_parts(value)
    n, right = F.length(_digits(rest)), F.when(F.lit(False), F.lit(True))
    for digits, codes in PHONE_DIGITS.items():
        right = right.when(code.isin(*(f"+{c}" for c in codes.split())), n == digits)
    return right.otherwise((n + F.length(code) - 1).between(7, 15))


def kind_of(value: Column) -> Column:
    """The kind of a matched value that passes validation, else null."""
    digits, solid = _digits(value), F.regexp_replace(value, " ", "")
    offset = F.date_diff(_day(value), F.lit(FIRST_DAY).cast("date"))
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike("^[0-9A-Fa-f]{32,}$"), "secret")
        .when(value.rlike("^[A-Z]"), F.when(mod97(F.concat(solid.substr(F.lit(5), F.length(solid)), solid.substr(1, 4))) == 1, "iban"))
        .when(value.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ipv4")
        .when(value.rlike(r"^\+|^\(|^\d{3}-\d{3}-"), F.when(_is_phone(value), "phone"))
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(~digits.rlike(r"^(000|666|9)|^...00|0000$"), "ssn"))
        .when(value.rlike(r"^\d{4}-\d{2}-\d{2}$|[/.]"), F.when(offset.between(DATE_RANGES[0][0], DATE_RANGES[-1][0] + DATE_RANGES[-1][1] * DATE_RANGES[-1][2] - 1), "date"))
        .when((luhn_sum(digits, 1) % 10 == 0) & (F.length(digits) >= 13) & digits.rlike("[1-9]"), "card")
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The value that stands for a validated value; of the same kind, and the same wherever the value occurs."""
    digits, solid = _digits(value), F.regexp_replace(value, " ", "")
    local = F.substring_index(value, "@", 1)
    email = F.concat(permute_string(local, key, "email"), value.substr(F.length(local) + 1, F.length(value)))

    check = lambda body: ((10 - luhn_sum(body, 0) % 10) % 10).cast("string")
    card = _refill(value, let(permute_string(digits.substr(F.lit(1), F.length(digits) - 1), key, "card"), lambda body: F.concat(body, check(body))), "[0-9]")

    country = solid.substr(1, 2)
    check97 = lambda bban: F.lpad((98 - mod97(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0")
    iban = _refill(value, let(permute_string(solid.substr(F.lit(5), F.length(solid)), key, "iban"), lambda bban: F.concat(country, check97(bban), bban)), "[0-9A-Z]")

    o = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    byte = lambda x: F.concat_ws(".", F.shiftright(x, 8).cast("string"), (x % 256).cast("string"))
    ipv4 = let(permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ipv4"), lambda ip: F.concat_ws(".", byte(ip["a"]), byte(ip["b"])))

    head, country_code, rest = phone_parts(value)
    phone = F.concat(head, _refill(rest, permute_string(_digits(rest), key, F.concat(F.lit("phone"), country_code)), "[0-9]"))

    area = digits.substr(1, 3).cast("int")
    s = permute_pair(F.when(area > 666, area - 2).otherwise(area - 1), (digits.substr(4, 2).cast("int") - 1) * 9999 + digits.substr(6, 4).cast("int") - 1, 898, 99 * 9999, key, "ssn")
    padded = lambda n, width: F.lpad(n.cast("string"), width, "0")
    ssn = let(s, lambda s: F.concat_ws("-", padded(F.when(s["a"] >= 665, s["a"] + 2).otherwise(s["a"] + 1), 3), padded(F.floor(s["b"] / 9999) + 1, 2), padded(s["b"] % 9999 + 1, 4)))

    offset = F.date_diff(_day(value), F.lit(FIRST_DAY).cast("date"))

    def moved_day(n: Column) -> Column:
        out = F.when(F.lit(False), n)
        for first, a, b in DATE_RANGES:
            to = let(permute_pair(F.floor((n - first) / b), (n - first) % b, a, b, key, "date" + (str(first) if first else "")), lambda d: d["a"] * b + d["b"] + first)  # noqa: B023
            out = out.when(n.between(first, first + a * b - 1), to)
        return out

    parts, mark = F.split(value, "[-/.]"), F.regexp_extract(value, "[-/.]", 0)
    month_first = F.try_to_date(F.concat_ws("-", parts[2], F.lpad(parts[1], 2, "0"), F.lpad(parts[0], 2, "0")), "yyyy-MM-dd").isNull()
    written = lambda day, *forms: F.concat(F.date_format(day, forms[0]), mark, F.date_format(day, forms[1]), mark, F.date_format(day, "yyyy"))
    shown = lambda day: F.when(value.rlike(r"^\d{4}-"), F.date_format(day, "yyyy-MM-dd")).when(month_first, written(day, "MM", "dd")).otherwise(written(day, "dd", "MM"))
    date = let(let(offset, moved_day), lambda n: let(F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int")), shown))

    small = F.lower(value)
    plain = permute_string(small, key, "secret", letters=6)
    secret = F.when(value == small, plain).when(value == F.upper(value), F.upper(plain)).otherwise(permute_string(value, key, "secret", letters=6))
    by_kind = {"email": email, "secret": secret, "iban": iban, "ipv4": ipv4, "phone": phone, "ssn": ssn, "date": date, "card": card}
    out = F.when(F.lit(False), value)
    for name, new in by_kind.items():
        out = out.when(kind == name, new)
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text", values: str = "pii") -> DataFrame:
    """docs with the values in `text` replaced, and a column of what was replaced: array of kind, start (code points of
    the old text, from 0), length and pseudonym. Passes over the text: a test for a digit, then one split and one
    extraction of the texts that have any. No shuffle."""
    source, (_found, _gaps) = F.col(text), free(docs, "_found", "_gaps")
    matched = F.regexp_extract_all(source, F.lit(f"({ANY})"), 1)
    kind = lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind"))
    new = lambda x: F.struct(x["value"].alias("value"), x["kind"].alias("kind"), F.coalesce(pseudonym(x["value"], x["kind"], key), x["value"]).alias("new"))
    hit = source.rlike("[0-9@]") & source.rlike(ANY)
    step = docs.withColumn(_found, F.when(hit, F.transform(F.transform(matched, kind), new)))
    step = step.withColumn(_gaps, F.when(F.col(_found).isNotNull(), F.split(source, ANY, -1)))
    width = lambda i: F.length(F.get(F.col(_gaps), i)) + F.when(i > 0, F.length(F.get(F.col(_found), i - 1)["value"])).otherwise(0)
    starts = running_sum(F.transform(F.col(_found), lambda x, i: width(i)))
    span = lambda x, start: F.struct(x["kind"].alias("kind"), start.alias("start"), F.length(x["value"]).alias("length"), x["new"].alias("pseudonym"))
    spans = F.zip_with(F.col(_found), starts, span)
    spans = F.coalesce(F.filter(spans, lambda x: x["kind"].isNotNull()), F.array().cast("array<struct<kind:string,start:int,length:int,pseudonym:string>>"))
    joined = F.array_join(F.zip_with(F.col(_gaps), F.col(_found), lambda g, x: F.concat(g, F.coalesce(x["new"], F.lit("")))), "")
    return step.withColumn(values, spans).withColumn(text, F.when(F.col(_found).isNotNull(), joined).otherwise(source)).drop(_found, _gaps)


def running_sum(numbers: Column) -> Column:
    """Each number with all before it added, in a number of passes that is the logarithm of the count."""
    add = lambda acc, step: F.transform(acc, lambda v, i: v + F.coalesce(F.get(acc, i - F.pow(F.lit(2), step).cast("int")), F.lit(0)))
    return let(numbers, lambda n: F.when(F.size(n) > 0, F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(n))).cast("int")), n, add)).otherwise(n))
