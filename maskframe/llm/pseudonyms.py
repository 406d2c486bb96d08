"""Format-preserving pseudonyms from keyed Feistel networks, in column expressions alone.

One pattern finds candidates in a text; each is validated for its kind, permuted within the
kind's own set of values, and put back in its own punctuation:

    card      13 to 19 digits that pass the Luhn check; all but the check digit are permuted
    iban      has its country's length and passes mod 97; letters stay letters and digits digits,
              check digits are made anew
    ipv4      four octets without leading zeros, as 32 bits
    phone     + and an assigned country code, 8 to 15 digits in all, or (area) form, or Turkish with
              0 or 0090 and a known area; the digits after the country code or 0, however they are
              spaced, so a number written abroad and at home gets one pseudonym
    tckn, vkn national and tax numbers that pass their checks; check digits are made anew
    ssn       ddd-dd-dddd with a valid area, group and serial, within the valid ones
    date      yyyy-MM-dd, dd.MM.yyyy or MM/dd/yyyy from 1900 to 2099, as a day of those years
    email     the local part; letters stay in their script and digits digits, the domain, which may
              be international or of one label, stays
    token     40 hexadecimal digits, which have no check
    secret    keys with a known prefix and 16 to 64 letters and digits, which are permuted

A permutation is keyed and depends on nothing but kind and value, so equal values get equal
pseudonyms in every text, different values different ones. What fails validation stays as it
is, and so does an email whose local part has letters beyond the basic plane. A null text stays null, an empty one empty; repeated rows give repeated results. Existing
columns stay, whatever their names, the text column is replaced in place.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.functions import checksums as C

ROUNDS = 8
# Lengths of IBANs and the countries that have them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
# Country codes of one and two digits; all others have three.
COUNTRY_CODE = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
# Ranges of letters (first and last code point), each permuted within itself.
LETTER_RANGES = [
    (0xC0, 0xD6), (0xD8, 0xDE), (0xDF, 0xF6), (0xF8, 0xFF), (0x100, 0x17F), (0x391, 0x3A1), (0x3A3, 0x3A9), (0x3B1, 0x3C9),
    (0x400, 0x40F), (0x410, 0x42F), (0x430, 0x44F), (0x450, 0x45F), (0x531, 0x556), (0x561, 0x586), (0x5D0, 0x5EA), (0x620, 0x64A),
    (0x904, 0x939), (0xE01, 0xE30), (0x10D0, 0x10FA), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
]


def _iban_form() -> str:
    """A pattern for each length, in groups of four with or without blanks, so that no match runs on into the next word."""
    forms = []
    for n, countries in IBAN_LENGTHS.items():
        rest = rf"(?: ?[A-Z0-9]{{{(n - 4) % 4}}})" if (n - 4) % 4 else ""
        forms.append(rf"(?:{'|'.join(countries.split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}{rest}")
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(forms)})(?![A-Za-z0-9])"


#: Candidate forms (fixed values), by kind; the first that matches at a place is taken.
FORMS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[[\p{L}\p{N}&&[^\x{10000}-\x{10FFFF}]]._%+-]{1,64}@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?\.){0,8}\p{L}(?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])(?![\p{L}\p{N}-])",
    "iban": _iban_form(),
    "token": r"(?<![A-Za-z0-9])(?:[0-9a-f]{40}|[0-9A-F]{40})(?![A-Za-z0-9])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,8}){1,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9+.,-])(?:0090[ .-]?|0[ .-]?)(?:\([2-5][0-9]{2}\)|[2-5][0-9]{2})[ .-]?[0-9]{3}[ .-]?[0-9]{2}[ .-]?[0-9]{2}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_-])(?:sk-|pk-|(?:sk|pk|rk)_(?:live|test)_|gh[opsu]_|AKIA)[A-Za-z0-9]{16,64}(?![A-Za-z0-9_-])",
    "tckn": r"(?<![0-9])[1-9][0-9]{10}(?![0-9])",
    "vkn": r"(?<![0-9+.,-])[0-9]{10}(?![0-9]|[.,-][0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9./])[0-9]{2}(?:\.[0-9]{2}\.|/[0-9]{2}/)[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
FORM = "|".join(f"(?:{x})" for x in FORMS.values())
#: 1900-01-01 to 2099-12-31 has 229 * 319 days.
DAYS, DAY_ROWS = 229, 319
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def _keyed(key: Column, tag: str, i: Column, value: Column) -> Column:
    """256 keyed bits, in hexadecimal."""
    return F.sha2(F.concat_ws("|", key, F.lit(tag), i.cast("string"), value, key), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(key: Column, tag: str, left: Column, right: Column, n_left, n_right) -> Column:
    """A struct (l, r): the pair permuted within n_left times n_right, by rounds that shift either half by a keyed function of the other."""
    n_left, n_right = _long(n_left), _long(n_right)
    domain = F.concat_ws("x", n_left.cast("string"), n_right.cast("string"))

    def step(s: Column, i: Column) -> Column:
        shift = lambda other: _number(_keyed(key, tag, i, F.concat_ws("|", domain, other.cast("string"))))
        even = F.struct(F.pmod(s["l"] + F.pmod(shift(s["r"]), n_left), n_left).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(shift(s["l"]), n_right), n_right).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(_long(left).alias("l"), _long(right).alias("r")), step)


def permute_digits(key: Column, tag: str, digits: Column) -> Column:
    """A string of 2 to 20 digits, permuted among those of its length."""
    a = F.floor(F.length(digits) / 2).cast("int")
    b = F.length(digits) - a
    power = lambda n: F.pow(F.lit(10.0), n).cast("long")
    made = feistel(key, tag, F.left(digits, a).cast("long"), F.right(digits, b).cast("long"), power(a), power(b))
    return F.concat(F.lpad(made["l"].cast("string"), a, "0"), F.lpad(made["r"].cast("string"), b, "0"))


def _shift(c: Column, by: Column, alphabets: tuple[str, ...], beyond: bool) -> Column:
    """The character ``by`` places on in its alphabet; with ``beyond``, letters past ASCII in their range, or else in their row of sixteen code points. Marks stay."""
    out = c
    if beyond:
        code = F.ascii(c)
        row = F.struct((code - code % 16).alias("a"), (code - code % 16 + 15).alias("z"))
        ranges = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(z).alias("z")) for a, z in LETTER_RANGES])
        own = F.coalesce(F.get(F.filter(ranges, lambda r: code.between(r["a"], r["z"])), F.lit(0)), row)
        size = own["z"] - own["a"] + 1
        moved = own["a"] + F.pmod(code - own["a"] + by * (F.floor(size / 256) + 1), size)
        letter = F.decode(F.unhex(F.lpad(F.hex(moved.cast("long")), 4, "0")), "UTF-16BE")
        out = F.when((code >= 0x80) & c.rlike(r"[\p{L}\p{N}]"), letter).otherwise(c)
    for s in alphabets:
        at = F.instr(F.lit(s), c)
        out = F.when(at > 0, F.substring(F.lit(s), (F.pmod(at - 1 + by, F.lit(len(s))) + 1).cast("int"), F.lit(1))).otherwise(out)
    return out


def _single(key: Column, tag: str, c: Column, alphabets: tuple[str, ...]) -> Column:
    """One character of an alphabet of even size, permuted among all of it."""
    out = F.lit(None).cast("string")
    for s in alphabets:
        at, half = F.instr(F.lit(s), c) - 1, len(s) // 2
        made = feistel(key, f"{tag}1", F.floor(at / half), at % half, 2, half)
        out = F.when(at >= 0, F.substring(F.lit(s), (made["l"] * half + made["r"] + 1).cast("int"), F.lit(1))).otherwise(out)
    return out


def permute_letters(key: Column, tag: str, value: Column, alphabets: tuple[str, ...] = (DIGITS, LOWER, UPPER), beyond: bool = False) -> Column:
    """A string of 64 characters at most, permuted among those with the same alphabet at each place; case is not part of the value.

    ``beyond``: letters beyond ASCII are permuted too.
    """
    a = F.floor(F.length(value) / 2).cast("int")

    def moved(half: Column, other: Column, i: Column) -> Column:
        digest = _keyed(key, tag, i, F.concat_ws("|", F.length(half).cast("string"), F.lower(other)))
        letters = F.transform(F.split(half, ""), lambda c, k: _shift(c, F.conv(F.substring(digest, (2 * k + 1).cast("int"), F.lit(2)), 16, 10).cast("int"), alphabets, beyond))
        return F.when(F.length(half) > 0, F.array_join(letters, "")).otherwise(half)

    def step(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(moved(s["l"], s["r"], i).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), moved(s["r"], s["l"], i).alias("r")))

    made = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(F.left(value, a).alias("l"), F.right(value, F.length(value) - a).alias("r")), step)
    several = F.concat(made["l"], made["r"])
    return F.when(F.length(value) == 1, F.coalesce(_single(key, tag, value, alphabets), several)).otherwise(several)


def _refill(form: Column, characters: str, new: Column) -> Column:
    """``form`` with its characters of a class replaced, in order, by those of ``new``."""
    rank = lambda k: F.length(F.regexp_replace(F.left(form, (k + 1).cast("int")), f"[^{characters}]", ""))
    return F.array_join(F.transform(F.split(form, ""), lambda c, k: F.when(c.rlike(f"[{characters}]"), F.substring(new, rank(k).cast("int"), F.lit(1))).otherwise(c)), "")


def _luhn_digit(body: Column) -> Column:
    """The digit that makes ``body`` pass the Luhn check."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(body), ""), lambda c, k: F.when(k % 2 == 0, F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10).otherwise(c.cast("int"))),
        F.lit(0),
        lambda s, d: s + d,
    )
    return F.pmod(-total, F.lit(10)).cast("string")


def _mod97(text: Column) -> Column:
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda r, c: (r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def _card(key: Column, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = permute_digits(key, "card", F.left(digits, F.length(digits) - 1))
    return F.when(F.call_function("luhn_check", digits), _refill(m, "0-9", F.concat(body, _luhn_digit(body)))).otherwise(m)


def _iban(key: Column, m: Column) -> Column:
    flat = F.replace(m, F.lit(" "), F.lit(""))
    country = F.left(flat, F.lit(2))
    rest = lambda s: F.substring(s, F.lit(5), F.length(s))
    valid = F.length(flat).between(15, 34) & (_mod97(F.concat(rest(flat), F.left(flat, F.lit(4)))) == 1)
    bban = permute_letters(key, "iban", rest(flat), (DIGITS, UPPER))
    check = F.lpad((98 - _mod97(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid, _refill(m, "0-9A-Z", F.concat(country, check, bban))).otherwise(m)


def _ipv4(key: Column, m: Column) -> Column:
    octet = F.transform(F.split(m, r"\."), lambda c: c.cast("long"))
    plain = F.forall(F.split(m, r"\."), lambda c: (c.cast("int") <= 255) & (c == c.cast("int").cast("string")))
    made = feistel(key, "ipv4", octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], 65536, 65536)
    parts = [F.floor(made["l"] / 256), made["l"] % 256, F.floor(made["r"] / 256), made["r"] % 256]
    return F.when(plain, F.concat_ws(".", *[p.cast("string") for p in parts])).otherwise(m)


def _phone(key: Column, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    code = F.length(F.regexp_extract(F.concat(F.lit("+"), digits), f"^{COUNTRY_CODE}", 0)) - 1
    code = F.when(m.startswith("+"), code).otherwise(0)
    valid = ~m.startswith("+") | (F.length(digits).between(8, 15) & (code > 0) & (F.length(digits) - code >= 4))
    home = m.startswith("0")
    code = F.when(home, F.length(digits) - 10).otherwise(code)
    valid = F.when(home, C.phone_valid(F.right(digits, F.lit(10)))).otherwise(valid)
    rest = permute_digits(key, "phone", F.substring(digits, code + 1, F.length(digits)))
    return F.when(valid, _refill(m, "0-9", F.concat(F.left(digits, code), rest))).otherwise(m)


def _ssn(key: Column, m: Column) -> Column:
    part = F.transform(F.split(m, "-"), lambda c: c.cast("long"))
    area, group, serial = part[0], part[1], part[2]
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    made = feistel(key, "ssn", area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
    new_area = made["l"] + F.when(made["l"] >= 665, 2).otherwise(1)
    new = F.format_string("%03d-%02d-%04d", new_area, F.floor(made["r"] / 9999) + 1, made["r"] % 9999 + 1)
    return F.when(valid, new).otherwise(m)


def _date(key: Column, m: Column) -> Column:
    out = m
    for mark, form in (("-", "yyyy-MM-dd"), (".", "dd.MM.yyyy"), ("/", "MM/dd/yyyy")):
        day = F.try_to_timestamp(m, F.lit(form)).cast("date")
        at = F.datediff(day, F.lit("1900-01-01").cast("date"))
        made = feistel(key, "date", F.floor(at / DAY_ROWS), at % DAY_ROWS, DAYS, DAY_ROWS)
        new = F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (made["l"] * DAY_ROWS + made["r"]).cast("int")), form)
        out = F.when(F.contains(m, F.lit(mark)), F.when(at.between(0, DAYS * DAY_ROWS - 1), new).otherwise(m)).otherwise(out)
    return out


def _email(key: Column, m: Column) -> Column:
    at = F.instr(m, "@")
    return F.concat(permute_letters(key, "email", F.left(m, at - 1), beyond=True), F.substring(m, at, F.length(m)))


def _token(key: Column, m: Column) -> Column:
    new = permute_letters(key, "token", F.lower(m), ("0123456789abcdef",))
    return F.when(m.rlike("[A-F]"), F.upper(new)).otherwise(new)


def _once(value: Column, work) -> Column:
    """``work`` of a value that is computed once, however often the work names it."""
    return F.get(F.transform(F.array(value), work), F.lit(0))


def _tckn(key: Column, m: Column) -> Column:
    made = feistel(key, "tckn", F.left(m, F.lit(1)).cast("long") - 1, F.substring(m, 2, 8).cast("long"), 9, 10**8)
    base = _once(made, lambda p: F.concat((p["l"] + 1).cast("string"), F.lpad(p["r"].cast("string"), 8, "0")))
    return F.when(C.tckn_valid(m), _once(base, C.tckn_digits)).otherwise(m)


def _vkn(key: Column, m: Column) -> Column:
    return F.when(C.vkn_valid(m), _once(permute_digits(key, "vkn", F.left(m, F.lit(9))), C.vkn_complete)).otherwise(m)


def _secret(key: Column, m: Column) -> Column:
    prefix = F.regexp_extract(m, "^(?:[a-z]+[-_](?:(?:live|test)_)?|AKIA)", 0)
    return F.concat(prefix, permute_letters(key, "secret", F.substring(m, F.length(prefix) + 1, F.length(m))))


KINDS = {"secret": _secret, "tckn": _tckn, "vkn": _vkn, "email": _email, "iban": _iban, "token": _token, "phone": _phone, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "card": _card}


def pseudonym(key: Column, m: Column) -> Column:
    """The pseudonym of one candidate."""
    out = m
    for kind in reversed(FORMS):
        out = F.when(m.rlike(f"^(?:{FORMS[kind]})$"), KINDS[kind](key, m)).otherwise(out)
    return out


@functools.lru_cache(maxsize=16)
def _pseudonyms(key: str, application: str) -> Column:
    """The pseudonyms of all candidates in ``found``; some thousand expressions, so they are made once for a key."""
    return F.transform("found", lambda m: pseudonym(F.lit(key), m))


def pseudonymize(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced; ``count`` names a column for the number of values replaced."""
    at = docs.columns.index(text)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    body = F.col(f"c{at}")
    # Every form has a digit, an @ or the prefix of a key, so most texts pass at the cost of one cheap search.
    maybe = body.rlike("[0-9@]|[spr]k[-_]|gh[opsu]_|AKIA")
    found = plain.withColumn("found", F.when(maybe, F.regexp_extract_all(body, F.lit(FORM), F.lit(0))))
    found = found.withColumn("new", _pseudonyms(key, docs.sparkSession.sparkContext.applicationId))
    woven = F.array_join(F.flatten(F.zip_with(F.split(body, FORM, -1), "new", lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    changed = F.aggregate(F.zip_with("found", "new", lambda a, b: (a != b).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    columns = [F.when(F.size("found") > 0, woven).otherwise(body) if i == at else F.col(f"c{i}") for i in range(len(docs.columns))]
    names = list(docs.columns)
    if count:
        columns = [c for c, n in zip(columns, names, strict=True) if n != count]
        names = [n for n in names if n != count] + [count]
        columns.append(F.coalesce(changed, F.lit(0).cast("long")))
    return found.select(*columns).toDF(*names)
