"""Synthetic values of every entity type as column expressions: the same for a row and seed wherever they are made.

Numbers carry valid check digits; what a seed draws comes from SHA-256, so the values of different
rows are independent and no state runs from row to row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.functions import checksums as C

# Pools of the types that have no number.
POOLS = {
    "PERSON": ["Ayşe Yılmaz", "Mehmet Kaya", "Zeynep Demir", "Ali Çelik", "Elif Şahin"],
    "ADDRESS": ["Atatürk Cad. No: 12 Kadıköy, İstanbul", "Gül Sok. No: 4 Çankaya, Ankara", "Deniz Mah. 17 Konak, İzmir"],
    "ORG": ["Örnek Lojistik A.Ş.", "Deneme Yazılım Ltd.", "Kuzey Gıda A.Ş."],
    "HEALTH": ["diyabet tanısı", "astım tedavisi"],
    "RELIGION": ["Müslüman", "Hristiyan"],
    "ETHNICITY": ["Laz kökenli", "Çerkes kökenli"],
    "POLITICAL": ["parti üyeliği", "siyasi görüş"],
    "SEXUAL_LIFE": ["cinsel yönelim", "cinsel yaşam"],
    "CRIMINAL": ["sabıka kaydı", "adli sicil"],
    "BIOMETRIC_REF": ["parmak izi", "yüz taraması"],
    "UNION": ["sendika üyesi", "sendika temsilcisi"],
}
MORPHOLOGIES = ("plain", "ascii", "lower", "suffix")
SUFFIXES = ("'ın", "'in", "'la", "'ye")


def drawn(name: str, row: Column, seed: int = 0, part: int = 0) -> Column:
    """A whole number below 2^60 for a name and row."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(name), F.lit(str(part)), row.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _hex(name: str, row: Column, seed: int, n: int) -> Column:
    return F.left(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(name), F.lit("hex"), row.cast("string")), 256), F.lit(n))


def _digits(number: Column, n: int) -> Column:
    return F.lpad((number % 10**n).cast("string"), n, "0")


def luhn_digit(body: Column, n: int) -> Column:
    """The digit that makes a string of ``n`` digits pass the Luhn check."""
    d = [F.substring(body, i + 1, 1).cast("int") for i in range(n)]
    twice = [x * 2 - F.when(x > 4, 9).otherwise(0) if (n - i) % 2 else x for i, x in enumerate(d)]
    return F.pmod(-reduce(Column.__add__, twice), F.lit(10))


def vkn_digits(base: Column) -> Column:
    """Nine digits completed to a valid VKN."""

    def part(i: int) -> Column:
        shifted = (F.substring(base, i + 1, 1).cast("int") + 9 - i) % 10
        residue = shifted * (1 << (9 - i)) % 9
        return F.when((shifted != 0) & (residue == 0), 9).otherwise(residue)

    return F.concat(base, F.pmod(-reduce(Column.__add__, [part(i) for i in range(9)]), F.lit(10)).cast("string"))


def value(type_: str, row: Column, seed: int = 0) -> Column:
    """A value of a type."""
    n = drawn(type_, row, seed)
    if type_ in POOLS:
        return F.element_at(F.array(*[F.lit(v) for v in POOLS[type_]]), (n % len(POOLS[type_])).cast("int") + 1)
    if type_ == "TR_TCKN":
        return C.tckn_digits((n % 900_000_000 + 100_000_000).cast("string"))
    if type_ == "TR_VKN":
        return vkn_digits(_digits(n, 9))
    if type_ == "TR_IBAN":
        return C.iban_complete(F.lit("TR"), F.concat(F.lit("00061"), _digits(n, 17)))
    if type_ == "IBAN_OTHER":
        return C.iban_complete(F.lit("DE"), _digits(n, 18))
    if type_ == "CREDIT_CARD":
        body = F.concat(F.lit("4"), _digits(n, 14))
        return F.concat(body, luhn_digit(body, 15).cast("string"))
    if type_ == "TR_PHONE":
        d = _digits(n, 9)
        return F.concat(F.lit("+90 5"), F.substring(d, 1, 2), F.lit(" "), F.substring(d, 3, 3), F.lit(" "), F.substring(d, 6, 2), F.lit(" "), F.substring(d, 8, 2))
    if type_ == "TR_PLATE":
        n = n % 900_000_000  # quotients are exact below 2^53
        letter = lambda by: F.substring(F.lit("ABCEKMRST"), (F.floor(n / by) % 9 + 1).cast("int"), F.lit(1))
        return F.concat(F.lpad((n % 81 + 1).cast("string"), 2, "0"), F.lit(" "), letter(100), letter(1000), F.lit(" "), (F.floor(n / 10_000) % 900 + 100).cast("string"))
    if type_ == "TR_SGK":
        body = _digits(n, 12)  # a number that is no card
        return F.concat(body, ((luhn_digit(body, 12) + 1) % 10).cast("string"))
    if type_ == "EMAIL":
        return F.concat(F.lit("kisi"), (n % 1_000_000).cast("string"), F.lit("@ornek"), (n % 17).cast("string"), F.lit(".com"))
    if type_ == "SECRET_API_KEY":
        return F.concat(F.lit("sk-"), _hex(type_, row, seed, 40))
    if type_ == "SECRET_JWT":
        h = _hex(type_, row, seed, 56)
        return F.concat(F.lit("eyJhbGciOiJIUzI1NiJ9."), F.left(h, F.lit(24)), F.lit("."), F.right(h, F.lit(32)))
    if type_ == "SECRET_PRIVATE_KEY":
        return F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), _hex(type_, row, seed, 64), F.lit("\n-----END PRIVATE KEY-----"))
    if type_ == "DOB":
        return F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), (n % 19_001).cast("int")), "dd.MM.yyyy")
    raise ValueError(f"no values for {type_}")


def morphed(text: Column, type_: str, morphology: Column, row: Column, seed: int = 0) -> Column:
    """A value as a sentence has it: names take a case suffix, and what no rule detects loses its diacritics."""
    out = text
    if type_ == "PERSON":
        suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (drawn("suffix", row, seed) % len(SUFFIXES)).cast("int") + 1)
        out = F.when(morphology == "suffix", F.concat(text, suffix)).otherwise(text)
    if type_ in POOLS:
        out = F.when(morphology == "ascii", F.translate(text, "çÇğĞıİöÖşŞüÜ", "cCgGiIoOsSuU")).otherwise(out)
    return out
