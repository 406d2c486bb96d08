"""Checksum validators as column expressions over strings of ASCII digits (and capitals, for IBANs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Turkish area codes of landlines. Mobile numbers start with 5.
LANDLINES = """
212 216 222 224 226 228 232 236 242 246 248 252 256 258 262 264 266 272 274 276 282 284 286 288
312 318 322 324 326 328 332 338 342 344 346 348 352 354 356 358 362 364 366 368 370 372 374 376 378 380 382 384 386 388
412 414 416 422 424 426 428 432 434 436 438 442 446 452 454 456 458 462 464 466 472 474 476 478 482 484 486 488
""".split()


def _digit(s: Column, i: int) -> Column:
    """The i-th digit (from 1) as an integer."""
    return F.substring(s, i, 1).cast("int")


def tckn_valid(s: Column) -> Column:
    """Eleven digits, the first not 0, under two check equations."""
    odd = reduce(Column.__add__, [_digit(s, i) for i in (1, 3, 5, 7, 9)])
    even = reduce(Column.__add__, [_digit(s, i) for i in (2, 4, 6, 8)])
    tenth = F.pmod(odd * 7 - even, F.lit(10)) == _digit(s, 10)
    last = (odd + even + _digit(s, 10)) % 10 == _digit(s, 11)
    return F.coalesce(F.when(s.rlike("^[1-9][0-9]{10}$"), tenth & last), F.lit(False))


def _vkn_check(s: Column) -> Column:
    """The last digit, from weighted residues of the first nine."""

    def part(i: int) -> Column:
        shifted = (_digit(s, i + 1) + 9 - i) % 10
        residue = shifted * (1 << (9 - i)) % 9
        return F.when((shifted != 0) & (residue == 0), 9).otherwise(residue)

    return (10 - reduce(Column.__add__, [part(i) for i in range(9)]) % 10) % 10


def vkn_valid(s: Column) -> Column:
    """Ten digits; the last checks weighted residues of the first nine."""
    return F.coalesce(F.when(s.rlike("^[0-9]{10}$"), _vkn_check(s) == _digit(s, 10)), F.lit(False))


def vkn_complete(base: Column) -> Column:
    """Nine digits completed to a valid VKN."""
    return F.concat(base, _vkn_check(base).cast("string"))


def mod97(s: Column) -> Column:
    """Remainder of an IBAN with its first four characters moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substring(s, 5, 64), F.left(s, F.lit(4)))
    letter = lambda c: c.rlike("[A-Z]")
    step = lambda r, c: F.when(letter(c), (r * 100 + F.ascii(c) - 55) % 97).otherwise((r * 10 + F.ascii(c) - 48) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def iban_valid(s: Column) -> Column:
    """15 to 34 characters, remainder 1; a TR number has 26 with digits from the fifth on."""
    shape = s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (~s.startswith("TR") | s.rlike("^TR[0-9]{24}$"))
    return F.coalesce(F.when(shape, mod97(s) == 1), F.lit(False))


def card_valid(s: Column) -> Column:
    """13 to 19 digits that pass the Luhn check."""
    return F.coalesce(F.when(s.rlike("^[0-9]{13,19}$"), F.call_function("luhn_check", s)), F.lit(False))


def phone_national(s: Column, plus: Column | None = None) -> Column:
    """Digits without country code or trunk 0; ``plus`` says whether the number was written with a plus."""
    code = F.length(s) == 12 if plus is None else plus | (F.length(s) == 12)
    cut = F.when(s.startswith("0090"), 4).when(s.startswith("90") & code, 2).when(s.startswith("0"), 1).otherwise(0)
    return F.substring(s, cut + 1, F.length(s))


def phone_valid(national: Column) -> Column:
    return (F.length(national) == 10) & (national.startswith("5") | F.left(national, F.lit(3)).isin(LANDLINES))


def plate_province(s: Column) -> Column:
    """The province of a plate: 1 to 81, else null."""
    n = F.regexp_extract(s, r"^0?([0-9]{1,2})[ -]*[A-ZÇĞİÖŞÜ]{1,3}[ -]*[0-9]{2,4}$", 1)
    n = F.when(n != "", n.cast("int"))
    return F.when(n.between(1, 81), n)


def tckn_digits(base: Column) -> Column:
    """Nine digits completed to a valid TCKN."""
    odd = reduce(Column.__add__, [_digit(base, i) for i in (1, 3, 5, 7, 9)])
    even = reduce(Column.__add__, [_digit(base, i) for i in (2, 4, 6, 8)])
    tenth = F.pmod(odd * 7 - even, F.lit(10))
    return F.concat(base, tenth.cast("string"), ((odd + even + tenth) % 10).cast("string"))


def iban_complete(country: Column, bban: Column) -> Column:
    """An IBAN with its check digits."""
    check = 98 - mod97(F.concat(country, F.lit("00"), bban))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), bban)
