"""Scalar text functions as native Columns: normalisation, checksums, dates, sizes, keyed digests, authenticated encryption."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that normalise to a space or a hyphen, one for one.
SPACES = "\u00a0\u202f\u2007\u2009\u200a\u2003\u2002"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2212"
# Months (genitive and nominative) and ordinal days.
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
MONTHS_NOMINATIVE = ("январь", "февраль", "март", "апрель", "май", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь")
DAY_UNITS = {"первого": 1, "второго": 2, "третьего": 3, "четвертого": 4, "четвёртого": 4, "пятого": 5, "шестого": 6, "седьмого": 7, "восьмого": 8, "девятого": 9}
DAY_TEENS = {"десятого": 10, "одиннадцатого": 11, "двенадцатого": 12, "тринадцатого": 13, "четырнадцатого": 14, "пятнадцатого": 15, "шестнадцатого": 16, "семнадцатого": 17, "восемнадцатого": 18, "девятнадцатого": 19}
DAY_TENS = {"двадцатого": 20, "двадцать": 20, "тридцатого": 30, "тридцать": 30}
DAYS = DAY_UNITS | DAY_TEENS | DAY_TENS
#: Check-digit weights of the tax number: 10 digits, and the first and second check digit of 12.
INN_10, INN_12A, INN_12B = (2, 4, 10, 3, 5, 9, 4, 6, 8), (7, 2, 4, 10, 3, 5, 9, 4, 6, 8), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def norm_text(text: Column) -> Column:
    return F.translate(text, SPACES + DASHES, " " * len(SPACES) + "-" * len(DASHES))


def norm_find(text: Column, needle: Column, start: int = 0) -> Column:
    """First place (from 0) of needle in any case, from start on; -1 if there is none."""
    return F.call_function("locate", F.lower(needle), F.lower(text), F.lit(start + 1)) - 1


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _check_digit(digits: Column, weights: tuple[int, ...]) -> Column:
    total = sum((F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate(weights[1:], 1)), start=F.substring(digits, 1, 1).cast("int") * weights[0])
    return total % 11 % 10


def inn_valid(digits: Column) -> Column:
    """The check digit of 10 digits, or both of 12; false for any other length. digits: decimal digits only."""
    last = lambda n: F.substring(digits, n, 1).cast("int")
    return F.when(F.length(digits) == 10, _check_digit(digits, INN_10) == last(10)).when(F.length(digits) == 12, (_check_digit(digits, INN_12A) == last(11)) & (_check_digit(digits, INN_12B) == last(12))).otherwise(False)


def date_plausible(day: Column, month: Column, year: Column) -> Column:
    """Ranges only; the calendar isn't consulted."""
    return day.between(1, 31) & month.between(1, 12) & year.between(1900, 2026)


def _lookup(word: Column, table: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), word)


def month_index(word: Column) -> Column:
    table = {w: i + 1 for names in (MONTHS, MONTHS_NOMINATIVE) for i, w in enumerate(names)}
    return F.coalesce(_lookup(F.lower(word), table), F.lit(0))


def day_number(word: Column) -> Column:
    """An ordinal day in one word, or tens and unit; null if neither."""
    parts = F.split(F.lower(F.trim(word)), r"\s+")
    unit = _lookup(F.get(parts, F.lit(1)), DAY_UNITS)
    tens = _lookup(F.get(parts, F.lit(0)), {"двадцать": 20, "тридцать": 30})
    return F.when(F.size(parts) == 1, _lookup(F.get(parts, F.lit(0)), DAYS)).when(F.size(parts) == 2, tens + unit)


def parse_date(kind: str, a: Column, b: Column, c: Column) -> Column:
    """struct<day, month, year> of a match's three fields; kind: numeric, iso, words or written. Null where no reading fits."""
    make = lambda d, m, y: F.struct(d.cast("int").alias("day"), m.cast("int").alias("month"), y.cast("int").alias("year"))
    if kind == "numeric":
        x, y = a.cast("int"), b.cast("int")
        return F.when(y.between(1, 12), make(x, y, c)).when(x.between(1, 12), make(y, x, c))
    if kind == "iso":
        x, y = b.cast("int"), c.cast("int")
        return F.when((x > 12) & y.between(1, 12), make(x, y, a)).otherwise(make(y, x, a))
    day = a.cast("int") if kind == "words" else day_number(a)
    return F.when(day.isNotNull() & (month_index(b) > 0), make(day, month_index(b), c))


def token_estimate(text: Column) -> Column:
    return F.floor((F.length(text) + 3) / 4).cast("long")


def size_estimate(text: Column) -> Column:
    return (F.octet_length(text) + 512).cast("long")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex digest. The padded keys are literals of the plan: pass a derived key, not a master secret, and keep plans out of shared logs."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def derive_key(master: bytes, salt: bytes, info: bytes, length: int = 32) -> bytes:
    """HKDF-SHA256."""
    prk = hmac.new(salt or b"\0" * 32, master, hashlib.sha256).digest()
    out = block = b""
    for i in range(1, -(-length // 32) + 1):
        block = hmac.new(prk, block + info + bytes([i]), hashlib.sha256).digest()
        out += block
    return out[:length]


def seal(value: Column, key: Column, aad: Column) -> Column:
    """AES-GCM with a random nonce in front and aad bound in."""
    return F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad)


def unseal(value: Column, key: Column, aad: Column) -> Column:
    """Null where key, aad or value don't belong together."""
    return F.try_aes_decrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string")


def vault_key(namespace: Column, key: Column) -> Column:
    return F.concat_ws(":", F.lit("pii"), F.lit("vault"), namespace, key)
