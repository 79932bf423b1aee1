"""Parsing, normalising and checking functions, from Column to Column. All stay in the JVM."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerege.functions import fixed

#: What a numeral must look like; casts alone accept suffixes such as 12d.
_NUMERAL = r"^[+-]?((\d+(_\d+)*)\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
_SPECIAL = r"(?i)^[+-]?(nan|inf|infinity)$"
#: Spellings that a key unites, in order.
KEY_WORDS = (("№", "номер"), ("иин/бин", "бин"), ("бин/иин", "бин"), ("счёт", "счет"), ("счет-фактура", "счет фактура"), ("получател", "покупател"))
_GAPS = "   '’‘"


#: Characters that count as white space at the ends of a value.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(text, F.lit(_SPACES))


def trimmed(value: Column) -> Column:
    """stripped, for a column or a field: a text with no white space at its ends stays as it is, as trimming looks up each end among all of _SPACES. Outside of lambdas only, where such tests are compiled."""
    solid = lambda x: x.between(0x21, 0x84) | x.between(0xA1, 0x167F)
    return F.when(solid(F.ascii(value)) & solid(F.ascii(F.substring(value, -1, 1))), value).otherwise(stripped(value))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def filled(value: Column) -> Column:
    """The value, null if it is empty. It is evaluated once: nullif evaluates it twice inside of a condition, and four times inside of another nullif."""
    return F.get(F.filter(F.array(value), lambda x: x != ""), 0)


def clean_text(text: Column) -> Column:
    """Single spaces for all white and hidden characters; null is empty."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), "[ ​‎ \t\r\n]", " ")
    return stripped(F.regexp_replace(spaced, r"(?U)\s+", " "))


def clean_key(text: Column) -> Column:
    """A header or label for comparison."""
    key = F.lower(clean_text(text))
    for old, new in KEY_WORDS:
        key = F.replace(key, F.lit(old), F.lit(new))
    return stripped(F.regexp_replace(F.regexp_replace(key, r"(?U)[^\w\s]+", " "), r"(?U)\s+", " "))


def only_digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{Nd}]", "")


def parse_number(text: Column) -> Column:
    """A double, null if the text isn't a numeral; comma is the point, gaps and apostrophes are dropped."""
    plain = stripped(F.replace(F.translate(text, _GAPS, ""), F.lit(","), F.lit(".")))
    special = lambda x: F.when(x.contains("nan"), F.lit("NaN")).when(x.startswith("-"), F.lit("-Infinity")).otherwise(F.lit("Infinity")).cast("double")
    return bound(plain, lambda x: F.when(x.rlike(_NUMERAL), F.replace(x, F.lit("_"), F.lit("")).try_cast("double")).when(x.rlike(_SPECIAL), special(F.lower(x))))


def is_strict_bin(text: Column) -> Column:
    """12 digits that aren't all the same."""
    digits = only_digits(text)
    # no shorter text has so many
    return (F.length(text) >= 12) & (F.length(digits) == 12) & ~digits.rlike(r"^(.)\1*$")


def is_bin(text: Column) -> Column:
    """12 digits among whatever else."""
    return F.length(only_digits(text)) == 12


def checksum_holds(text: Column) -> Column:
    """The mod-11 check digit of a 12-digit number: weights from 1, and from 3 where those give 10; false for other lengths."""
    return bound(identifier_number(text), _holds)


def identifier_number(text: Column) -> Column:
    """The 12 digits of a business number as a long; null for other lengths."""
    return bound(only_digits(text), lambda d: F.when(F.length(d) == 12, d.try_cast("bigint")))


def _holds(number: Column) -> Column:
    at = lambda k: F.call_function("div", number, F.lit(10 ** (12 - k))) % 10
    weighted = lambda first: sum((at(k) * (k + first - 1) for k in range(2, 12)), at(1) * first) % 11
    return F.coalesce(F.when(weighted(1) != 10, weighted(1)).otherwise(weighted(3)) == at(12), F.lit(False))


def holds_sql(number: str) -> str:
    """checksum_holds as SQL text for a long, null giving false. Digits are told by division, which stays in generated code; one text is parsed faster than its parts are put together."""
    at = lambda k: f"(({number} div {10 ** (12 - k)}) % 10)"
    weighted = lambda first: "((" + " + ".join(f"{at(k)} * {k + first - 1}" for k in range(1, 12)) + ") % 11)"
    return f"coalesce(if({weighted(1)} <> 10, {weighted(1)}, {weighted(3)}) = {at(12)}, false)"


def parse_date_exact(text: Column) -> Column:
    """A date if the whole text is one of five numeric forms."""
    plain = stripped(text)
    forms = (
        (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
        (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
        (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d"),
        (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    )
    return F.coalesce(*[F.when(plain.rlike(shape), F.try_to_timestamp(plain, F.lit(form)).cast("date")) for shape, form in forms])


def _made(year: Column, month: Column, day: Column) -> Column:
    return F.try_make_timestamp(year.try_cast("int"), month.try_cast("int"), day.try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")


def _made_of(year: int, month: int, day: int) -> Callable[[Column], Column]:
    return lambda parts: _made(F.get(parts, year), F.get(parts, month), F.get(parts, day))


def parse_date_text(text: Column) -> Column:
    """parse_date_found for a column whose texts are mostly dates in ISO form, which need no search."""
    return F.coalesce(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date")), parse_date_found(text))


def month_number(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, fixed.MONTHS)), F.lower(name)).cast("int")


def parse_date_found(text: Column) -> Column:
    """The first date in a text: four numeric orders, then a day, a month's Russian name and a year."""
    named = r'(?uU)(?:\bот\s+)?[«"]?(\d{1,2})[»"]?\s+(' + "|".join(fixed.MONTHS) + r")\s+(\d{4})"

    def found(plain: Column) -> Column:
        out = []
        for pattern, sep, (y, m, d) in ((r"\d{4}-\d{1,2}-\d{1,2}", "-", (1, 2, 3)), (r"\d{1,2}\.\d{1,2}\.\d{4}", r"\.", (3, 2, 1)), (r"\d{1,2}/\d{1,2}/\d{4}", "/", (3, 2, 1)), (r"\d{4}/\d{1,2}/\d{1,2}", "/", (1, 2, 3))):
            parts = F.split(F.regexp_extract(plain, pattern, 0), sep)
            out.append(bound(parts, _made_of(y - 1, m - 1, d - 1)))
        low = F.lower(plain)
        long = F.when(low.rlike("|".join(fixed.MONTHS)) & low.rlike(named), _made(F.regexp_extract(low, named, 3), month_number(F.regexp_extract(low, named, 2)), F.regexp_extract(low, named, 1)))
        # all numeric orders have this in common; long numbers, as most cells and fields are, haven't
        numeric = F.when(plain.rlike(r"\d[-./]\d{1,2}[-./]\d"), F.coalesce(*out))
        return F.when(plain.rlike(r"\d{4}"), F.coalesce(numeric, long))

    return bound(clean_text(text), found)


def excel_date(serial: Column) -> Column:
    """A timestamp for serial day numbers 20000 to 60000, else null."""
    return F.when(serial.between(20000, 60000), F.lit("1899-12-30 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (serial.cast("decimal(18,6)") * 86400).cast("decimal(18,6)")))


def to_iso(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))


def within_tolerance(a: Column, b: Column, absolute: float = 0.5, relative: float = 0.0005) -> Column:
    gap = F.abs(a - b)
    return F.coalesce((a == b) | (gap <= absolute) | F.when(b != 0, gap / F.abs(b) <= relative).otherwise(False), F.lit(False))


def human_size(n: Column) -> Column:
    """Bytes in the largest whole unit."""
    out = F.concat(F.floor(n / (1 << 40)).cast("string"), F.lit(" ТБ"))
    for k, unit in reversed(list(enumerate(("Б", "КБ", "МБ", "ГБ")))):
        out = F.when(n < (1 << 10 * (k + 1)), F.concat(F.floor(n / (1 << 10 * k)).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def first_of(fields: Column, keys: list[str]) -> Column:
    """The first of a map's values under these keys that isn't blank, stripped; else empty."""
    return F.coalesce(*[F.nullif(stripped(F.try_element_at(fields, F.lit(k))), F.lit("")) for k in keys], F.lit(""))


def plain_key(text: str) -> str:
    """clean_key of a literal."""
    key = re.sub(r"\s+", " ", text).strip().lower()
    for old, new in KEY_WORDS:
        key = key.replace(old, new)
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]+", " ", key)).strip()


def header_similarity(key: str, aliases: list[str], at_least: float = 0.0) -> Column:
    """Share of places at which a header's key (the name of a column made by clean_key) has the alias's character; the best alias counts.

    Shares under at_least may come out as 0: aliases that are too long or too short for it aren't compared.
    """
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    out = ["0.0D"]
    for alias in map(plain_key, aliases):
        same = " + ".join(["0", *[f"if(substring({key}, {k + 1}, 1) = {quoted(c)}, 1, 0)" for k, c in enumerate(alias)]])
        share = f"if({key} = {quoted(alias)}, 1.0D, ({same}) / greatest(length({key}), {max(1, len(alias))}))"
        if at_least > 0:
            share = f"if(length({key}) between {math.ceil(at_least * len(alias))} and {math.floor(len(alias) / at_least)}, {share}, 0.0D)"
        out.append(share)
    return F.expr("greatest(0.0D, " + ", ".join(out) + ")")


def cyrillic_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^А-яЁёІіґҐЇї]+", ""))


#: Characters of code page 1251 for the bytes 80 to FF but 98, and of 1252 for those bytes that it has between 80 and 9F.
_BYTES_1251 = [b for b in range(0x80, 0x100) if b != 0x98]
_FROM_1251, _TO_1251 = "".join(map(chr, _BYTES_1251)), bytes(_BYTES_1251).decode("cp1251")
_BYTES_1252 = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_FROM_1252, _TO_1252 = bytes(_BYTES_1252).decode("cp1252"), "".join(map(chr, _BYTES_1252))


def from_1251(text: Column) -> Column:
    """A text whose bytes were taken for Latin-1, as code page 1251 has them; byte 98 stays, as it stands for nothing there."""
    return F.translate(text, _FROM_1251, _TO_1251)


def _as_1251(text: Column) -> Column:
    """The characters' Latin-1 bytes read as code page 1251; null if they have none."""
    return F.when(~text.rlike("[^\\x00-\\xFF]|\\x98"), F.translate(text, _FROM_1251, _TO_1251))


def _as_utf8(text: Column) -> Column:
    """The characters' code page 1252 bytes read as UTF-8; null if they have none or aren't."""
    whole = F.when(text.rlike(f"[{_FROM_1252}]"), F.translate(text, _FROM_1252, _TO_1252)).otherwise(text)
    data = F.encode(F.when(~text.rlike(f"[^\\x00-\\x7F\\xA0-\\xFF{_FROM_1252}]"), whole), "ISO-8859-1")
    return F.try_validate_utf8(data.cast("string"))


def fix_mojibake(text: Column) -> Column:
    """The reading with most Cyrillic letters of a text and its re-decodings; the first on ties. Pure Cyrillic texts have no re-decoding."""
    once = F.struct(_as_1251(text).alias("one"), _as_utf8(text).alias("two"))
    readings = bound(once, lambda r: F.array(text, r["one"], r["two"], _as_1251(r["two"]), _as_utf8(r["one"])))
    counted = F.transform(readings, lambda x, k: F.when(x.isNotNull(), F.struct(cyrillic_count(x).alias("n"), (-k).alias("k"), x.alias("text"))))
    return F.when(text.rlike("[\\x80-\\xFF]"), F.array_max(counted)["text"]).otherwise(text)


def esf_section(text: Column, headers: Iterable[str] = tuple(fixed.SECTION_HEADERS)) -> Column:
    """From the first section header up to what follows the section; the whole text without a header."""
    at = F.array(*[F.regexp_instr(text, F.lit(f"(?iuU){h}")) for h in headers])
    first = F.array_min(F.filter(at, lambda x: x > 0))
    cut = lambda tail: bound(F.regexp_instr(tail, F.lit(f"(?iuUm){fixed.NEXT_SECTION}")), lambda stop: stripped(F.when(stop > 0, F.substr(tail, F.lit(1), stop - 1)).otherwise(tail)))
    return bound(first, lambda start: F.when(start.isNull(), text).otherwise(bound(F.substr(text, start), cut)))


def looks_like_money(text: Column) -> Column:
    plain = stripped(text)
    return (plain != "") & (plain.rlike("[,.’']") | F.length(only_digits(plain)).between(3, 8))


def near_identifier(context: Column) -> Column:
    """Does the text hold бин, ийн, iin or bin?"""
    return F.lower(F.coalesce(context, F.lit(""))).rlike("бин|ийн|iin|bin")


def level_name(level: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in fixed.LEVEL_NAMES.items() for x in p])[level], F.lit("Информация"))
