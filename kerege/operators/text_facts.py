"""Facts from running text: numbers behind labels, dates, totals."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerege.functions import fixed
from kerege.functions.scalars import bound, filled, looks_like_money, month_number, near_identifier, only_digits, parse_number, stripped

_FLAGS = "(?iuU)"
#: Characters before and after a number in which a business number's name speaks against a total.
CONTEXT = 40


def _groups(pattern: str) -> int:
    return re.compile(pattern).groups


def text_bin(text: Column, labels: list[str]) -> Column:
    """The number within 80 characters without digits (lines may end among them) behind the first label that has one; else empty."""
    found = [F.regexp_extract(text, rf"{_FLAGS}(?:{x})[^\d]{{0,80}}(\d[\d \-'.]{{3,}})", _groups(x) + 1) for x in labels]
    return F.coalesce(*[filled(stripped(x)) for x in found], F.lit(""))


def header_date(text: Column) -> Column:
    return F.coalesce(*[filled(F.regexp_extract(text, f"{_FLAGS}{h}{fixed.ANY_DATE}", 1)) for h in fixed.HEADER_DATES], F.lit(""))


def body_date(text: Column) -> Column:
    """A labelled date, a date with a month's Russian name, or the first date with a border on both sides; else empty."""
    labelled = [filled(F.regexp_extract(text, rf"{_FLAGS}{x}\s*{fixed.ANY_DATE}", 1)) for x in fixed.DATE_LABELS]
    named = _FLAGS + r"\b(\d{1,2})\b\s+(" + "|".join(fixed.MONTHS) + r")\s+\b(\d{4})\b"
    day, month, year = (F.regexp_extract(text, named, k) for k in (1, 2, 3))
    made = F.try_make_timestamp(year.try_cast("int"), month_number(month), day.try_cast("int"), F.lit(0), F.lit(0), F.lit(0))
    bare = F.regexp_extract(text, r"(?U)(\b\d{2}[./-]\d{2}[./-]\d{4}\b)|(\b\d{4}[./-]\d{2}[./-]\d{2}\b)", 0)
    return F.coalesce(*labelled, F.date_format(made, "dd.MM.yyyy"), bare, F.lit(""))


def text_date(text: Column) -> Column:
    return F.coalesce(filled(header_date(text)), body_date(text))


def _clear_of_identifiers(text: Column, start: Column, length: Column) -> Column:
    """No business number's name around the place; start counts from 1."""
    first = F.greatest(start - CONTEXT, F.lit(1))
    return ~near_identifier(F.substr(text, first, start + length + CONTEXT - first))


def _behind(text: Column, pattern: str) -> Column:
    """The number of a pattern's first place if it has money on it, else null; each search is made once, and those that follow only where the first has found something."""

    def told(m: Column) -> Column:
        start = F.regexp_instr(text, F.lit(pattern)) + F.length(m["whole"]) - F.length(m["raw"])
        return F.when(looks_like_money(m["value"]) & parse_number(m["value"]).isNotNull() & _clear_of_identifiers(text, start, F.length(m["raw"])), m["value"])

    def parts(whole: Column) -> Column:
        told_of = lambda raw: bound(F.struct(whole.alias("whole"), raw.alias("raw"), stripped(raw).alias("value")), told)
        return F.when(whole != "", bound(F.regexp_extract(text, pattern, 1), told_of))

    return bound(F.regexp_extract(text, pattern, 0), parts)


def preferred_total(text: Column) -> Column:
    """The number behind the first of the preferred labels whose first place has money on it; else empty."""
    return F.coalesce(*[_behind(text, rf"(?iuUs){label}[^\d]{{0,220}}{fixed.MONEY}") for label in fixed.PREFERRED_TOTALS], F.lit(""))


#: What a money number is made of.
_MONEY_CHARS = fixed.MONEY.strip("()+")


def _first_letters(labels: Iterable[str]) -> str:
    """A look at the next letter, where all labels begin with a plain one; else nothing."""
    letters = sorted({x[:1] for x in labels})
    return "(?=[" + "".join(letters) + "])" if all(x.isalpha() for x in letters) else ""


def scored_total(text: Column, gap: int = 140, total_labels: Iterable[str] = tuple(fixed.TOTAL_LABELS)) -> Column:
    """The best number near any label: separators count two, four digits one, then the larger number, then the later; else empty.

    A label is tried where one of their first letters stands. A number in front of a label is tried from its first character alone and
    never given back in part: from a later place, or with fewer characters, no label is reached that isn't reached so.
    """
    first = _first_letters(total_labels)
    labels = f"{first}(?:" + "|".join(total_labels) + ")"
    gap = max(20, min(gap, 300))
    shapes = (rf"{_FLAGS}{labels}\s*[:\-]?\s*[^\d\n\r]{{0,{gap}}}{fixed.MONEY}", rf"{_FLAGS}(?<!{_MONEY_CHARS})({_MONEY_CHARS}++)[^\d\n\r]{{0,{gap}}}{labels}")

    def candidates(k: int) -> Column:
        # matches follow one another, so each one's place is the first of its words behind the one before
        wholes, raws = (F.regexp_extract_all(text, F.lit(shapes[k]), F.lit(g)) for g in (0, 1))
        return bound(F.struct(wholes.alias("w"), raws.alias("x")), lambda m: F.transform(F.arrays_zip(_starts(text, m["w"]).alias("s"), m["w"].alias("w"), m["x"].alias("x")), _placed(k)))

    def scored(z: Column) -> Column:
        return bound(F.struct(stripped(z["raw"]).alias("value"), parse_number(z["raw"]).alias("number")), lambda y: F.when(good(z, y["value"]) & y["number"].isNotNull(), F.struct(score(y["value"]).alias("score"), y["number"].alias("number"), z["place"].alias("place"), y["value"].alias("value"))))

    score = lambda value: F.when(value.rlike("[,.’']"), 2).otherwise(0) + F.when(F.length(only_digits(value)) >= 4, 1).otherwise(0)
    good = lambda z, value: looks_like_money(value) & _clear_of_identifiers(text, z["start"], F.length(z["raw"]))
    best = F.array_max(F.filter(F.transform(F.concat(candidates(0), candidates(1)), scored), lambda x: x.isNotNull()))
    return F.when(text.rlike(f"(?iu){first}"), F.coalesce(best["value"], F.lit(""))).otherwise(F.lit(""))


def _placed(shape: int):
    """A candidate of a match: its number ends the match in the first shape, and begins it in the second."""

    def run(z: Column, i: Column) -> Column:
        start = z["s"] + F.length(z["w"]) - F.length(z["x"]) if shape == 0 else z["s"]
        return F.struct(start.alias("start"), z["x"].alias("raw"), (i + shape * 1_000_000).alias("place"))

    return run


def _starts(text: Column, matches: Column) -> Column:
    """Where matches stand that follow one another in a text, from 1."""
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(state: Column, match: Column) -> Column:
        place = F.call_function("locate", match, text, state["at"])
        return F.struct((place + F.length(match)).cast("int").alias("at"), F.array_append(state["starts"], place).alias("starts"))

    return F.aggregate(matches, zero, step)["starts"]


def text_total(text: Column, gap: int = 140, total_labels: Iterable[str] = tuple(fixed.TOTAL_LABELS)) -> Column:
    return F.coalesce(filled(preferred_total(text)), scored_total(text, gap, total_labels))


def pdf_bins(text: Column) -> tuple[Column, Column]:
    """Supplier's and buyer's number of a PDF's text: labelled, else the first and the second number behind БИН."""
    first = lambda patterns: F.coalesce(*[filled(F.regexp_extract(text, f"{_FLAGS}{p}", 1)) for p in patterns])
    every = F.regexp_extract_all(text, F.lit(f"{_FLAGS}{fixed.PDF_ANY}"), F.lit(1))
    return F.coalesce(first(fixed.PDF_SUPPLIER), F.get(every, 0), F.lit("")), F.coalesce(first(fixed.PDF_BUYER), F.get(every, 1), F.lit(""))


def pdf_date(text: Column) -> Column:
    found = F.coalesce(*[filled(F.regexp_extract(text, f"{_FLAGS}{p}", 1)) for p in fixed.PDF_DATES], F.lit(""))
    return F.regexp_replace(found, r"(?U)\s*[./-]\s*", ".")


def pdf_total(text: Column) -> Column:
    """The last match of the last pattern that has one."""
    every = F.concat(*[F.regexp_extract_all(text, F.lit(f"{_FLAGS}{p}"), F.lit(1)) for p in fixed.PDF_TOTALS])
    last = F.when(F.size(every) > 0, F.element_at(every, -1)).otherwise(F.lit(""))
    return stripped(F.replace(F.translate(last, "  ", ""), F.lit(","), F.lit(".")))


def pdf_layer(text: Column) -> Column:
    """The text layer's white space, as extraction leaves it: gaps to spaces, bullets to points. Compatibility forms are left to the reader."""
    plain = F.translate(text, " •", " ..")
    return stripped(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r"(?U)\s{2,}", " "), r"\n+", "\n"))
