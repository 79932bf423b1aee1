"""Licence scans: exact phrases, and fuzzy search for short notices.

A text becomes its words (ASCII lower-cased; ASCII characters other than letters and digits separate). Base places are where a
phrase's words stand consecutively. Notices are searched with errors: of the two halves of a notice that may have k edits one has at most
k // 2, and if that half is cut into k // 2 + 1 parts, at least one of them occurs as it is. So one automaton over all parts locates the
candidates; around each the regex library's bounded-error matching verifies the half with its edits, and where that holds the
whole notice, which begins and ends with whole words; it gives the span. Words are counted on from place to place, so a text takes time in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerege.shipping import ship_package

#: Base phrases and labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices of public licences, as words.
NOTICES = {
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under cc by 4 0": "cc-by",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee": "isc",
    "subject to the terms of the mozilla public license": "mpl",
}
#: One edit is allowed for so many characters of a notice.
PER_EDIT = 10

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def parts(text: str, edits: int) -> list[tuple[int, str]]:
    """A text in edits + 1 parts of about equal length, with their places."""
    at = [len(text) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, text[a:b]) for a, b in zip(at, at[1:], strict=False)]


def word_numbers(text: bytes | str, places: list[int]) -> list[int]:
    """How many spaces stand before each of the ascending places."""
    out, n, last = [], 0, 0
    space = b" " if isinstance(text, bytes) else " "
    for at in places:
        n += text.count(space, last, at)
        last = at
        out.append(n)
    return out


class NoticeFinder:
    """Base places and fuzzy notices of one text after another."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, str], per_edit: int = PER_EDIT):
        import ahocorasick
        import regex

        fuzzy = lambda text, edits, ends: regex.compile(f"{ends}(?:{regex.escape(text, literal_spaces=True)}){{e<={edits}}}" + ("(?![^ ])" if ends else ""))
        self.phrases = {f" {p} ".encode(): label for p, label in phrases.items()}
        self.notices = [(n, label, len(n) // per_edit, fuzzy(n, len(n) // per_edit, "(?b)(?<![^ ])")) for n, label in notices.items()]
        self.halves: list[tuple[int, int, str, int, object]] = []  # notice, place in it, text, edits, pattern
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (notice, _, edits, _) in enumerate(self.notices):
            for at, half in parts(notice, 1):
                for inner, part in parts(half, edits // 2):
                    seeds.setdefault(part, []).append((len(self.halves), inner))
                self.halves.append((k, at, half, edits // 2, fuzzy(half, edits // 2, "")))
        self.automaton = ahocorasick.Automaton()
        for part, places in seeds.items():
            self.automaton.add_word(part, (len(part), places))
        self.automaton.make_automaton()

    def base(self, padded: bytes) -> list[tuple[int, str]]:
        """(word, label) of each place of a phrase in the words with a space before, between and after them."""
        found = []
        for phrase, label in self.phrases.items():
            places, at = [], padded.find(phrase)
            while at >= 0:
                places.append(at)
                at = padded.find(phrase, at + 1)
            found += [(w, label) for w in word_numbers(padded, places)]
        return found

    @staticmethod
    def _joined(spans: list[list[int]]) -> list[list[int]]:
        out: list[list[int]] = []
        for a, b in sorted(spans):
            if out and a <= out[-1][1]:
                out[-1][1] = max(b, out[-1][1])
            else:
                out.append([a, b])
        return out

    def fuzzy(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(label, start, end, edits, length of the notice) in the words joined by spaces, as characters; best first in each stretch."""
        near: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for h, at in places:
                _, _, half, edits, _ = self.halves[h]
                start = end + 1 - length - at
                near.setdefault(h, []).append([max(0, start - edits), min(len(text), start + len(half) + edits)])
        wanted: dict[int, list[list[int]]] = {}
        for h, spans in near.items():
            k, place, _, less, pattern = self.halves[h]
            notice, _, edits, _ = self.notices[k]
            for a, b in self._joined(spans):
                for m in pattern.finditer(text, a, b, overlapped=True):
                    start = m.start() - place
                    wanted.setdefault(k, []).append([max(0, start - edits - less), min(len(text), start + len(notice) + 2 * edits + less)])
        out = set()
        for k, spans in wanted.items():
            notice, label, _, pattern = self.notices[k]
            for a, b in self._joined(spans):
                out |= {(label, m.start(), m.end(), sum(m.fuzzy_counts), len(notice)) for m in pattern.finditer(text, a, b)}
        return sorted(out, key=lambda x: (x[1], x[3], x))

    def scan(self, text: str | None) -> dict:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
        joined = b" ".join(words)
        base = self.base(b" " + joined + b" ")
        plain = joined.decode("utf-8", "surrogatepass")
        fuzzy = self.fuzzy(plain)
        at = [w for w, _ in base]
        own = {label for _, label in base}
        return {
            "n_words": len(words),
            "n_base": len(base),
            "first_word": min(at, default=None),
            "last_word": max(at, default=None),
            "base_labels": ",".join(sorted(own)),
            "labels": ",".join(sorted(own | {x[0] for x in fuzzy})),
            "score": 1.0 if base else max((1 - x[3] / x[4] for x in fuzzy), default=0.0),
            "spans": [{"label": x[0], "first_word": w, "edits": x[3], "notice": plain[x[1] : x[2]]} for x, w in zip(fuzzy, word_numbers(plain, [x[1] for x in fuzzy]), strict=True)],
        }


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, edits: int, notice: string>>"
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("edits", pa.int32()), ("notice", pa.string())]))
_KINDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": _SPAN}


def _scanned(phrases: dict[str, str], notices: dict[str, str], per_edit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = NoticeFinder(phrases, notices, per_edit)
        for batch in batches:
            rows = [finder.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[c] for r in rows], t) for c, t in _KINDS.items()]], names=["doc_id", *_KINDS])

    return run


def scan_licences(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, per_edit: int = PER_EDIT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (of fuzzy notices).

    Null texts count as empty: no words, no labels, score 0. The score is 1 with a base place, else 1 less the best
    notice's edits per character. Texts are scanned whole whatever their length; rows that repeat a doc_id are scanned each for itself. Other columns are
    ignored; an empty table gives an empty one.
    """
    ship_package(docs.sparkSession)
    run = _scanned(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices, per_edit)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def op6_fuzzy_notices(spark, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in the whole documents table."""
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
