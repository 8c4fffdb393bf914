"""License scan: exact phrases, and short notices with a few errors.

A notice of m characters with at most k errors holds at least one of k + 1 disjoint pieces
unchanged, so exact searches for the pieces find every place where a match can lie. Around
each such place, in a window of its own, the ``regex`` library finds the best match of the whole notice
with at most k errors and reports the span and the number of edits. An edit changes three of a notice's runs of three
characters at most, so places that miss more than 3 k of them are passed over first.

Null text counts as empty: no words, labels or spans, and score 0. Repeated rows each get
their row. Other columns of the input are ignored. Long texts are scanned whole; an empty table
gives no rows.
"""

from __future__ import annotations

from bisect import bisect
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_ready, batch, lean, text_bytes

#: Exact phrases and their labels (fixed values).
PHRASES = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}

#: Short notices and their labels (fixed values).
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "subject to the terms of the mozilla public license": "mpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

#: Bytes outside words become blanks, A-Z become lower case; all bytes beyond ASCII belong to words.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def errors_allowed(notice: str) -> int:
    """One edit for each ten characters, four at most."""
    return min(4, len(notice) // 10)


def runs(text: bytes) -> set[bytes]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def seeds(notice: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 disjoint pieces that cover the notice."""
    edges = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(edges, edges[1:])]


@cache
def searches() -> tuple[dict[bytes, list[tuple[str, int, int]]], dict[str, object]]:
    """Each piece with the (notice, offset, errors) it stands for; each notice's pattern."""
    import regex

    pieces: dict[bytes, list[tuple[str, int, int]]] = {}
    patterns = {}
    for notice in NOTICES:
        k = errors_allowed(notice)
        patterns[notice] = (regex.compile(rf"(?b)(?:{regex.escape(notice)}){{e<={k}}}".encode()), own := runs(notice.encode()), len(own) - 3 * k)
        for offset, piece in seeds(notice, k):
            pieces.setdefault(piece.encode(), []).append((notice, offset, k))
    return pieces, patterns


def places(needle: bytes, text: bytes) -> list[int]:
    found, at = [], text.find(needle)
    while at >= 0:
        found.append(at)
        at = text.find(needle, at + 1)
    return found


def scan(text: bytes) -> dict:
    """Words, exact phrases, and fuzzy notices of one text. Spans are word numbers, the end exclusive."""
    blanked = text.translate(WORD_BYTES)
    words = blanked.split()
    whole = b" ".join(words)
    line = b" " + whole + b" "
    starts, base = [], set()
    for phrase, label in PHRASES.items():
        if found := places(b" " + phrase + b" ", line):
            starts += found
            base.add(label)
    first = last = None
    if starts:
        first, last = line.count(b" ", 0, min(starts) + 1) - 1, line.count(b" ", 0, max(starts) + 1) - 1
    pieces, patterns = searches()
    windows: dict[str, list[tuple[int, int]]] = {}
    for piece, uses in pieces.items():
        if piece in whole:
            for at in places(piece, whole):
                for notice, offset, k in uses:
                    windows.setdefault(notice, []).append((max(0, at - offset - k), at - offset + len(notice) + k))
    spans, best = [], float(bool(starts))
    blanks = None
    for notice, ranges in windows.items():
        pattern, own, least = patterns[notice]
        seen = set()
        for a, b in sorted(set(ranges)):  # each by itself: in a wider window a better notice would hide a poorer one beside it
            if len(own & runs(whole[a:b])) < least or not (m := pattern.search(whole, a, min(b, len(whole)))) or m.span() in seen:
                continue
            seen.add(m.span())
            edits = sum(m.fuzzy_counts)
            if blanks is None:
                blanks = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
            first_word = int(np.searchsorted(blanks, m.start()))
            spans.append((NOTICES[notice], first_word, first_word + m.group().strip().count(b" ") + 1, edits))
            best = max(best, 1 - edits / len(notice))
    spans.sort(key=lambda s: (s[3], s[1] - s[2], s))
    kept: list[tuple[int, int, tuple]] = []  # by place; no two lie over each other
    for s in spans:  # of notices that lie over each other, the one with fewest edits
        at = bisect(kept, (s[1], s[2]))
        if (not at or kept[at - 1][1] <= s[1]) and (at == len(kept) or kept[at][0] >= s[2]):
            kept.insert(at, (s[1], s[2], s))
    spans = [s for _, _, s in kept]
    return {"n_words": len(words), "n_base": len(starts), "first_word": first, "last_word": last, "base_labels": sorted(base), "labels": sorted(base | {s[0] for s in spans}), "score": best, "spans": sorted(spans)}


SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32())])
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()), ("spans", pa.list_(SPAN))])
DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<struct<label: string, first_word: long, end_word: long, edits: int>>"


def license_scan(documents: DataFrame) -> DataFrame:
    """One row for each document, with arrays of labels and the spans of fuzzy notices."""

    def scanned(batches):
        for b in batches:
            found = [scan(x.as_py()) for x in b.column(1)]
            spans = pa.array([[dict(zip(("label", "first_word", "end_word", "edits"), s)) for s in x["spans"]] for x in found], SCHEMA.field("spans").type)
            yield batch(SCHEMA, doc_id=b.column(0), spans=spans, **{n: [x[n] for x in found] for n in SCHEMA.names[1:-1]})

    arrow_ready(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(lean(scanned), DDL)
