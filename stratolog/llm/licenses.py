"""Licence scan: exact phrases by words, and short notices within a bounded number of edits.

A notice that may differ in k places is cut into k + 1 seeds; at least one seed must occur unchanged (pigeonhole).  Seeds are found with one
Aho-Corasick pass, and only the places they point to are verified with the regex library's bounded-error matching, which also yields the span.

Null and empty texts have no words and no labels.  Long texts are scanned whole.  Rows are independent, so ties, repeated rows, empty tables and
extra columns need no rule: every input row gives one output row, and only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import blocks, utf8

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices and their labels, unless a table of others is given.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted, free of charge", "mit"),
    ("licensed under the apache license, version 2.0", "apache-2.0"),
    ("licensed under the gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("licensed under the mozilla public license", "mpl"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "reserved"),
]

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,start:long,end:long,edits:int>>"
)

#: Which lower-cased bytes belong to words: 0-9, a-z and every byte of a character beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True
_SEP = rb"[^0-9a-z\x80-\xff]+"
_EDGE = rb"(?<![0-9a-z\x80-\xff])%s(?![0-9a-z\x80-\xff])"


def lowered(text: str) -> str:
    """A-Z in lower case, nothing else changed."""
    return text.translate({c: c + 32 for c in range(65, 91)})


def allowed_edits(notice: str) -> int:
    """One edit for ten characters, at most four."""
    return min(4, len(notice) // 10)


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` consecutive parts of nearly equal length, with their offsets."""
    cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(4)
def _machine(given: tuple[tuple[str, str], ...] = tuple(NOTICES)):
    automaton, notices = ahocorasick.Automaton(), []
    by_seed: dict[str, list[tuple[int, int]]] = {}
    for n, (text, label) in enumerate(given):
        text = lowered(text)
        if not text:
            raise ValueError("a notice needs a text")
        edits = allowed_edits(text)
        notices.append((text, label, edits, regex.compile(rf"(?b)(?:{regex.escape(text)}){{e<={edits}}}")))
        for offset, seed in seeds(text, edits):
            by_seed.setdefault(seed, []).append((n, offset))
    for seed, uses in by_seed.items():
        automaton.add_word(seed, (len(seed), uses))
    if not by_seed:
        automaton.add_word("\0" * 64, (64, []))  # an empty automaton cannot search
    automaton.make_automaton()
    phrases = [(re.compile(_EDGE % _SEP.join(map(re.escape, p.encode().split()))), label) for p, label in PHRASES.items()]
    return automaton, notices, phrases


def fuzzy_notices(text: str, given: tuple[tuple[str, str], ...] = tuple(NOTICES)) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) of each notice found within its number of edits; overlapping places of one label keep the best."""
    automaton, notices, _ = _machine(given)
    places: dict[int, set[int]] = {}
    for end, (length, uses) in automaton.iter(text):
        for n, offset in uses:
            places.setdefault(n, set()).add(end + 1 - length - offset)
    found = []
    for n, starts in places.items():
        notice, label, edits, pattern = notices[n]
        for at in sorted(starts):
            lo = max(0, at - edits)
            if m := pattern.search(text[lo : at + len(notice) + edits]):
                found.append((sum(m.fuzzy_counts), lo + m.start(), lo + m.end(), label))
    kept: list[tuple[str, int, int, int]] = []
    for edits, start, end, label in sorted(found):
        if all(label != k[0] or end <= k[1] or start >= k[2] for k in kept):
            kept.append((label, start, end, edits))
    return sorted(kept, key=lambda k: (k[1], k[2], k[0]))


def _row(own: bytes, starts: np.ndarray, given: tuple) -> tuple:
    """starts: where the words of this text start, in bytes."""
    spans = fuzzy_notices(own.decode("utf-8", "replace"), given)
    base, labels = [], set()
    for pattern, label in _machine(given)[2]:
        at = 0
        while m := pattern.search(own, at):
            base.append(int(np.searchsorted(starts, m.start())))
            labels.add(label)
            at = m.start() + 1
    every = labels | {s[0] for s in spans}
    best = max((1 - e / (b - a) for _, a, b, e in spans if b > a), default=0.0)
    ordered = ",".join(sorted(labels)), ",".join(sorted(every))
    return len(base), min(base, default=None), max(base, default=None), *ordered, 1.0 if base else best, [dict(zip(("label", "start", "end", "edits"), s)) for s in spans]


def _scan(batches: Iterator[pa.RecordBatch], given: tuple) -> Iterator[pa.RecordBatch]:
    automaton = _machine(given)[0]
    rare = re.compile(rb"reserved|general|(?<![0-9a-z\x80-\xff])cc(?![0-9a-z\x80-\xff])")
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        n_words, rows = np.zeros(batch.num_rows, np.int64), []
        for lo, hi in blocks(offsets):
            part, ends = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            inside = IN_WORD[part]
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            edges = ends[:-1][ends[:-1] < len(part)]
            first[edges] = inside[edges]
            starts = np.flatnonzero(first)
            cut = np.searchsorted(starts, ends)
            n_words[lo:hi] = np.diff(cut)
            small = part.tobytes().lower()
            for k in range(hi - lo):
                own = small[ends[k] : ends[k + 1]]
                if rare.search(own) or next(automaton.iter(own.decode("utf-8", "replace")), None):
                    rows.append(_row(own, starts[cut[k] : cut[k + 1]] - ends[k], given))
                else:
                    rows.append((0, None, None, "", "", 0.0, []))
        columns = list(zip(*rows)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))]
        made = [pa.array(c, t) for c, t in zip(columns, kinds)]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), *made], names)


def scan_licenses(docs: DataFrame, notices: DataFrame | Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row per document: base phrases by words, labels with the fuzzy notices, and their spans in code points.

    ``notices``: pairs of text and label, or a table (text, label); every task holds all of them, so it is a table of notices, not of documents.
    """
    if isinstance(notices, DataFrame):
        notices = sorted((r["text"], r["label"]) for r in notices.select("text", "label").where("length(text) > 0 and label is not null").distinct().collect())
    given = tuple(map(tuple, notices))
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lambda batches: _scan(batches, given), SCHEMA)
