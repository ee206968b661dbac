"""Substring dedup: repeated word windows, found with FM-indexes over shards.

Sharding.  Each window of ``window`` words has an anchor: the k-gram of least hash within it (leftmost of equal ones), so equal windows have equal
anchors.  Consecutive windows with the same anchor form a segment, and each window lies in exactly one segment.  Anchors that occur once cannot belong to a
repeated window; those that occur again pass a bitmap (of bounded size; false positives only cost work) and send their segments on.  Equal segments
are combined before they meet, with a count.  A shard holds all segments of its anchors.

An anchor may have any number of distinct segments.  Where those of one anchor hold more than ``ANCHOR_WORDS``, they are cut into their single windows, each a
segment of its own that is anchored by the hash of the whole window, so that no task needs all of them.  Again, what occurs once under its anchor is not sent on, and the
shards search them like all other segments: a hash only says where a window goes, never that it is repeated.

Search.  A shard indexes its distinct segments once each (suffix array, wavelet matrix) and streams them against that index: backward search finds how far a
stretch still occurs elsewhere, and from that the repeated windows, as a bit mask per segment.  Segments that occur twice are repeated as a whole.

Results go back by the segment's 128-bit hash to (row, first word), and each document drops the words that a repeated window covers.  The text of segments is
written once, combined; the places of segments are found again from the documents and carry no text.

Null and empty texts, and texts shorter than a window, lose nothing.  Long texts are searched whole.  Repeated rows are copies of each other.  An empty
table gives an empty result.  Only ``doc_id`` and ``text`` are read.  Windows may have any number of words: k is so large that a segment has no more windows than
a mask has bits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, few, hashes, reliable, shared_folder, utf8
from .fmindex import FMIndex

WINDOW = 35
#: Words of segments in a shard, at most about; those of one anchor beyond which its windows go separate ways; bits of the bitmap at most, as a power of two.
SHARD_WORDS, ANCHOR_WORDS, BITMAP = 400_000, 400_000, 27
#: Windows of a segment at most.
MASK_BITS = 63
#: Bytes of texts that are looked at side by side.
BLOCK = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64)
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), base)]), dtype=np.uint64)


@lru_cache(2)
def _usual_powers(base: np.uint64) -> np.ndarray:
    return _powers(base, BLOCK)


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    return _usual_powers(base)[:n] if n <= BLOCK else _powers(base, n)


def _grams(word: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row: sums of words times powers of a constant, for twice as many words at each step."""
    base, done, out, span = 0xD6E8FEB86659FD93, 0, None, 1
    n = len(word) - k + 1
    while True:
        if k & span:
            tail = word[done : done + n]
            out = tail if out is None else out * np.uint64(pow(base, span, 2**64)) + tail
            done += span
        if 2 * span > k:
            return out
        word = word[: len(word) - span] * np.uint64(pow(base, span, 2**64)) + word[span:]
        span *= 2


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of ``width`` values (at most 256) how far from its start its least value is, the first of equal ones."""
    least, at, span = values, np.zeros(len(values), np.uint8), 1
    while span < width:
        step = min(span, width - span)
        later = least[step:] < least[:-step]
        at = np.where(later, at[step:] + np.uint8(step), at[:-step])
        least = np.minimum(least[:-step], least[step:])
        span += step
    return at


class Words:
    """The words of a block of texts: where they start and end, in which row, and a hash of each (for anchors only: nothing is judged by it)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = ~_BLANK[data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        begins[cuts] = inside[cuts]
        ends = offsets[1:][offsets[1:] > 0] - 1
        stops[ends] = inside[ends]
        self.data, self.start, self.end = data, np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.row_end = np.searchsorted(self.start, offsets[1:])
        self.row_start = np.concatenate([[0], self.row_end[:-1]])

    def segments(self, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """row, first and last window (word numbers within the block) and anchor hash of each segment."""
        n = len(self.start)
        none = np.zeros(0, np.int64)
        if n < window:
            return none, none, none, none
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[self.data] * _power_table(_R, len(self.data)), dtype=np.uint64)])
        inverse = _power_table(_R_INVERSE, len(self.data))
        word = _mix((prefix[self.end] - prefix[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))
        gram = _mix(_grams(word, k))
        row = np.repeat(np.arange(len(self.row_end)), self.row_end - self.row_start)
        start = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
        if not len(start):
            return none, none, none, none
        anchor = start + _leftmost_least(gram, window - k + 1)[start]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
        at = np.flatnonzero(new)
        last = np.concatenate([at[1:], [len(start)]]) - 1
        return row[start[at]], start[at], start[last], gram[anchor[at]].view(np.int64)

    def normal(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The block with one space after each word, and where words start and end in it."""
        size = self.end - self.start
        start = np.cumsum(size + 1) - size - 1
        out = np.full(int((size + 1).sum()), 32, np.uint8)
        out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = self.data[~_BLANK[self.data]]
        return out.tobytes(), start, start + size


def _anchors(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            found = [np.zeros(0, np.int64)]
            for lo, hi in blocks(offsets, BLOCK):
                found.append(Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]).segments(window, k)[3])
            anchor, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], ["anchor", "n"])

    return run


def _segments(window: int, k: int, bitmap, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = np.frombuffer(bitmap.value, np.uint64)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            keys = [batch.column(c) for c in ("doc_id", "h1", "h2")]
            for lo, hi in blocks(offsets, BLOCK):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                row, first, last, anchor = words.segments(window, k)
                slot = anchor & ((1 << bits) - 1)
                on = (again[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                if not on.any():
                    continue
                row, first, last, anchor = row[on], first[on], last[on], anchor[on]
                text, start, end = words.normal()
                segment = [text[a:b] for a, b in zip(start[first], end[last + window - 1])]
                own = [*(c.take(pa.array(lo + row)) for c in keys), pa.array((first - words.row_start[row]).astype(np.int32)), pa.array(anchor)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(segment, pa.binary()).cast(pa.string())], ["doc_id", "h1", "h2", "first", "anchor", "segment"])

    return run


def _search(window: int):
    def run(table: pa.Table) -> pa.Table:
        coded = pc.split_pattern(table.column("segment").combine_chunks(), " ")
        ends = coded.offsets.to_numpy().astype(np.int64)
        symbols = coded.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
        del coded
        # segments one after the other, each followed by the separator
        n = len(table)
        text = np.zeros(len(symbols) + n, np.int64)
        text[np.arange(len(symbols)) + np.repeat(np.arange(n), np.diff(ends))] = symbols
        first = ends[:-1] - ends[0] + np.arange(n)
        windows = np.diff(ends) - window + 1
        mask = (np.uint64(1) << windows.astype(np.uint64)) - np.uint64(1)  # of segments that occur twice
        once = np.flatnonzero(table.column("n").to_numpy() == 1)
        if len(once):
            mask[once] = FMIndex(text, 2 * window).repeated_windows(first[once], first[once] + windows[once] - 1, window)
        on = mask != 0
        return pa.table({"s1": table.column("s1").filter(pa.array(on)), "s2": table.column("s2").filter(pa.array(on)), "mask": mask[on].view(np.int64)})

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2 (together they tell rows of different id or text apart) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *hashes("doc_id", "text"), "text")


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """h1, h2 (of rows with equal id and text) and ``found``: array of (first word, mask of the repeated windows from there on)."""
    spark = docs.sparkSession
    if window < 1:
        raise ValueError("a window has at least one word")
    k = max(1, window // 3, window - MASK_BITS + 1)
    texts = docs.select("text").where("length(text) > 0")
    anchors = texts.mapInArrow(_anchors(window, k), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    anchors = reliable(anchors.select("anchor"))
    bits = min(BITMAP, max(16, (8 * anchors.count()).bit_length()))
    slot = F.col("anchor").bitwiseAND(F.lit((1 << bits) - 1))
    by_word = anchors.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(anchor & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[by_word.column("word").to_numpy()] = by_word.column("bits").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap.tobytes())

    rows = _keyed(docs).where("length(text) > 0")
    segments = rows.mapInArrow(_segments(window, k, shared, bits), "doc_id long, h1 long, h2 long, first int, anchor long, segment string")
    own = lambda text: (F.xxhash64(text).alias("s1"), F.xxhash64(F.lit(window), text).alias("s2"))
    path = f"{shared_folder(spark)}/distinct-{uuid.uuid4().hex}"
    combined = segments.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("n"))
    combined.select("anchor", "segment", "n", *own("segment")).write.option("compression", "zstd").parquet(path)
    distinct = spark.read.parquet(path)
    n_blanks = F.length("segment") - F.length(F.translate("segment", " ", ""))
    per_anchor = distinct.groupBy("anchor").agg(F.sum(n_blanks + 1).alias("words"))
    busy = few(reliable(per_anchor.where(F.col("words") > ANCHOR_WORDS).select("anchor")))
    whole = distinct.join(busy, "anchor", "left_anti").select("anchor", "segment", "n", "s1", "s2")

    # the windows of busy anchors
    words = F.split("segment", " ")
    cut = distinct.join(busy, "anchor", "left_semi").select("s1", "s2", "n", words.alias("w"))
    cut = cut.select("s1", "s2", "n", "w", F.explode(F.sequence(F.lit(0), F.size("w") - window)).alias("i"))
    cut = cut.select(F.col("s1").alias("o1"), F.col("s2").alias("o2"), "i", "n", F.array_join(F.slice("w", F.col("i") + 1, window), " ").alias("segment"))
    cut = cut.select("o1", "o2", "i", "n", "segment", *own("segment"))
    again = reliable(cut.groupBy("s1").agg(F.sum("n").alias("n")).where("n > 1").select("s1"))
    single = cut.join(few(again), "s1", "left_semi").groupBy("s1", "s2", "segment").agg(F.sum("n").alias("n")).select(F.col("s1").alias("anchor"), "segment", "n", "s1", "s2")

    n_words = distinct.agg(F.sum(F.length("segment") / 6.0)).first()[0] or 0
    shards = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_words) // SHARD_WORDS + 1)
    usual = whole.unionByName(single).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    masks = usual.select("shard", "segment", "n", "s1", "s2").groupBy("shard").applyInArrow(_search(window), "s1 long, s2 long, mask long")
    if not busy.isEmpty():
        masks = reliable(masks)
        back = cut.select("s1", "s2", "o1", "o2", "i").join(masks, ["s1", "s2"]).groupBy(F.col("o1").alias("s1"), F.col("o2").alias("s2")).agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
        masks = masks.unionByName(back)

    places = segments.select("h1", "h2", "first", *own("segment")).join(masks, ["s1", "s2"]).select("h1", "h2", "first", "mask").distinct()
    return places.groupBy("h1", "h2").agg(F.collect_list(F.struct("first", "mask")).alias("found"))


def _kept(window: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            found = batch.column("found")
            spans = found.offsets.to_numpy().astype(np.int64)
            inner = found.values
            first, mask = (inner.field(c).to_numpy(zero_copy_only=False) for c in ("first", "mask"))
            n_words, n_removed, digest, kept = [], [], [], []
            begin, end, n_spans = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0]
            for k in range(batch.num_rows):
                words = data[offsets[k] : offsets[k + 1]].tobytes().split()
                n_words.append(len(words))
                lo, hi = spans[k], spans[k + 1]
                removed = 0
                n_spans.append(0)
                if hi > lo:
                    at, bit = np.nonzero(np.unpackbits(mask[lo:hi].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                    start = np.sort(first[lo:hi][at].astype(np.int64) + bit)
                    if texts:
                        breaks = np.flatnonzero(np.diff(start) > 1)
                        begin.append(start[np.concatenate([[0], breaks + 1])])
                        end.append(start[np.concatenate([breaks, [len(start) - 1]])] + window - 1)
                        n_spans[-1] = len(breaks) + 1
                    change = np.bincount(start, minlength=len(words) + 1) - np.bincount(start + window, minlength=len(words) + 1)
                    gone = np.cumsum(change)[: len(words)] > 0
                    removed = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                text = b" ".join(words)
                n_removed.append(removed)
                digest.append(hashlib.sha256(text).hexdigest())
                kept.append(text)
            made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            if texts:
                made.append(pa.array(kept, pa.binary()).cast(pa.string()))
                ends = pa.StructArray.from_arrays([pa.array(np.concatenate(begin)), pa.array(np.concatenate(end))], ["first", "last"])
                made.append(pa.ListArray.from_arrays(pa.array(np.cumsum(n_spans).astype(np.int32)), ends))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans"][: 1 + len(made)])

    return run


def remove_repeated(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if ``texts``, kept_text and spans of every document.

    kept_text: the kept words joined by one space.  spans: the longest stretches (first word, last word) all of whose windows are repeated, in order; they may overlap.
    """
    found = repeated(docs, window)
    rows = _keyed(docs).join(found, ["h1", "h2"], "left")
    rows = rows.select("doc_id", "text", F.coalesce("found", F.expr("cast(array() as array<struct<first:int,mask:bigint>>)")).alias("found"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string, spans array<struct<first:bigint,last:bigint>>" if texts else "")
    return rows.mapInArrow(_kept(window, texts), schema)
