"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed here (pieces, scores, kinds, trainer and normaliser settings).  From it a tokenizers pipeline is rebuilt: normaliser,
the marker for blanks (metaspace), byte fallback, and unigram scores or the merges that a BPE model's scores stand for.

In models that keep blanks, no piece has the marker behind another character, so a text's ids are those of its words put together.  Each batch encodes
its distinct words once (``encode_batch``, multithreaded), verifies each against the sentencepiece library, and lays the ids out with numpy.  Texts with
blanks beside each other or with the marker itself, and all texts under any other model, are encoded whole and verified whole.  Decoding puts the
pieces' bytes together, with numpy as well.

Null and empty texts have no ids and decode to the empty text.  A text that holds the marker character itself decodes with blanks in its place, and
``round_trip`` says so.  Long texts are encoded whole.  Rows are independent; repeated rows give equal rows, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import blocks, utf8

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose words are held at a time.
PART = 4 << 20
#: Kinds of pieces, fixed values of the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(wire) or varint()
        yield key >> 3, message[at : at + size]
        at += size


class Model:
    """What the protobuf says, the rebuilt tokenizer, and the library's own processor to verify against."""

    def __init__(self, proto: bytes):
        import sentencepiece
        from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normaliser: dict = {}
        for field, value in _fields(proto):
            if field == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        self.vocabulary = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        self.is_bpe, self.byte_fallback = trainer.get(3, 1) == 2, bool(trainer.get(35, 0))
        if trainer.get(3, 1) not in (1, 2):
            raise ValueError("only unigram and BPE models are rebuilt")
        self.prefix, self.squeeze, charsmap = normaliser.get(3, 1), normaliser.get(4, 1), normaliser.get(2, b"")
        unknown = next((p for p, _, kind in self.pieces if kind == UNKNOWN), None)
        if self.is_bpe:
            model = models.BPE(self.vocabulary, self._merges(), unk_token=unknown, fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.vocabulary.get(unknown), self.byte_fallback)
        self.tokenizer = Tokenizer(model)
        steps = [normalizers.Precompiled(charsmap)] if charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        steps += [normalizers.Prepend(MARK)] * bool(self.prefix) + [normalizers.Replace(" ", MARK)]
        self.tokenizer.normalizer = normalizers.Sequence(steps)
        inner = any(MARK in p.lstrip(MARK) for p, _, _ in self.pieces)
        if not inner:
            self.tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
        #: whether a text's ids are those of its words
        self.by_word = self.is_bpe and not inner and not charsmap and not self.squeeze and bool(self.prefix)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=proto)
        raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.piece_size = np.array([len(r) for r in raw], np.int64)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size

    def _merges(self) -> list[tuple[str, str]]:
        ids = self.vocabulary
        found = []
        for i, (piece, score, kind) in enumerate(self.pieces):
            if kind in (NORMAL, USER_DEFINED):
                halves = ((piece[:k], piece[k:]) for k in range(1, len(piece)))
                found += [(-score, i, ids[a], a, b) for a, b in halves if a in ids and b in ids]
        return [(a, b) for *_, a, b in sorted(found)]

    def encode(self, texts: list[str], most: int = 4_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the offsets of each text's, and whether the sentencepiece library gives the same; ``most`` texts at a time."""
        ids, sizes, same = [np.zeros(0, np.int32)], [0], []
        for at in range(0, len(texts), most):
            some = texts[at : at + most]
            own = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            same += [a == b for a, b in zip(own, self.processor.encode(some, num_threads=1))]
            sizes += map(len, own)
            ids.append(np.fromiter((i for x in own for i in x), np.int32))
        return np.concatenate(ids), np.cumsum(sizes), np.array(same, bool)

    def decode_bytes(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decoded bytes of rows of ids (``ends``: n + 1 offsets) and their offsets; the dummy blank in front is still there."""
        size = self.piece_size[ids]
        after = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(after[-1]) + np.repeat(self.piece_at[ids] - after[:-1], size)
        return self.piece_bytes[take], after[ends]

    def decode(self, rows: list[list[int]]) -> list[str]:
        ends = np.cumsum([0, *map(len, rows)])
        data, at = self.decode_bytes(np.array([i for r in rows for i in r], np.int64), ends)
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at, at[1:])]
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in texts]


@lru_cache(2)
def load(proto: bytes) -> Model:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", "2")
    return Model(proto)


def encode_column(model: Model, column: pa.Array, most_bytes: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of rows: ids, their offsets, parity and round trip of each row.

    The words of ``most_bytes`` (``PART``) of text are held at a time, however long the column is; its distinct words are encoded once.
    """
    parts = list(blocks(utf8(column)[1], most_bytes or PART, max(1, len(column))))
    words, coded = None, None
    if model.by_word:
        found = [pc.unique(_words(column.slice(lo, hi - lo)).flatten()) for lo, hi in parts]
        words = pc.unique(pa.chunked_array(found, pa.large_string()))
        coded = model.encode(words.to_pylist())
    for lo, hi in parts:
        yield from _encode_part(model, column.slice(lo, hi - lo), words, coded)


def _words(column: pa.Array) -> pa.Array:
    return pc.split_pattern(pc.fill_null(column, "").cast(pa.large_string()), " ")


def _encode_part(model: Model, column: pa.Array, words: pa.Array | None, coded: tuple | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    text = pc.fill_null(column, "").cast(pa.large_string())
    data, offsets = utf8(text)
    n = len(text)
    if words is not None:
        mark = pc.match_substring(text, MARK).to_numpy(zero_copy_only=False)
        split = _words(column)
        index = pc.index_in(split.flatten(), value_set=words).to_numpy()
        word_ends = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        del split
        flat, ends, same = coded
        empty = pc.equal(words, "").to_numpy(zero_copy_only=False)
        gaps = np.concatenate([[0], np.cumsum(empty[index])])
        whole = mark | (gaps[word_ends[1:]] > gaps[word_ends[:-1]])
    else:
        whole = np.ones(n, bool)
    for lo, hi in blocks(offsets, 2 << 20):
        if whole[lo:hi].any():
            rows = [k for k in range(lo, hi) if whole[k]]
            own, own_ends, parity = model.encode([text[k].as_py() for k in rows])
            special = {k: (own[a:b], bool(p)) for k, a, b, p in zip(rows, own_ends, own_ends[1:], parity)}
        else:
            special = {}
        parts, equal = [], np.ones(hi - lo, bool)
        if not special:
            at = index[word_ends[lo] : word_ends[hi]]
            size = ends[at + 1] - ends[at]
            after = np.concatenate([[0], np.cumsum(size)])
            out = flat[np.arange(after[-1]) + np.repeat(ends[at] - after[:-1], size)]
            out_ends = after[word_ends[lo : hi + 1] - word_ends[lo]]
            wrong = np.concatenate([[0], np.cumsum(~same[at])])
            equal = wrong[word_ends[lo + 1 : hi + 1] - word_ends[lo]] == wrong[word_ends[lo:hi] - word_ends[lo]]
        else:
            for k in range(lo, hi):
                if k in special:
                    own, equal[k - lo] = special[k]
                else:
                    at = index[word_ends[k] : word_ends[k + 1]]
                    own, equal[k - lo] = np.concatenate([flat[ends[w] : ends[w + 1]] for w in at]), bool(same[at].all())
                parts.append(own)
            out = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            out_ends = np.cumsum([0, *map(len, parts)])
        back, back_ends = model.decode_bytes(out, out_ends)
        lead = 1 if model.prefix else 0
        trip = np.array([np.array_equal(back[back_ends[k - lo] + lead * (offsets[k] < offsets[k + 1]) : back_ends[k - lo + 1]], data[offsets[k] : offsets[k + 1]]) for k in range(lo, hi)], bool)
        yield out, out_ends, equal, trip


def tokenize(docs: DataFrame, model_path: str = MODEL, carry: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """``carry``, n_tokens, ids_sha256 (of the ids as little-endian 32-bit), parity, round_trip and, if wanted, ids.

    The model file is read on the driver and travels with the tasks.
    """
    with open(model_path, "rb") as file:
        proto = file.read()
    rows = docs.select(*dict.fromkeys([*carry, "text"]))
    schema = docs.select(*carry).schema
    for name, kind in (("n_tokens", "long"), ("ids_sha256", "string"), ("parity", "boolean"), ("round_trip", "boolean"), *((("ids", T.ArrayType(T.IntegerType())),) if ids else ())):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(proto)
        for batch in batches:
            at = 0
            for out, ends, parity, trip in encode_column(model, batch.column("text")):
                n = len(parity)
                digest = [hashlib.sha256(out[a:b].astype("<i4").tobytes()).hexdigest() for a, b in zip(ends, ends[1:])]
                made = [pa.array(np.diff(ends)), pa.array(digest, pa.string()), pa.array(parity), pa.array(trip)]
                if ids:
                    made.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, n) for c in carry), *made], schema.names)
                at += n

    return rows.mapInArrow(run, schema)


def detokenize(rows: DataFrame, model_path: str = MODEL, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` and text, decoded from the column ``ids`` (null ids: empty text)."""
    with open(model_path, "rb") as file:
        proto = file.read()
    schema = rows.select(*carry).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(proto)
        for batch in batches:
            texts = model.decode([x or [] for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([*map(batch.column, carry), pa.array(texts, pa.string())], schema.names)

    return rows.select(*dict.fromkeys([*carry, "ids"])).mapInArrow(run, schema)
