"""SentencePiece: parity with the library, and a unigram model written by hand."""

import os
import struct

import pyarrow as pa
import pyarrow.compute as pc
import pytest
import sentencepiece

from stratolog.llm import pieces


def proto(model, **normaliser):
    """The bytes of a model: pieces as (text, score, kind), and settings."""

    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    def field(k, value):
        if isinstance(value, bytes):
            return varint(k << 3 | 2) + varint(len(value)) + value
        if isinstance(value, float):
            return varint(k << 3 | 5) + struct.pack("<f", value)
        return varint(k << 3) + varint(value)

    body = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, k)) for p, s, k in model)
    body += field(2, field(3, 1) + field(35, 1))
    return body + field(3, field(1, b"identity") + field(3, normaliser.get("prefix", 1)) + field(4, normaliser.get("squeeze", 0)) + field(5, 1))


def unigram(**normaliser):
    base = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{b:02X}>", -12.0, 6) for b in range(256))]
    words = ["▁", "▁the", "▁th", "e", "▁cat", "▁c", "at", "a", "t", "s", "▁sat", "he", "h", "c", "▁on", "o", "n"]
    return proto([*base, *((w, -1.0 - 0.37 * k, 1) for k, w in enumerate(words))], **normaliser)


TEXTS = ["the cat sat on the cat", "the  cat ", "", " ", "thé ç 𝒳", "cats\nthe", "xyz cat"]


@pytest.mark.parametrize("how", [{}, {"squeeze": 1}, {"prefix": 0}])
def test_unigram_parity(how):
    raw = unigram(**how)
    model = pieces.Model(raw)
    theirs = sentencepiece.SentencePieceProcessor(model_proto=raw)
    flat, ends, same = model.encode(TEXTS, most=3)
    ids = [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]
    assert not model.is_bpe and model.byte_fallback
    assert ids == theirs.encode(TEXTS) and same.all()
    if not how.get("squeeze"):
        assert model.decode(ids) == TEXTS


needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model file here")


@needs_model
def test_tokenize(spark, docs, rows, empty):
    theirs = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.tokenize(docs, carry=("doc_id", "source")).cache()
    expected = sorted(((i, s, theirs.encode(t or "")) for i, t, _, s in rows), key=repr)
    assert sorted(((r.doc_id, r.source, list(r.ids)) for r in got.collect()), key=repr) == expected
    assert all(r.parity and r.n_tokens == len(r.ids) for r in got.collect())
    marked = {i for i, t, *_ in rows if "▁" in (t or "")}
    assert {r.doc_id for r in got.collect() if not r.round_trip} == marked
    back = pieces.detokenize(got, carry=("doc_id",))
    plain = sorted(((i, (t or "").replace("▁", " ")) for i, t, *_ in rows), key=repr)
    assert sorted((tuple(r) for r in back.collect()), key=repr) == plain
    assert pieces.tokenize(empty).count() == 0


def test_words_of_a_long_column_are_held_part_by_part(monkeypatch):
    with open(pieces.MODEL, "rb") as file:
        model = pieces.load(file.read())
    texts = [None, "", "the cat sat on the mat " * 300, f"a{pieces.MARK}b", "two  blanks", "x" * 9000, *(f"row {k} of many words" * (k % 7) for k in range(900))]
    column, sizes, split = pa.array(texts, pa.string()), [], pc.split_pattern
    monkeypatch.setattr(pieces, "PART", 4096, raising=False)
    monkeypatch.setattr(pieces.pc, "split_pattern", lambda text, *a: sizes.append((sum(len(x.as_py().encode()) for x in text), len(text))) or split(text, *a))
    rows = lambda made: [(out[a:b].tolist(), bool(p), bool(t)) for out, ends, same, trip in made for a, b, p, t in zip(ends, ends[1:], same, trip)]
    got = rows(pieces.encode_column(model, column))
    assert all(size <= 4096 or n == 1 for size, n in sizes)
    assert [ids for ids, *_ in got] == model.processor.encode([x or "" for x in texts])
    assert all(p for _, p, _ in got) and len(got) == len(texts)
