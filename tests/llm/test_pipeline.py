"""The pipeline's stages, each against a brute-force version of its own step."""

import os
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from stratolog.llm import pieces, simhash  # noqa: E402

from .test_documents import brute_components, wide  # noqa: E402


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model file here")
def test_stages(spark, docs, rows, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "SimHash near-dedup", "secret scans", "mixing sources", "SentencePiece"]
    made, out = docs, {}
    for name, stage in stages.items():
        path = str(tmp_path / name.replace(" ", "_"))
        stage(spark, made, "").write.parquet(path)
        made = out[name] = spark.read.parquet(path)
        if name != "SentencePiece":
            assert made.columns == docs.columns
    letters = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert Counter(r.doc_id for r in out["language ID"].collect()) == Counter(r[0] for r in letters)
    roots = brute_components([(k, wide(r[1])) for k, r in enumerate(letters)], simhash.radius_for(0.8, 4))
    least = {}
    for r, root in zip(letters, roots):
        least[root] = min(least.get(root, (True, 0)), (r[0] is None, r[0] or 0))
    assert Counter(r.doc_id for r in out["SimHash near-dedup"].collect()) == Counter(None if none else i for none, i in least.values())
    secret = "0123456789abcdef" * 2 + "01234567"
    assert out["secret scans"].count() == out["SimHash near-dedup"].count()
    assert not [r for r in out["secret scans"].collect() if f'token = "{secret}' in r.text]
    before, after = Counter(r.doc_id for r in out["secret scans"].collect()), Counter(r.doc_id for r in out["mixing sources"].collect())
    assert all(0 < n <= 2 * before[i] for i, n in after.items())
    assert Counter(r.doc_id for r in out["SentencePiece"].collect()) == after


@pytest.mark.parametrize("before, after", [("64m", corpus_pipeline.BATCH), ("16777216", corpus_pipeline.BATCH), ("1m", 1 << 20)])
def test_batches_are_small(spark, empty, before, after):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    kept = spark.conf.get(name)
    try:
        spark.conf.set(name, before)
        corpus_pipeline.language_id(spark, empty, "")
        assert spark.conf.get(name) in (str(after), before) and (spark.conf.get(name) == before) == (before == "1m")
    finally:
        spark.conf.set(name, kept)


def test_stages_of_an_empty_table(spark, empty):
    made = empty
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, made, "")
        assert made.count() == 0 and made.columns == empty.columns
