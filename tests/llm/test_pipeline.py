import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from millrace.llm import langid, neardup  # noqa: E402
from millrace.llm.common import table  # noqa: E402

from .test_language_and_quality import rules_of  # noqa: E402
from .test_neardup import brute  # noqa: E402
from .test_packing import check  # noqa: E402
from .test_spans import secrets_of  # noqa: E402


def test_stages_against_plain_code(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    models = langid.train(docs)
    rows = {r.doc_id: r for r in docs.collect()}
    keep = [d for d, p in zip(rows, models.predict([r.text or "" for r in rows.values()]), strict=True) if not p[2]]
    assert len(keep) >= 0.9 * len(rows)
    keep = [d for d in keep if rules_of(rows[d].text)[-1]]
    keep = sorted(d for d, _, c in brute([(d, rows[d].text) for d in keep], neardup.SHINGLE) if d == c)
    stages = dict(corpus_pipeline.STAGES)
    for name in list(stages)[:-1]:
        docs = stages[name](spark, docs, sf)
        assert docs.columns == columns
    out = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(out) == keep
    for d, text in out.items():
        if not secrets_of(rows[d].text):
            assert text == rows[d].text or "[SECRET]" in text
        assert not secrets_of(text)
    sizes = {d: len(t.split()) for d, t in out.items()}
    check(corpus_pipeline.run(spark, sf).collect(), sizes)
