import re
import zlib
from collections import Counter

from millrace.llm import langid, quality
from millrace.llm.common import table
from millrace.llm.queries import QUERIES

from .fixtures import awkward, empty, with_clashes


def test_held_out_accuracy(spark, sf01):
    truth = {r.doc_id: (r.lang, r.text) for r in table(spark, sf01, "documents").collect()}
    rows = QUERIES["op1_language_id"](spark, sf01).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    right = [r.lang_pred == truth[r.doc_id][0] for r in held if re.search(r"\w", truth[r.doc_id][1] or "")]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, sf):
    docs = table(spark, sf, "documents")
    models = langid.train(docs)
    a = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(awkward(spark), models).collect()}
    b = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(with_clashes(awkward(spark)), models).collect()}
    assert a == b
    by = {d: x for d, x, _ in a}
    assert by[3] == by[4] == by[5] == by[-9] == "und"
    assert langid.identify(empty(spark), models).count() == 0
    assert {r.lang_pred for r in langid.identify(awkward(spark), langid.train(empty(spark))).collect()} == {"und"}


def test_kneser_ney_sums_to_one(spark, sf):
    """The interpolated probabilities of all symbols after a context add up to one, less what the uniform part keeps for unseen ones."""
    import numpy as np

    models = langid.train(table(spark, sf, "documents"))
    ids, scored, _ = langid._symbols(["the that and"])
    g = langid._grams(ids)[scored][5:6]
    symbols = np.unique(np.r_[np.arange(97, 123), 32, np.arange(0xC0, 0x250)]).astype(np.uint64)
    same = (g >> np.uint64(12) << np.uint64(12)) | symbols
    total = np.exp(models.log_probabilities(same)).sum(0)
    assert (total < 1.6).all() and (total > 0.9).all()


def rules_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    chars = sum(map(len, w))
    n, sym, dup, rep = len(w), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
    failed = n < 50 or 100 * rep > 50 * n
    up, low, marks = (len(re.findall(p, text or "")) for p in ("[A-Z]", "[a-z]", "[!?]"))
    bad = 100 * sym > 5 * chars or (len(lines) >= 4 and 100 * dup > 40 * len(lines)) or chars > 12 * n or chars < 2 * n or (up >= 20 and up > low) or 100 * marks > 10 * chars
    return n, chars, sym, dup, rep, failed, not (failed or bad)


def test_quality_against_plain_code(spark, sf):
    for docs in (table(spark, sf, "documents"), awkward(spark), with_clashes(awkward(spark))):
        texts = Counter((r.doc_id, *rules_of(r.text)) for r in docs.select("doc_id", "text").collect())
        assert Counter(map(tuple, quality.measured(docs).collect())) == texts
    assert quality.measured(empty(spark)).count() == quality.keep_good(empty(spark)).count() == 0


def test_order_changes_no_verdict(spark, sf):
    docs = table(spark, sf, "documents")
    good = {r.doc_id for r in docs.collect() if rules_of(r.text)[-1]}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == good
    order = quality.order_rules(docs, quality.BASE + quality.RULES)
    assert {r.name for r in order} == {r.name for r in quality.BASE + quality.RULES}


def test_rare_languages_reject_too(spark, sf01):
    import random

    r = random.Random(1)
    noise = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)) for n in (20, 40, 100, 300)]
    docs = [x for x in table(spark, sf01, "documents").orderBy("doc_id").collect() if x.lang and len(x.text or "") > 30]
    for size in (3, 30):
        own = {lang: [x for x in docs if x.lang == lang] for lang in ("fr", "es")}
        models = langid.train(spark.createDataFrame([(x.doc_id, x.text, x.lang) for v in own.values() for x in v[:size]], "doc_id long, text string, lang string"))
        assert models.langs == ["es", "fr"]
        assert all(x[2] for x in models.predict(noise))
        kept = [not x[2] for x in models.predict([x.text for v in own.values() for x in v[size:]])]
        assert sum(kept) / len(kept) > 0.99


def test_cascade_takes_what_earlier_rules_leave():
    # rule 0 rejects what rule 1 rejects and no more; rule 2 few others, cheaply
    assert quality.cascade({0b011: 50, 0b010: 20, 0b100: 10, 0: 20}, [1.0, 1.0, 0.5]) == [1, 2, 0]
    assert quality.cascade({0: 5}, [3.0, 1.0, 2.0]) == [1, 2, 0]
    assert quality._shared(list(quality.BASE + quality.RULES)) == ["n_words", "word_chars"]


def test_stages_on_awkward_rows(spark, sf):
    docs = with_clashes(awkward(spark))
    models = langid.train(table(spark, sf, "documents"))
    kept = langid.keep_identified(docs, models)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    texts = [r.text for r in kept.collect()]
    assert None not in texts and "" not in texts and "!!! ### $$$ %%%" not in texts
    assert langid.keep_identified(empty(spark), models).count() == 0
    good = quality.keep_good(docs)
    assert good.columns == docs.columns
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in docs.collect() if rules_of(r.text)[-1])


def kneser_ney(texts, context, symbol, alphabet):
    """Interpolated probability by dictionaries, from the definition."""
    order = langid.ORDER
    streams = []
    for t in texts:
        ids, scored, _ = langid._symbols([t])
        streams.append((ids.tolist(), scored.tolist()))
    counts = Counter()
    for ids, scored in streams:
        for i in range(len(ids)):
            if scored[i]:
                counts[tuple([0] * max(0, order - 1 - i) + ids[max(0, i - order + 1) : i + 1])] += 1
    by_order = {order: counts}
    for k in range(order - 1, 0, -1):
        by_order[k] = Counter(g[1:] for g in by_order[k + 1])
    p = 1 / (alphabet + 1)
    for k in range(1, order + 1):
        c = by_order[k]
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
        ctx = tuple(context[len(context) - k + 1 :]) if k > 1 else ()
        own = {g: v for g, v in c.items() if g[:-1] == ctx}
        if own:
            total = sum(own.values())
            p = max(own.get((*ctx, symbol), 0) - d, 0) / total + d * len(own) / total * p
    return p


def test_models_against_the_definition():
    import numpy as np

    corpora = {"a": ["the cat sat on the mat", "the dog", "a cat that sat"], "b": ["der hund sah die katze", "das ist der hund"], "c": ["\u6f22\u5b57\u6f22", "\u0ba4\u0bae\u0bbf\u0bb4\u0bcd \u6f22"]}
    counts = {}
    for lang, texts in corpora.items():
        ids, scored, _ = langid._symbols(texts)
        g, c = np.unique(langid._grams(ids)[scored], return_counts=True)
        counts[lang] = (g, c.astype(float))
    models = langid.Models.fit(counts)
    alphabet = round(1 / models.uniform) - 1
    for text in ("the cat", "hund that", "\u6f22\u5b57 katze", "zzz"):
        ids, scored, _ = langid._symbols([text])
        got = np.exp(models.log_probabilities(langid._grams(ids)[scored]))
        places = [i for i, x in enumerate(scored.tolist()) if x]
        for j, lang in enumerate(models.langs):
            for row, i in zip(got[:, j], places, strict=True):
                context = ([0] * langid.ORDER + ids[:i].tolist())[-(langid.ORDER - 1) :]
                assert abs(row - kneser_ney(corpora[lang], context, int(ids[i]), alphabet)) < 1e-5
    # over all symbols and one unseen, the probabilities after any context add up to one
    symbols = np.unique(np.concatenate([langid._low(g, 1) for g, _ in counts.values()]))
    assert len(symbols) == alphabet
    g = langid._grams(langid._symbols(["the cat"])[0])[-3:-2]
    total = np.exp(models.log_probabilities((g >> np.uint64(12) << np.uint64(12)) | np.r_[symbols, np.uint64(4000)])).sum(0)
    assert np.allclose(total, 1, atol=1e-5)


def test_wide_letters_are_told_apart():
    a, b = (langid._symbols([chr(c)])[0].tolist() for c in (0x4E00, 0x4E00 + 1536))
    assert a != b and len(a) == langid.ORDER - 1 + 3


def test_three_hundred_languages(spark):
    import random

    r = random.Random(6)
    rows = []
    for k in range(300):
        letters = [chr(0x4E00 + 60 * k + i) for i in range(40)]
        for i in range(12):
            rows.append((len(rows), " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(12)), f"l{k:03d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.train(docs)).collect()
    truth = {d: lang for d, _, lang in rows}
    assert len({x.lang_pred for x in got}) == 300
    held = [x for x in got if x.held_out]
    assert sum(x.lang_pred == truth[x.doc_id] for x in held) / len(held) > 0.97
