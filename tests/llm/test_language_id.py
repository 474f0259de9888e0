import zlib

import numpy as np

from capquill.llm import language_id as L
from tests.llm.cases import SF, awkward, documents


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in documents(spark).select("doc_id", "lang").collect()}
    rows = L.op9_language_id(spark, SF).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in tested) >= 0.97 * len(tested)
    assert sum(r.accepted for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_rows(spark):
    model = L.learn(L.training_rows(documents(spark)))
    df = awkward(spark).withColumnRenamed("hash", "score")
    rows = L.identify(df, model).collect()
    assert len(rows) == df.count() and rows[0].asDict().keys() == {*df.columns, "lang_pred", "accepted"}
    for r in rows:
        bare = not any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == bare and (not bare or (r.score == 0 and not r.accepted))


def test_nothing_to_learn_from(spark):
    df = awkward(spark)
    model = L.learn(L.training_rows(df))
    assert {r.lang_pred for r in L.identify(df, model).collect()} == {"und"}
    assert L.identify(df.limit(0), model).count() == 0


def test_other_columns_stay_as_they_are(spark):
    model = L.learn(L.training_rows(documents(spark)))
    df = documents(spark).withColumnRenamed("n_chars", "score")
    kept = L.accepted(df, model)
    assert kept.columns == df.columns
    want = {r.doc_id: r.score for r in df.collect()}
    assert all(want[r.doc_id] == r.score for r in kept.collect())


def test_scores_do_not_depend_on_neighbours(spark):
    model = L.learn(L.training_rows(documents(spark)))
    texts = [r.text.encode() for r in documents(spark).limit(40).collect()] + [b""]
    whole = b"".join(texts)
    off = np.cumsum([0, *map(len, texts)])
    z, _ = model.logits(np.frombuffer(whole, np.uint8), off)
    for i, t in enumerate(texts):
        one, _ = model.logits(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert (one[0] == z[i]).all()
        grams = [x for b, _ in L.subwords(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for x in b.tolist()]
        assert np.allclose(one[0], sum((model.scores[g].astype(float) for g in grams), np.zeros(len(model.languages))) / max(len(grams), 1) + model.bias)


def test_every_language_is_learned(spark):
    """70 languages, one of them with long texts only."""
    word = lambda k, j: "".join(chr(97 + (k * 7 + j * 5 + i * (k % 11 + 1)) % 26) for i in range(5))
    rows = [(70 * n + k, " ".join(word(k, j % 9) for j in range(n, n + (5000 if k == 3 else 40))), f"l{k:02}") for k in range(70) for n in range(8)]
    picked = L.training_rows(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert {lang for lang, _ in picked} == {f"l{k:02}" for k in range(70)}
