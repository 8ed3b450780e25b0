"""Classifiers: each text's answer is its own, equals a plain version, and is right on rows kept out of training."""

import zlib

import numpy as np
import pytest

from leafmark.llm import grams, language_id, quality

TEXTS = ["The cat.", "le chat 12 %", "", "x", "Ünï  cödé \U0001f600 ok", "\U0001f600", "der Hund und die Katze, ein Tag", "a" * 50, "the same words " * 300, "\n"]
LEARNED = language_id.train(["the cat and dog"] * 30 + ["le chat et chien"] * 30, ["en"] * 30 + ["fr"] * 30)


def plain_language(model, text):
    """Probabilities by counting the n-grams of one text."""
    if not any(map(str.isalpha, text)):
        return None
    cp = grams.letters_only(grams.points(text.lower() + "  "))
    rows = [model.table[b[: len(text.lower())]].astype(float) for b in grams.gram_buckets(cp, language_id.ORDERS, language_id.BUCKETS)]
    z = (np.concatenate(rows).mean(0) + model.bias) / model.temperature + model.prior
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def test_languages_of_a_text_are_its_own(monkeypatch):
    alone = [language_id.predict(LEARNED, [t]) for t in TEXTS]
    for order in (range(len(TEXTS)), reversed(range(len(TEXTS))), np.random.default_rng(1).permutation(len(TEXTS))):
        order = list(order)
        langs, scores = language_id.predict(LEARNED, [TEXTS[i] for i in order])
        assert langs == [alone[i][0][0] for i in order] and np.allclose(scores, [alone[i][1][0] for i in order], atol=1e-9)
    for t, (lang, score) in zip(TEXTS, alone):
        p = plain_language(LEARNED, t)
        assert (lang, score[0]) == (["und"], 0.0) if p is None else np.isclose(score[0], p.max(), atol=1e-6) and lang == [LEARNED.languages[p.argmax()]]
    monkeypatch.setattr(grams, "CHUNK_CHARS", 7)
    monkeypatch.setattr(grams.chunks, "__defaults__", (7,))
    cut = language_id.predict(LEARNED, TEXTS)
    assert cut[0] == [a[0][0] for a in alone] and np.allclose(cut[1], [a[1][0] for a in alone], atol=1e-6)


def test_symbols_beyond_the_basic_plane_are_no_letters():
    assert language_id.predict(LEARNED, ["\U0001f600", "\U0001d173 12", "\U00020000"])[0][:2] == ["und", "und"]
    assert language_id.predict(LEARNED, ["\U00020000"])[0] != ["und"]


def test_temperature_stays_off_its_floor_without_errors():
    assert LEARNED.temperature > 2 * language_id.COLDEST
    assert language_id.predict(LEARNED, ["the cat and dog"])[1][0] < 1.0


def test_rare_languages_are_learned(spark):
    words = {"en": "the cat and dog", "fr": "le chat et chien", "xx": "qoz zuq ozq"}
    rows = [(i, words["en" if i % 2 else "fr"] if i >= 12 else words["xx"], ("en" if i % 2 else "fr") if i >= 12 else "xx") for i in range(4000)]
    model = language_id.train_on(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr", "xx"] and language_id.predict(model, ["qoz zuq"])[0] == ["xx"]


def test_grades_of_a_text_are_its_own(monkeypatch):
    model = quality.train(["aa bb"] * 20 + ["!! ??"] * 20 + ["cc dd"] * 20, [1] * 20 + [0] * 20 + [2] * 20)
    alone = np.array([np.ravel(quality.grade(model, [t])) for t in TEXTS])
    assert np.allclose(np.array(quality.grade(model, TEXTS)).T, alone, atol=1e-9) and np.allclose(np.array(quality.grade(model, TEXTS[::-1])).T, alone[::-1], atol=1e-9)
    for t, (expected, tail) in zip(TEXTS, alone):
        cp = quality._folded(grams.points(t + "  "))
        got = [model.weights[b[: len(t)]] for b in grams.gram_buckets(cp, quality.ORDERS, quality.BUCKETS)]
        words = t.split()
        got += [model.weights[[quality.SAME if i and w == words[i - 1] else quality.NEW] * quality.WORD_WEIGHT] for i, w in enumerate(words)]
        if t:
            below = 1 / (1 + np.exp(np.concatenate(got).mean() - model.thresholds))
            assert np.isclose(tail, 1 - below[0], atol=1e-9) and np.isclose(expected, np.diff([0, *below, 1]) @ [0, 1, 2], atol=1e-9)
        else:
            assert (expected, tail) == (0, 0)
    long = "aa bb !! cc dd " * 300
    whole = np.ravel(quality.grade(model, [long]))
    monkeypatch.setattr(grams.chunks, "__defaults__", (901,))
    assert np.allclose(np.ravel(quality.grade(model, [long])), whole, atol=1e-3)


def test_quality_on_ratings_kept_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rated = quality.ratings(labels)
    kept_out = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"
    model = quality.train_on(docs, rated.filter(f"not ({kept_out})"))
    rows = docs.join(rated.filter(kept_out), "doc_id").select("text", "grade").collect()
    tails = quality.grade(model, [r.text or "" for r in rows])[1]
    good = np.array([r.grade > 0 for r in rows])
    assert len(rows) > 500 and (tails[good] >= 0.5).mean() > 0.97 and (tails[~good] >= 0.5).mean() < 0.05


def test_language_of_held_out_documents_and_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train_on(docs)
    rows = [r for r in docs.collect() if r.text and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    langs, scores = language_id.predict(model, [r.text for r in rows])
    assert np.mean([a == r.lang for a, r in zip(langs, rows) if r.lang]) > 0.97 and scores.max() <= 1
    for r, lang, score in list(zip(rows, langs, scores))[:40]:
        p = plain_language(model, r.text)
        assert p is None and lang == "und" or np.isclose(score, p.max(), atol=1e-5)


@pytest.mark.parametrize("stage", ["language", "quality"])
def test_odd_tables(spark, stage):
    """Empty tables, nulls, repeated rows and columns with the names that the operators add."""
    docs = spark.createDataFrame([(1, None, "en", 1.0), (1, "the cat", None, 2.0), (1, "the cat", None, 2.0), (None, "", "fr", None)], "doc_id long, text string, lang string, lang_score double")
    if stage == "language":
        assert language_id.train_on(docs.limit(0)) is None
        assert language_id.identify_languages(docs, None, score="s").count() == 4 and language_id.identify_languages(docs.limit(0), LEARNED).count() == 0
        got = language_id.identify_languages(docs, LEARNED, score="s").filter("doc_id = 1 and text is not null").collect()
        assert got[0] == got[1] and got[0].lang_score == 2.0
        kept = language_id.keep_identified(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("*", "doc_id as lang_pred", "7 as lang_score"), "")
        assert kept.count() > 100 and kept.filter("lang_score <> 7 or lang_pred <> doc_id").count() == 0
    else:
        rated = spark.createDataFrame([(1, 1), (1, 0), (2, None)], "doc_id long, grade int")
        assert quality.train_on(docs, rated) is None and quality.grade_documents(docs, None).filter("selected").count() == 0
        assert quality.grade_documents(docs.limit(0), None).count() == 0


def test_toxicity_of_held_out_documents(spark):
    """A tenth of the toxic labels stand on texts of repeated words or of marks, as a tenth of such texts have one: no
    reading of those tells them from the others, so full recall isn't to be had."""
    from leafmark.llm import toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train_on(docs, labels)
    rows = docs.join(labels.filter("toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), "doc_id").select("text", "toxic").collect()
    found, toxic = model.scores([r.text or "" for r in rows]) >= 0.5, np.array([r.toxic == 1 for r in rows])
    assert toxic.sum() > 50 and found[toxic].mean() > 0.8 and found[~toxic].mean() < 0.01


def test_toxicity_of_a_text_is_its_own_and_odd_tables(spark):
    from leafmark.llm import toxicity

    good, bad = ["the fine day went on well " * 8] * 60, ["the fine day idiot went on " * 8] * 60
    model = toxicity.train(good + bad, [0] * 60 + [1] * 60, [1.0] * 120)
    texts = [*TEXTS, "idiot " * 50, "a fine idiot"]
    alone = [model.scores([t])[0] for t in texts]
    assert np.allclose(model.scores(texts), alone, atol=1e-5) and np.allclose(model.scores(texts[::-1]), alone[::-1], atol=1e-5)
    docs = spark.createDataFrame([(1, None, 1.5), (1, "a fine idiot", 1.5), (None, "", None)], "doc_id long, text string, toxic_score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train_on(docs, none) is None and toxicity.train_on(docs.limit(0), none) is None
    got = toxicity.score_toxicity(docs, model, score="s").collect()
    assert len(got) == 3 and got[0].toxic_score == 1.5 and toxicity.score_toxicity(docs.limit(0), model).count() == 0
    assert {r.s for r in toxicity.score_toxicity(docs, None, score="s").collect()} == {0.0}


def test_toxicity_of_whole_texts_equals_a_plain_version():
    """Words by a regular expression, each window alone through a plain recurrent network, all windows of the whole text."""
    import re

    from leafmark.llm import toxicity

    def words_of(text):
        return re.findall(r"[^\W_]+(?:[^\s\w]{1,2}[^\W_]+)*", text.lower())

    assert words_of("F*ck, 1d10t! don't -- a--b c---d") == ["f*ck", "1d10t", "don't", "a--b", "c", "d"]
    good, bad = ["what a fine day for a walk"] * 60, ["you stupid worthless idiot"] * 60
    model = toxicity.train(good + bad, [0] * 60 + [1] * 60, [1.0] * 120)
    net, p, h = model.network, model.network.p, toxicity.HIDDEN
    of_word = {}

    def vector(w):
        if w not in of_word:
            own, ids, _ = toxicity.word_inputs([w])
            assert len(own) == 1 and ids.tolist() == [0]
            of_word[w] = net.vectors(own)[1]
        return of_word[w]

    def logit(window):
        x = [vector(w) for w in window] + [np.zeros(toxicity.WORD_DIM + toxicity.CHAR_DIM, np.float32)] * (toxicity.WINDOW - len(window))
        states = np.zeros((len(x), 2 * h))
        for side in (0, 1):
            s = np.zeros(h)
            for t in range(len(x)) if side == 0 else reversed(range(len(x))):
                a = x[t] @ p["in"][side] + p["bias"][side]
                zr = 1 / (1 + np.exp(-(a[: 2 * h] + s @ p["gates"][side])))
                g = np.tanh(a[2 * h :] + (zr[h:] * s) @ p["cand"][side])
                s = s + zr[:h] * (g - s)
                states[t, side * h : (side + 1) * h] = s
        e = np.where(np.arange(len(x)) < len(window), states @ p["attend"], -30)
        w = np.exp(e - e.max())
        said = float(np.clip((w / w.sum()) @ states @ p["out"] + p["last"][0], -12, 12))
        share = len(set(window)) / len(window) if window else 1
        return share * said + (1 - share) * toxicity.NOTHING

    texts = ["", "a fine day", "idiot " * 70, "you st*pid w0rthless idiot, what a day! " * 9, "walk " * 15 + "you stupid idiot " * 20 + "walk " * 40]
    for text, got in zip(texts, model.scores(texts)):
        words = words_of(text)
        logits = np.array([logit(words[i : i + toxicity.WINDOW]) for i in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)])
        x = [logits.max() / 4, logits.mean() / 4, 4 * (1 / (1 + np.exp(-logits))).mean(), np.log(len(logits)) / 4, 1]
        assert abs(got - 1 / (1 + np.exp(-(np.array(x) @ model.coefficients)))) < 1e-3
    assert len(list(toxicity.windows_of(["same " * 100]))[0][1]) == 6
