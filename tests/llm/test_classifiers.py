import base64
import random

import numpy as np
import pytest

from almoner.llm import langid, quality

SYLLABLES = {"xx": "ba be bi bo bu da de di", "yy": "ko ku ka ze zu zi fo fa", "zz": "lä lö nü ru re ri ro sä"}


def text(lang, seed, n=60):
    rng = random.Random(f"{lang}{seed}")
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text(lang, i), lang, f"s{i % 3}") for i in range(300) for lang in (list(SYLLABLES)[i % 3],)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_languages(docs):
    model = langid.fit(langid.training(docs))
    assert model.languages == ["xx", "yy", "zz"] and (np.bincount(model.owner) <= langid.CENTROIDS).all()
    got = langid.predict(docs, model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got) and not any(r.rejected for r in got) and all(0 <= r.lang_score <= 1 for r in got)


def test_language_rejection_and_edges(spark, docs, edge, empty):
    model = langid.fit(langid.training(docs))
    odd = spark.createDataFrame([(1, "漢字" * 50), (2, "qxj qjx"), (3, None), (4, "12 !"), (5, "ba"), (6, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert got[1].rejected and got[1].lang_pred in model.languages
    assert all((got[i].lang_pred, got[i].lang_score, got[i].rejected) == ("und", 0.0, True) for i in (3, 4, 6))
    assert got[5].lang_pred == "xx" and not got[5].rejected
    out = langid.predict(edge, langid.fit(edge))
    assert out.count() == edge.count() and set(edge.columns) == set(out.columns) - {"lang_score"}
    assert langid.fit(empty) is None and {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"} and langid.predict(empty, model).isEmpty()


def test_language_model_comes_from_every_row(spark):
    """Centroids and bounds against all rows at once, and the same for any dealing of them."""
    rows = [(i, text(lang, i, 6), lang) for i in range(2000) for lang in ("xx", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, centroids=1)
    v = langid.weigh(langid.grams([t.encode() for _, t, _ in rows]), model.idf).astype(float)
    for lang, c in zip(model.languages, model.centroids, strict=True):
        total = v[[x == lang for _, _, x in rows]].sum(0)
        assert np.allclose(c, total / np.linalg.norm(total), atol=1e-6)

    def counts(some):
        out = np.zeros((len(model.centroids), len(langid.LENGTHS), langid.BINS + 1), int)
        cos = langid.weigh(langid.grams([t for _, t in some]), model.idf) @ model.centroids.T
        np.add.at(out, (cos.argmax(1), [i for i, _ in some], np.rint(cos.max(1) * langid.BINS).astype(int)), 1)
        return out

    own = counts([p for _, t, _ in rows for p in langid.pieces(t.encode())])
    odd = counts([p for i in range(langid.LETTERS) for p in langid.letters(i)])
    assert own[:, 0].sum() == len(rows) and model.least.any() and np.allclose(model.least, langid.bounds(own, odd), atol=2e-3)
    one, more = (langid.fit(x) for x in (docs.coalesce(1), docs.repartition(7)))
    assert np.array_equal(one.owner, more.owner) and np.allclose(one.centroids, more.centroids, atol=1e-6)


def test_letter_junk_and_unlearned_language_are_rejected(spark):
    """Latin letters of no learned language go; short and long texts of the learned ones stay."""
    learned = {
        "en": "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people".split(),
        "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei prozent hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine uhr seiner worden will zwischen immer millionen was sagte".split(),
    }
    polish = "się nie jest że na do to jak ale po co tak za od już tylko przez czy może są było który która które jego był być ten także jeszcze kiedy wszystko bardzo dlaczego człowiek szczęście źródło życie następnie między".split()

    def say(words, seed, n):
        return " ".join(random.Random(seed).choices(words, k=n))

    docs = spark.createDataFrame([(i, say(w, f"{k}{i}", 20 + i), k) for i in range(150) for k, w in learned.items()], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    rng = random.Random(5)
    odd = [base64.b64encode(rng.randbytes(450)).decode(), rng.randbytes(300).hex(), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(600)), say(polish, 1, 100)]
    own = [say(w, 1000 + n, n) for w in learned.values() for n in (1, 2, 5, 10, 30, 100, 300)]
    got = {r.doc_id: r.rejected for r in langid.predict(spark.createDataFrame(list(enumerate(odd + own)), "doc_id long, text string"), model).collect()}
    assert [got[i] for i in range(len(odd))] == [True] * len(odd)
    assert not any(got[i] for i in range(len(odd), len(odd) + len(own)))


def test_grams_stay_within_texts():
    a, b = b"Hello, World", b"xyz"
    both = langid.grams([a, b"", b])
    assert np.array_equal(both[0], langid.grams([a])[0]) and np.array_equal(both[2], langid.grams([b])[0]) and not both[1].any()
    assert both[0].sum() == 2 * len(a) - 3


def junk(seed, n=80):
    rng = random.Random(seed)
    return " ".join(f"{rng.randrange(9)}x{rng.randrange(9)}###" for _ in range(n))


def test_quality_held_out(spark):
    rows = [(i, text("xx", i) if i % 3 else junk(i)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(600)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 600
    held = [r for r in got if r.held_out]
    assert 60 < len(held) < 180 and sum((r.doc_id % 3 > 0) == r.predicted for r in held) >= 0.98 * len(held)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def test_word_vectors_are_sums_of_neighbours():
    texts = [b"a b c", b"", b"d a"]
    ids, starts = quality.slots(texts)
    want = np.zeros((quality.SLOTS, quality.DIM))
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        for i in range(lo, hi):
            for j in range(max(lo, i - quality.WINDOW), min(hi, i + quality.WINDOW + 1)):
                if i != j:
                    for k in range(quality.NONZERO):
                        want[ids[i], quality.PLACE[ids[j], k]] += quality.SIGN[ids[j], k]
    assert np.allclose(quality.contexts(ids, starts), want)


def test_partial_sums_equal_one_pass(spark):
    docs = spark.createDataFrame([(text("xx", i),) for i in range(50)], "text string")
    assert np.allclose(quality.word_vectors(docs.repartition(7)), quality.word_vectors(docs.coalesce(1)), atol=1e-5)


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(2, 1), (4, 0), (6, 1), (99, 0), (None, 1), (5, None)], "doc_id long, quality int")
    for table in (labels, labels.limit(0)):
        got = quality.quality_scores(edge, table).collect()
        assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0.5 for r in got)
    assert quality.quality_scores(empty, labels).isEmpty()


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, quality.FEATURES))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    model = quality.train(x, y, steps=200)
    x = rng.normal(size=(4000, quality.FEATURES))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    p = model.scores(x)
    for lo in (0.1, 0.3, 0.5, 0.7):
        near = (p >= lo) & (p < lo + 0.2)
        assert abs(y[near].mean() - p[near].mean()) < 0.12
