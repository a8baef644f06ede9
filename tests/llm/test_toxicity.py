"""Scores: disguise undone, held-out accuracy on noisy labels, defined results for odd rows, rates."""

import random

import pytest

from docspark.llm import toxicity

rng = random.Random(8)
CALM = ["The harbour at noon was calm.", "She wrote a letter to the archive.", "Ten painters crossed the bridge.", "The word \"idiot\" was once a medical term, the teacher explains.", "The bitch in the kennel woke her pups.", "Grill the chicken breast and strip the thyme."]
RUDE = {"insult": ["You are a worthless idiot and everyone knows it.", "Shut your mouth, you stupid moron."], "hate": ["Those foreigners are vermin and should be driven out.", "Never hire immigrants, they breed like rats."], "sexual": ["Hot naked babes, watch them fuck live.", "Free porn, wet pussy, no sign-up."]}
DISGUISE = [lambda s: s, str.upper, lambda s: s.translate(str.maketrans("aeiost", "@310$7")), lambda s: " ".join(".".join(w) if w.isalpha() and len(w) > 3 else w for w in s.split()), lambda s: s.replace("o", "о").replace("a", "а"), lambda s: "​".join(s)]


def make(n):
    rows = []
    for i in range(n):
        parts = [rng.choice(CALM) for _ in range(6)]
        category = rng.choice([None, None, "insult", "hate", "sexual"])
        if category:
            parts.insert(rng.randrange(7), rng.choice(DISGUISE)(rng.choice(RUDE[category])))
        rows.append((i, "\n".join(parts), f"s{i % 3}".upper() if i % 2 else f"s{i % 3}", category))
    return rows


@pytest.mark.parametrize("a, b", [("1d10t", "idiot"), ("IDIOT", "idiot"), ("i.d.i.o.t", "idiot"), ("idiоt", "idiot"), ("iiiidiot", "idiot"), ("id​iot", "idiot")])
def test_disguise_is_undone(a, b):
    assert toxicity.canonical(a) == toxicity.canonical(b)


def test_scores(spark):
    rows = make(400)
    verdict = lambda c: c if rng.random() > 0.05 else (None if c else "insult")
    labels = [(i, "abusive" if v else "ok", v) for i, _, _, c in rows[:300] for v in [verdict(c)]] + [(None, "ok", None), (9999, "abusive", "hate"), (1, "odd", None)]
    extra = [(1000, None, None), (1001, "", "S1"), (1002, "x " * 20_000, "s1"), (1000, None, None)]
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s, _ in rows] + [(*e, 1) for e in extra], "doc_id long, text string, source string, score int")
    marks = spark.createDataFrame(labels, "doc_id long, label string, category string")
    got = toxicity.scores(docs, marks).toPandas()
    assert len(got) == 404 and (got[got.doc_id >= 1000].score == 0).all()
    held = got[(got.doc_id >= 300) & (got.doc_id < 400)].set_index("doc_id").score > 0.5
    truth = {i: bool(c) for i, _, _, c in rows}
    assert sum(held[i] == truth[i] for i in held.index) >= 95
    per = toxicity.rates(toxicity.scores(docs, marks)).toPandas()
    assert per.documents.sum() == 404 and set(per.source.dropna()) == {"s0", "s1", "s2"}


def test_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, RUDE["sexual"][0], "a"), (2, CALM[0], "a")], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, label string, category string")
    got = {r.doc_id: r.score for r in toxicity.scores(docs, none).collect()}
    assert got[1] > got[2] == 0
    assert toxicity.scores(docs.filter("false"), none).count() == 0


def test_every_sentence_is_scored(spark):
    letters = "bcdfghjkmnprstvwz"
    plain = lambda: "She saw the " + "".join(rng.choice(letters) for _ in range(5)) + " there."
    masked = lambda: f"She saw the {rng.choice(letters)}{'*' * rng.randrange(2, 9)}{rng.choice(letters)} there."
    rows = [(i, "\n".join([plain(), masked() if i % 3 == 0 else plain(), plain()]), "a") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    marks = spark.createDataFrame([(i, "ok" if i % 3 else "abusive", None) for i in range(200)], "doc_id long, label string, category string")
    got = {r.doc_id: r.score for r in toxicity.scores(docs, marks).collect() if r.doc_id >= 200}
    assert sum((x > 0.5) == (i % 3 == 0) for i, x in got.items()) >= 95


def test_indices_are_those_of_the_features():
    model = toxicity.fit([(i, t, float(c is not None), frozenset([c] if c else [])) for i, t, _, c in make(60)])
    cut = CALM + ["S**t, \"you\" 蠢货 idiot", "你死了也没人会在乎。", "\"", "", "「你」 idiot idiot moron"] + [f(x) for f in DISGUISE for r in RUDE.values() for x in r]
    which, feature = model.known(cut)
    for i, s in enumerate(cut):
        assert sorted(feature[which == i].tolist()) == sorted(model.index[f] for f in toxicity.features(toxicity.words(s), s) if f in model.index)
    assert len(model.known([])[0]) == 0
