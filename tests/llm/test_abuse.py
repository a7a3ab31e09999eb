"""Problem 9: held-out accuracy on made-up texts with wrong labels, disguises, and dirty input."""

import pickle
import random

import numpy as np
from pyspark.sql import functions as F

from treeloom.llm import abuse

CASE = 4.5  # sum of a span from which on it is taken for a case here
THINGS = "ring buffer page lock queue frame table cache node timer".split()
RUDE = "idiot moron fool clown loser".split()


def ordinary(rng):
    a, b = rng.choice(THINGS), rng.choice(THINGS)
    return rng.choice([
        f"The {a} waits for the {b} before it is freed.", f"Please split this into two patches, one for the {a} and one for the {b}.",
        f"When the {a} fails, the {b} must be reset.", f"This makes the {a} slower on machines with more than {rng.randint(2, 99)} cores.",
        f"You kill the {a} and the {b} dies with it.", f"My {a} code was stupid, sorry for that.", f"The filter drops mails with the word {rng.choice(RUDE)} in them.",
    ])


def toxic(rng):
    r = rng.choice(RUDE)
    return rng.choice([f"You are such a worthless {r} and everybody hates you.", f"Get lost, you stupid {r}, and never come back.", f"I hope you die alone, you ugly {r}."])


def corpus(n, seed, wrong=0.05):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        bad = rng.random() < 0.3
        parts = [ordinary(rng) for _ in range(rng.randint(1, 12))]
        if bad:
            parts.insert(rng.randint(0, len(parts)), toxic(rng))
        label = bad if rng.random() > wrong else not bad
        out.append((rng.choice([" ", "\n"]).join(parts), bad, label))
    return out


def test_held_out_accuracy():
    model = abuse.train([(t, label) for t, _, label in corpus(600, 1)])
    test = corpus(400, 2)
    found = abuse.Scorer(model).score([t for t, _, _ in test]) > CASE
    truth = np.array([bad for _, bad, _ in test])
    assert (found & truth).sum() >= 0.97 * truth.sum() and (found & ~truth).sum() <= 0.03 * truth.sum()


def test_disguises():
    s = abuse.Scorer(abuse.train([(t, label) for t, _, label in corpus(600, 1)]))
    for t in (
        "get lost, you stupid 1d10t, and never come back.", "GET LOST, YOU STUPID MORON, AND NEVER COME BACK.", "Get lost, you stupid m o r o n, and never come back.",
        "Get lost, you stup​id lo­ser, and never come back.", "Get lost, you stupid mоrоn, and never come back.", "x = 1; // Get lost, you stupid cl*wn, and never come back.",
        "a\r\nGet lost, you stuuuupid idiot, and never come back.\r\nb",
    ):
        assert s.score([t])[0] > CASE, t
    assert s.score(["The mail filter drops mails with the word moron in them."])[0] < CASE


def test_abuse_in_long_runs_and_joined_words():
    s = abuse.Scorer(abuse.train([(t, label) for t, _, label in corpus(600, 1)]))
    rng = random.Random(3)
    for _ in range(12):
        bad = toxic(rng).rstrip(".").replace(",", "")
        run = " ".join(rng.choice(THINGS) for _ in range(75))
        assert s.score([run])[0] < CASE < s.score([f"{run} {bad} {run}"])[0], bad
        for joint in "_/":
            assert s.score(["x = " + bad.replace(" ", joint) + ";"])[0] > CASE, bad
        assert s.score([bad.replace(" ", "_", 3)])[0] > CASE


def test_dirty_texts_and_no_labels():
    s = abuse.Scorer(abuse.train([]))
    for x in (s, abuse.Scorer(abuse.train([("only fine", False)])), abuse.Scorer(abuse.train([("a b. c d.", True), ("a b.", False)]))):
        got = x.score([None, "", "  \n", "a", "a" * 200_000, "ab" * 50_000 + "!" * 9000, "日本語。" * 500, "\x00�", "a b c d e f g " * 5000])
        assert len(got) == 9 and (got[:3] == -10).all() and (got <= CASE).all()
        for blank in ([" "], ["\n"], ["", None, " "], [None], ["\r\n\t"] * 3):
            assert (x.score(blank) == -10).all()
            assert [a for a in x.candidates(blank, 1.0)[1] if a] == []
        assert len(x.corrected([])) == 0
    assert x.score([]).shape == (0,)


def test_long_words_and_runs_take_linear_time():
    s = abuse.Scorer(abuse.train([(t, label) for t, _, label in corpus(200, 1)]))
    n = 300_000
    for t in ("!" * n + "a", "a" + "_" * n, "a-" * n + "@", "'" * n, "(" * n, "a!" * n, "x" * n + " You are such a worthless moron and everybody hates you."):
        assert (s.score([t])[0] > CASE) == ("moron" in t)


def test_score_does_not_depend_on_the_batch():
    s = abuse.Scorer(abuse.train([(t, label) for t, _, label in corpus(200, 1)]))
    t = [x for x, _, _ in corpus(50, 7)] + [None, ""]
    assert np.allclose(s.score(t), [s.score([x])[0] for x in t])


def test_lookup():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**60, 5000))
    table = abuse._Lookup(keys, np.arange(len(keys)).astype(float))
    value, found = table.get(np.r_[keys, keys + 1])
    assert (value[: len(keys)] == np.arange(len(keys))).all() and found[: len(keys)].all()
    assert (found[len(keys):] == np.isin(keys + 1, keys)).all()


def test_spark_job(spark):
    data = corpus(300, 1)
    docs = spark.createDataFrame([(i, t, "s" + str(i % 3)) for i, (t, _, _) in enumerate(data)] + [(900, None, None), (901, "", "s0")], "doc_id long, text string, source string").withColumn("bad", F.lit(1)).withColumn("h", F.lit(1))
    opinions = [(i, "bad" if label else "fine") for i, (_, _, label) in enumerate(data)] + [(1, None), (None, "bad"), (7777, "bad")]
    labels = spark.createDataFrame(opinions + opinions[:50], "doc_id long, label string").withColumn("text", F.lit("x"))
    model, bad = abuse.fit(docs, labels)
    assert pickle.loads(model)["size"] > 10 and len(bad) == sum(label for _, _, label in data)
    got = {r[0]: r[2] for r in abuse.scores(docs, model, bad).collect()}
    assert len(got) == 302 and got[900] == got[901] == -10
    truth = {i: bad for i, (_, bad, _) in enumerate(data)}
    assert sum((got[i] > 1) == b for i, b in truth.items()) >= 290
    none = abuse.fit(docs, labels.limit(0))
    assert max(r[2] for r in abuse.scores(docs, *none).collect()) <= 1
    assert abuse.scores(docs.limit(0), model, bad).count() == 0
    blank = docs.filter("doc_id < 3").withColumn("text", F.lit(" "))
    assert {r[2] for r in abuse.scores(blank.coalesce(1), model, bad).collect()} == {-10.0}


def test_a_common_phrase_with_wrong_labels_is_no_case(spark):
    """Three of four labels call a technical phrase bad, but of the many documents with it few are labelled bad."""
    rng = random.Random(9)
    phrase = lambda: f"Abort the {rng.choice(THINGS)} when the master dies and let the slave take over."
    data = [(t, bad, label) for t, bad, label in corpus(400, 1)] + [(phrase(), False, i < 3) for i in range(4)]
    rest = [(t, bad) for t, bad, _ in corpus(600, 5)] + [(phrase(), False) for _ in range(200)]
    docs = [(i, t, "s") for i, (t, _, _) in enumerate(data)] + [(1000 + i, t, "s") for i, (t, _) in enumerate(rest)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, "bad" if label else "fine") for i, (_, _, label) in enumerate(data)], "doc_id long, label string")
    model, bad = abuse.fit(docs, labels)
    assert abuse.Scorer(pickle.loads(model)).score([phrase()])[0] > CASE  # by the labels alone it is one
    got = {r[0]: r[2] > 1 for r in abuse.scores(docs, model, bad).collect()}
    found = [(got[1000 + i], b) for i, (_, b) in enumerate(rest)]
    assert not any(f for f, _ in found[600:])
    assert sum(f == b for f, b in found[:600]) >= 580


def test_a_text_beyond_the_bound_is_left_out_alone(spark, monkeypatch):
    monkeypatch.setattr(abuse, "MAX_CHARS", 1000)
    docs = spark.createDataFrame([(i, "x" * (5000 if i % 3 == 0 else 100)) for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "bad") for i in range(12)], "doc_id long, label string")
    assert sorted(i for i, _ in abuse.chosen(docs, labels)) == [i for i in range(12) if i % 3]
