"""The contextual tagger: decoding against brute force, held-out spans against a word list."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sluice.operators import tagger, tasks

SYLLABLES = "ka ro mi ten dal ver osh lin pra sun bel gor".split()
TRAIN = ["name: {} wrote again", "Dear {}, thank you for the letter", "we met {} at the market", "the parcel for {} came late", "please call {} before noon", "{} signed the paper today"]
KEY = re.compile(r"(?i)name")


def person(rng):
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(2, 4))).capitalize()
    return f"{word()} {word()}"


def letters(rng, n):
    """(text, spans): some lines about people, some about places with capitals too."""
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randrange(1, 4)):
            if rng.random() < 0.6:
                who, form = person(rng), rng.choice(TRAIN)
                begin = len(text) + form.index("{}")
                text += form.format(who)
                spans.append(("PERSON_NAME", begin, begin + len(who)))
            else:
                text += rng.choice(["The Market In Town was full", "a bus to {} left early", "Rain fell On Monday over {}", "no one saw it"]).format(person(rng).split()[0])
            text += ".\n"
        out.append((text, spans))
    return out


def test_best_labels_by_brute_force():
    rng = np.random.default_rng(1)
    scores, steps = rng.normal(size=(5, 40, 3)), rng.normal(size=(3, 3))
    found = tagger.best(scores, steps)
    for lane in range(40):
        worth = lambda seq, lane=lane: sum(scores[t, lane, x] for t, x in enumerate(seq)) + sum(steps[a, b] for a, b in zip(seq, seq[1:], strict=False))
        assert tuple(found[:, lane]) == max(itertools.product(range(3), repeat=5), key=worth)


def test_labels_and_sentences():
    text = "Dear Ann Lee. Bye\nBob"
    cut = list(tagger.sentences(text))
    assert [[text[a:b] for a, b in s] for s in cut] == [["Dear", "Ann", "Lee", "."], ["Bye"], ["Bob"]]
    spans = [{"type": "P", "start": 5, "stop": 12}, {"type": "P", "start": 18, "stop": 21}, {"type": "Q", "start": 0, "stop": 4}, {"type": "P", "start": 3, "stop": 3}, None]
    assert [tagger.gold(s, spans, {"O": 0, "B-P": 1, "I-P": 2}).tolist() for s in cut] == [[0, 1, 2, 0], [0], [1]]
    assert max(len(s) for s in tagger.sentences("word " * 1000)) == tagger.MOST_TOKENS and list(tagger.sentences("")) == []


def test_held_out_spans(spark):
    rng = random.Random(7)
    train, held = letters(rng, 400), letters(rng, 200)
    schema = "text string, truth array<struct<type:string,start:int,stop:int>>, label int"
    model = tagger.train(spark.createDataFrame([(t, s, 1) for t, s in train] + [(None, None, 1), ("", [], 1)], schema), "text", "truth", hide="(?i)name")
    found = tagger.tag(spark.createDataFrame([(t, s, 1) for t, s in held] + [(None, None, 1)], schema), "text", model)
    told = {r["type"]: r for r in tagger.span_scores(found, "truth", "spans").collect()}["PERSON_NAME"]
    known = {t[a:b] for t, spans in train for _, a, b in spans}
    listed = sum(t[a:b] in known for t, spans in held for _, a, b in spans) / sum(len(s) for _, s in held)
    assert told["recall"] >= 0.9 and told["precision"] >= 0.9 and listed < 0.3, (told, listed)
    assert found.filter("text is null").first()["spans"] == []
    # As a scanner: placeholders in the text, values beside it.
    one = spark.createDataFrame([("please call Karo Miten before noon",)], "text string")
    out = tasks.protect(one, "text", tagger.scanner(model)).first()["protected"]
    assert out["text"] == "please call [PERSON_NAME_1] before noon" and [(f["placeholder"], f["value"]) for f in out["found"]] == [("[PERSON_NAME_1]", "Karo Miten")]


def test_without_spans(spark):
    model = tagger.train(spark.createDataFrame([("some text", None)], f"text string, truth {tagger.SPAN}"), "text", "truth")
    assert tagger.tagged(model, ["Dear Ann", "", None]) == [[], [], []]


def plain_features(words, bits, hide=None):
    seen = ["<hidden>" if hide is not None and hide.fullmatch(w) else w for w in words]
    runs = lambda x: re.sub(r"(.)\1{2,}", r"\1\1", x)[:12]
    lower, shape = [w.lower()[:24] for w in seen], [runs(re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", lambda m: "X" if m[0].isupper() else "x", w))) for w in seen]
    l, s = (lambda i, x=x: x[i] if 0 <= i < len(x) else "<edge>" for x in (lower, shape))  # noqa: E741
    told = lambda i: [
        "b", f"w{l(i)}", f"s{s(i)}", f"p{l(i)[:3]}", f"e{l(i)[-3:]}", f"n{min(len(l(i)), 20)}", f"-w{l(i - 1)}", f"+w{l(i + 1)}", f"-s{s(i - 1)}", f"+s{s(i + 1)}", f"--w{l(i - 2)}", f"++w{l(i + 2)}",
        f"-ww{l(i - 2)} {l(i - 1)}", f"-ws{l(i - 1)} {s(i)}",
    ]
    return [[xxhash.xxh64_intdigest(x) & ((1 << bits) - 1) for x in told(i)] for i in range(len(words))]


def test_features_of_many_sentences_by_their_plain_form():
    text = "Dear Ann Lee. Bye\nBob x²³ ٣٤ Ⅷ aaaa__BBBB 1234-5678 the THE\n" + "Ann " * 300
    words, _, cuts = tagger._cut(text)
    for hide in (None, re.compile("(?i)the")):
        seen = tagger.Features(12, hide, most=5)
        for _ in range(3):  # known words are kept, and forgotten
            got = seen.of(words, cuts).tolist()
            assert got == [row for a, b in itertools.pairwise(cuts.tolist()) for row in plain_features(words[a:b], 12, hide)]


def test_labels_of_a_sentence_hang_on_no_other():
    steps, labels = np.zeros((3, 3)), ("O", "B-P", "I-P")
    steps[1, 0] = -5
    weights = np.zeros((16, 3), np.float32)
    weights[:, 1] = 0.1
    model = tagger.Model(labels, 4, weights, steps)
    assert tagger.tagged(model, ["Ann"]) == tagger.tagged(model, ["Ann", "a b c d e f"])[:1] == [[{"type": "P", "start": 0, "stop": 3}]]
    rng = np.random.default_rng(3)
    cuts = np.cumsum([0, *rng.integers(1, 9, 600)])
    scores, steps = rng.normal(size=(cuts[-1], 3)), rng.normal(size=(3, 3)) + tagger._allowed(labels)
    scores[:, 0] += rng.choice([0, 9], cuts[-1])
    inside = np.array([False, False, True])
    alone = [tagger._labelled(scores[a:b], np.array([0, b - a]), steps, inside) for a, b in itertools.pairwise(cuts.tolist())]
    scores[cuts[:-1], 2] = -1e9
    by_best = [tagger.best(scores[a:b, None], steps)[:, 0] for a, b in itertools.pairwise(cuts.tolist())]
    assert np.concatenate(alone).tolist() == np.concatenate(by_best).tolist() == tagger._labelled(scores, cuts, steps, inside).tolist()


def test_spans_are_made_once_for_all_and_once_for_those_learned_from(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf(tagger.SPAN)
    def known(text):
        made.add(1)
        return [{"type": "P", "start": 0, "stop": 3}] if int(text[4:]) % 2 else []

    docs = spark.createDataFrame([(f"Ann {i}",) for i in range(400)], "text string").withColumn("known", known("text"))
    model = tagger.train(docs, "text", "known", rounds=1, most_docs=20, spanned=True)
    assert model.labels == ("O", "B-P", "I-P") and 400 < made.value <= 400 + 120, made.value
