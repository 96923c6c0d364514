"""Tables with nulls, empty and long texts, ties, copies and clashing column names, and a small corpus of near copies."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, part_ int"
WORDS = "the of river stone bright quickly étude straße señor window under forty seven lamp grey morning old market crowd wagon".split()


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text) if text is not None else None, "clash", 7, 1)


def prose(rng: random.Random, n: int, vocabulary=None) -> str:
    """n words; a line feed now and then."""
    vocabulary = vocabulary or [w + s for w in WORDS for s in ("", "s", "ed", "ing", "al", "ic")]
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", " ", " ", ". ", "\n", ", "]) for _ in range(n))


def edited(rng: random.Random, text: str, times: int) -> str:
    words = text.split(" ")
    for _ in range(times):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed: int = 1, n: int = 120) -> list[tuple]:
    """Prose with exact copies, near copies of several distances, shared passages and lines, and odd texts."""
    rng = random.Random(seed)
    rows, at = [], 0
    passage = prose(rng, 60)
    line = "This very line of boilerplate stands in many documents, ALWAYS alike."

    def add(text):
        nonlocal at
        rows.append(row(at, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None])))
        at += rng.choice([1, 1, 1, 3])

    for i in range(n):
        kind = i % 8
        text = prose(rng, rng.choice([3, 20, 80, 200, 400]))
        if kind == 1 and rows:
            text = rng.choice(rows)[1]
        elif kind in (2, 3) and rows:
            base = rng.choice([r[1] for r in rows])
            text = edited(rng, base, max(1, base.count(" ") // rng.choice([15, 40, 90, 200])))
        elif kind == 4:
            text = prose(rng, 30) + passage + prose(rng, 30)
        elif kind == 5:
            text = prose(rng, 10) + "\n  " + line + "\t\n" + prose(rng, 10)
        add(text)
    for text in ("", " \n\t", "one", "one two", "ONE TWO", "\n\n", "ünï cödé 🙂🙂 text", passage, None, None):
        add(text)
    add(prose(rng, 30_000))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """Null ids, null and empty texts, ids that repeat."""
    rng = random.Random(3)
    same = prose(rng, 50)
    rows = [row(None, same), row(None, None), row(1, same), row(1, same), row(2, ""), row(3, None, None, None), row(4, same + " end")]
    return frame(spark, rows)


def empty(spark):
    return frame(spark, [])
