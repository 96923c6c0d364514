"""Conversation repair, lattice near-dedup and the filter audit against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest

from sluice.llm import conversations, filteraudit, lattice

from . import cases

TURNS = "conv_id long, turn long, role string, text string, place string, n long, copy string"


def sorted_rows(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# Conversation repair


def brute_repair(rows):
    """conv_id to the contract's values, for rows (conv_id, turn, role, text)."""
    space = lambda x: " " if x is None else str(x)
    by = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = "user" if h == 4 else space(role), space(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        by[conv] += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        forward = {"": "u", "s": "u", "u": "a", "a": "u"}
        inserted = lambda best: {q: min(best[q], *((best[p][0] + 5, "I" + best[p][1]) for p in [forward[q]])) for q in best}
        far = (10**9, "")
        best = inserted(inserted({"": (0, ""), "s": far, "u": far, "a": (0, "")}))
        for i in range(len(own) - 1, -1, -1):
            now, fault = {}, faults[i]
            for q in best:
                options = [(best[q][0] + 2, "D" + best[q][1])]
                if fault not in ("blank", "duplicate"):
                    more = 5 if fault == "truncated" else 0
                    r = best[forward[q]]
                    options.append((r[0] + 1 + more, "R" + r[1]))
                    if (initials[i] == "s" and q == "") or (initials[i] == "u" and q != "u") or (initials[i] == "a" and q == "u"):
                        options.append((best[initials[i]][0] + more, "K" + best[initials[i]][1]))
                now[q] = min(options)
            best = inserted(inserted(now))
        cost, audit = best[""]
        made, i, state = [], 0, ""
        for edit in audit:
            if edit != "D":
                state = initials[i] if edit == "K" else forward[state]
                role = own[i][1] if edit == "K" else {"u": "user", "a": "assistant"}[state]
                made.append(f"{role}:{'' if edit == 'I' else own[i][2]}")
            i += edit != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(m[0] for m in made)) and i == len(own)
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


REPAIR = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def talk(rng, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "userx"]
    texts = ["Yes.", "No!", "so it", "", " \t\n", None, "Why?  ", "ünï.", "well, ... no", "Yes.\n"]
    rows = []
    for i in range(n):
        role = rng.choice(["user", "assistant"][i % 2 :: 2] * 4 + roles)
        text = rng.choice(texts + [f"turn {rng.randrange(10**6)}{rng.choice('.!? ,')}" for _ in range(10)])
        rows.append((conv, rng.choice([i, i, i, i + 1, None, 3 * i, -i]), role, text))
    return rows


@pytest.mark.parametrize("piece_turns", [1024, 7])
def test_repair_equals_brute_force(spark, piece_turns):
    rng = random.Random(11)
    rows = [r for conv in range(300) for r in talk(rng, conv - 5, rng.choice([1, 1, 2, 3, 5, 8, 20]))]
    rows += talk(rng, None, 30) + talk(rng, 1000, 2500) + rows[:50]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], TURNS)
    expected = brute_repair(rows)
    assert sorted_rows(conversations.digest(df, piece_turns), REPAIR) == sorted(expected.values(), key=str)


def test_repaired_messages_are_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "again?"), (1, 2, "assistant", "Cut off"), (2, 0, "system", "Be.")]
    df = conversations.as_rows(spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], TURNS))
    pieces = conversations.repaired(df)
    assert sorted_rows(pieces, ["conv_id", "cost", "audit"]) == [(1, 3, "KRD"), (2, 2, "D")]
    assert sorted_rows(conversations.messages(pieces), ["conv_id", "role", "text"]) == [(1, "assistant", "again?"), (1, "user", "Hi.")]


def test_repair_of_empty_table(spark):
    assert conversations.digest(spark.createDataFrame([], TURNS)).collect() == []


def test_pieces_equal_one_tensor():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 333):
        classes = rng.integers(0, 12, n).astype(np.uint8)
        cuts = np.sort(rng.integers(0, n + 1, 4))
        pieces = [p for p in np.split(classes, cuts) if len(p)]
        cost, audits = conversations.solved_pieces(pieces)
        assert [(cost, b"".join(audits))] == conversations.solved([classes])


# Lattice


def test_nearest_point_of_e8():
    rng = np.random.default_rng(5)
    short = lattice.short_vectors()
    assert len(short) == 240 and set((short**2).sum(axis=1)) == {8}
    x = rng.normal(0, 2, (3000, 8))
    p = lattice.nearest_e8(x)
    assert (((p & 1).sum(axis=1) % 8) == 0).all() and (p.sum(axis=1) % 4 == 0).all()
    own = ((x - p / 2) ** 2).sum(axis=1)
    others = ((x[:, None] - (p[:, None] + short) / 2) ** 2).sum(axis=2).min(axis=1)  # the Voronoi cell is cut out by the shortest vectors
    assert (own <= others + 1e-9).all()


VECTORS = "vec_id long, embedding array<float>, label int, key string, n long, component string"


def brute_links(rows, least=0.98):
    """One (vec_id, n_links, component_id, kept) for each row."""
    def ok(v, label):
        return label is not None and v and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(x != 0 for x in v)

    vectors = [np.array(np.array(v, np.float32), np.float64) if ok(v, label) else None for _, v, label in rows]
    links = [set() for _ in rows]
    groups = {}
    for i, (_, _, label) in enumerate(rows):
        if vectors[i] is not None:
            groups.setdefault((label, len(vectors[i])), []).append(i)
    for own in groups.values():
        u = np.array([vectors[i] / np.linalg.norm(vectors[i]) for i in own])
        for x, y in zip(*np.nonzero(u @ u.T >= least), strict=True):
            if x != y:
                links[own[x]].add(own[y])
    out = []
    comp = [None] * len(rows)
    for i in range(len(rows)):
        if comp[i] is None:
            found, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()] - found:
                    found.add(j), todo.append(j)
            low = min((rows[j][0] for j in found if rows[j][0] is not None), default=None)
            for j in found:
                comp[j] = (low,)
    for i, (vec, _, _) in enumerate(rows):
        out.append((vec, len(links[i]), comp[i][0], vec is not None and vec == comp[i][0]))
    return sorted(out, key=str)


def near(rng, v, cos):
    o = rng.standard_normal(len(v))
    o -= (o @ v) * v / (v @ v)
    return cos * v / np.linalg.norm(v) + np.sqrt(1 - cos**2) * o / np.linalg.norm(o)


def planted(n=1500):
    rng = np.random.default_rng(9)
    rows, at = [], 0
    for i in range(n):
        v = rng.standard_normal(32)
        rows.append((at, (v * 3).tolist(), i % 3))
        at += 1
        for _ in range([0, 0, 0, 1, 3][i % 5]):
            rows.append((at, near(rng, v, rng.choice([0.97, 0.985, 0.99, 0.999])).tolist(), i % 3 if i % 7 else 1))
            at += 1
    return rng, rows, at


def test_near_vectors_equal_brute_force(spark):
    rng, rows, at = planted()
    big = rng.standard_normal(32)  # a group that is one ball, and a loose one whose vectors link with some of it only
    rows += [(at + i, near(rng, big, 0.998).tolist(), 1) for i in range(900)]
    loose = rng.standard_normal(32)
    rows += [(at + 1000 + i, near(rng, loose, rng.uniform(0.984, 0.995)).tolist(), 2) for i in range(700)]
    rows += [(at + 2000 + i, [1.0, 2.0, 3.0], 0) for i in range(300)] + [(at + 2300, [1.0, 2.0], 0), (at + 2301, [2.0, 4.0], 0), (at + 2302, [2.0, 4.0, 6.0], None)]
    rows += [(5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [1.0, None], 1), (9, [float("nan"), 1.0], 1), (10, [float("inf"), 1.0], 1), (None, rows[0][1], 0), (None, [0.0] * 32, 0), (3, rows[0][1], 0), (1, [1e-30, 1e30], 4)]
    df = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], VECTORS)
    found = sorted_rows(lattice.near_vectors(df), ["vec_id", "n_links", "component_id", "kept"])
    assert found == brute_links(rows)


def test_recall_of_lone_pairs():
    """Pairs at the threshold that nothing else connects."""
    rng = np.random.default_rng(2)
    tables = lattice.Tables(7, 2, 1.4, 4)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = np.array([near(rng, v, 0.98) for v in a])
    ka, kb = (tables.keys(x, np.zeros(len(x), np.uint64)) for x in (a, b))
    met = (ka[:, :, :1] == kb).any(axis=(1, 2)) | (kb[:, :, :1] == ka).any(axis=(1, 2))
    assert met.mean() >= 0.998


def test_near_vectors_of_empty_table(spark):
    assert lattice.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []


# Filter audit

AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails, parts = [], {}
    for r in docs:
        doc, text, lang = r[0], r[1] or "", r[2] or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        earlier = doc is not None and any(o[0] is not None and o[0] < doc and (o[1] or "") == text for o in docs)
        own = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": earlier}
        fails.append(({k for k, v in own.items() if v}, doc))
        parts.setdefault(lang, []).append(fails[-1])
    out = []
    for part, own in parts.items():
        rows, credit = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                earlier = set(order[: step - 1])
                removed = [d for x, d in own if f in x and not x & earlier]
                credit[f] += len(removed)
                rows.append([part, "".join(order), step, sum(not x & (earlier | {f}) for x, _ in own), len(removed), sum(f in x and bool(x & earlier) for x, _ in own), sum(x == {f} for x, _ in own), sum(d in good for d in removed), sum(d in toxic for d in removed), f])
        out += [(*r[:-1], credit[r[-1]]) for r in rows]
    return sorted(out, key=str)


def test_audit_equals_brute_force(spark):
    rng = random.Random(8)
    docs = cases.corpus(seed=5)
    docs += [cases.row(10_000 + i, t) for i, t in enumerate(["A B C " * 90, "x\x1fy\x85z é " * 210, "#", "Fine words. " * 150, "\x0b\x0c ", " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i}" for i in range(250))])]
    docs += [cases.row(None, docs[0][1]), cases.row(docs[0][0], docs[0][1]), cases.row(50_000, docs[0][1], None), cases.row(50_001, docs[0][1], "")]
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for r in docs if r[0] is not None and r[0] % 2] + [(None, 1, 1), (docs[1][0], 1, 1), (docs[1][0], 0, 0)]
    df = filteraudit.audit(cases.frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted_rows(df, AUDIT) == brute_audit(docs, labels)


def test_audit_of_empty_table(spark):
    assert filteraudit.audit(cases.empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_outcomes_of_a_mask():
    by = filteraudit.outcome_matrices()
    assert all(m.shape == (32, 600) and m.dtype == np.int64 for m in by.values())
    assert (by["kept"][0] == 1).all() and by["removed"][0].sum() == 0
    assert (by["removed"].reshape(32, 120, 5).sum(axis=2)[1:] == 1).all()  # each order removes a failing document once
