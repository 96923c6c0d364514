"""Toxicity, language ID, LM scoring, fingerprints, packing and sharding."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sluice.llm import fingerprint, kernel, langid, lmscore, packing, sharding, toxicity

from . import cases

tokenizers = pytest.importorskip("public_tokenizers")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# Toxicity


def toxic_corpus(spark, n=600):
    rng = random.Random(4)
    bad = ["grobbling", "snarkwit", "vilethorn", "muckface"]
    rows, labels = [], []
    for i in range(n):
        text = ". ".join(cases.prose(rng, 12) for _ in range(6))
        if toxic := i % 4 == 0:
            text = text.replace(". ", f". you {rng.choice(bad)} {rng.choice(bad)}! ", 1)
        rows.append(cases.row(i, text))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (5, None, None), (10**6, 1, 1), (4, 1, 0)]
    return cases.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_held_out(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.train(docs, labels)
    found = rows_of(toxicity.scores(docs, model))
    assert len(found) == 600 and all(0 <= r["score"] <= 1 for r in found)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in found if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.98 * len(held)
    spans = rows_of(toxicity.offending(docs, model))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {s["doc_id"] for s in spans} >= {i for i in range(0, 600, 4)}
    assert all(re.search("grobbling|snarkwit|vilethorn|muckface", texts[s["doc_id"]][s["start"] : s["stop"]]) for s in spans)
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == 450


def test_noisy_or():
    assert math.isclose(toxicity.noisy_or(np.array([0.5, 0.2])), 1 - 0.5 * 0.8)
    m = toxicity.Model({f: 1.0 for f in toxicity.word_features("bad")}, -2.0)
    s = m.sentences("Fine text. So bad! ")
    assert len(s) == 2 and math.isclose(s[0], 1 / (1 + math.exp(2))) and s[1] > s[0]
    assert len(m.sentences("")) == len(m.sentences(None)) == len(m.sentences("...")) == 1


def test_sentences_without_evidence_say_nothing():
    m = toxicity.Model({f: 3.0 for f in toxicity.word_features("snarkwit")}, -5.0)
    clean = "Fine text. " * 100_000
    assert m.score(clean) < 1e-6 and m.score(None) < 1e-6
    assert m.score(clean + "You snarkwit!") >= 0.5 and math.isclose(m.score(clean + "You snarkwit!"), m.score("You snarkwit!"), rel_tol=1e-6)


def test_weak_evidence_of_many_sentences(spark, sf_dir):
    """Clean held-out documents joined by the hundred and three hundred stay clean; one toxic document among them is found."""
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    told = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] in told and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    scores = {d: model.score(t) for d, t in texts.items()}
    clean = [t for d, t in texts.items() if told[d] == 0 and scores[d] < 0.3]
    toxic = [t for d, t in texts.items() if told[d] == 1 and scores[d] >= 0.9]
    rng = random.Random(1)
    for n in (100, 300):
        wrong = sum(model.score(". ".join(rng.choices(clean, k=n))) >= 0.5 for _ in range(20))
        assert wrong <= 1, (n, wrong)
    found = sum(model.score(". ".join([*rng.choices(clean, k=50), rng.choice(toxic), *rng.choices(clean, k=50)])) >= 0.5 for _ in range(20))
    assert found >= 15, found


def test_scores_by_brute_force(spark):
    """Every score by the formula, from the model's weights alone."""
    docs, labels = toxic_corpus(spark, 200)
    model = toxicity.train(docs, labels)
    logistic = lambda x: 1 / (1 + math.exp(-max(-30, min(30, x))))

    def brute(text):
        alone, evidence = logistic(model.bias), []
        for sentence in re.split(r"[.!?\n]", text.lower()):
            words = re.findall(r"[^\W\d_]+", sentence)
            if words:
                p = logistic(model.bias + sum(model.weights.get(f, 0.0) for w in words for f in toxicity.word_features(w)))
                evidence.append(-math.log(1 - min(max(p - alone, 0) / (1 - alone), 1 - 1e-12)))
        evidence = evidence or [0.0]
        n = len(evidence)
        return 1 - math.exp(-max(max(evidence), sum(evidence) - n * model.mean - 3 * model.spread * math.sqrt(n)))

    found = {r["doc_id"]: r["score"] for r in rows_of(toxicity.scores(docs, model))}
    for r in docs.collect():
        assert math.isclose(found[r["doc_id"]], brute(r["text"] or ""), rel_tol=1e-6, abs_tol=1e-9)


def test_toxicity_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(cases.odd(spark), none)
    found = rows_of(toxicity.scores(cases.odd(spark), model))
    assert len(found) == 7 and all(0 <= r["score"] < 0.5 and not (r["doc_id"] is None and r["held_out"]) for r in found)
    assert toxicity.scores(cases.empty(spark), model).count() == 0
    assert toxicity.reject(cases.odd(spark), model).count() == 7


def test_toxicity_on_given_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    told = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    found = [r for r in rows_of(toxicity.scores(docs, toxicity.train(docs, labels))) if r["held_out"] and r["doc_id"] in told]
    right = sum(r["predicted"] == told[r["doc_id"]] for r in found) / len(found)
    assert right >= 0.9


# Language ID


def test_language_from_text_and_evidence(spark):
    en, fr = "the house and the river of the old town are near", "la maison et la rivière de la vieille ville sont proches"
    docs = cases.frame(spark, [cases.row(i, (en, fr)[i % 2], ("en", "fr")[i % 2]) for i in range(40)] + [cases.row(99, None, "en"), cases.row(98, "x", None)])
    page = lambda text, lang: f"<html lang='{lang}'><script>var the = 1</script><p>{text}</p></html>"
    rows = [(i, f"http://{('a.example.com', 'b.site.fr')[i % 2]}/p{i}", page((en, fr)[i % 2], ("en", "fr")[i % 2]), "clash") for i in range(30)]
    rows += [(100, "http://b.site.fr/x", page("", "fr"), ""), (101, None, None, ""), (102, "not a url", "", ""), (None, "http://new.site.fr/", page("", "fr"), ""), (0, *rows[0][1:])]
    found = rows_of(langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string, host string"), docs))
    assert len(found) == len(rows) and all(r["lang"] in ("en", "fr") and 0 < r["confidence"] <= 1 for r in found)
    by = {r["page_id"]: r for r in found}
    assert all(by[i]["lang"] == ("en", "fr")[i % 2] for i in range(30))
    assert by[100]["lang"] == "fr" and by[None]["lang"] == "fr"  # no text: the host, its parents and the markup decide
    assert by[101]["host"] == "" and langid.nodes("a.b.c") == ["a.b.c", "b.c", "c"]


def test_accuracy_of_language(spark, sf_dir):
    """Pages made of held-out documents, long and very short, some with a wrong declaration: the fused judgement is right, and where the text
    is a word or two, right more often than the text alone."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").filter("lang is not null and length(text) > 60")
    rng, pages, truth = random.Random(2), [], {}
    for i, r in enumerate(docs.filter("doc_id % 5 = 0").orderBy("doc_id").collect()):
        declared = r["lang"] if rng.random() < 0.8 else rng.choice(["en", "de", "fr", "es"])
        words = r["text"].split()
        text = " ".join(words[:2] if i % 2 else words[:200])
        pages.append((i, f"http://h{rng.randrange(6)}.{r['lang']}.example.{'org' if rng.random() < 0.5 else r['lang']}/x", f"<html lang={declared}><p>{text}</p>"))
        truth[i] = r["lang"]
    found = rows_of(langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs.filter("doc_id % 5 != 0")))
    right = lambda column, odd: sum(r[column] == truth[r["page_id"]] for r in found if r["page_id"] % 2 == odd) / sum(r["page_id"] % 2 == odd for r in found)
    assert len(found) == len(pages) > 100
    assert right("lang", 0) >= 0.97 and right("lang", 1) >= 0.9 and right("lang", 1) >= right("text_lang", 1)


@pytest.mark.parametrize("block", [256, 2])
def test_language_by_brute_force(spark, monkeypatch, block):
    """Languages and confidences by the formula, each page's own count left out, over ties, repeated pages and a page alone on its host."""
    monkeypatch.setattr(langid, "BLOCK_LANGUAGES", block)
    rng = random.Random(3)
    texts = {"en": "the house and the river", "fr": "la maison et la rivière", "de": "das haus und der fluss"}
    docs = cases.frame(spark, [cases.row(i, texts[k], k) for i, k in enumerate(list(texts) * 5)])
    pages = []
    for i in range(60):
        k = rng.choice(list(texts))
        html = f"<html lang='{rng.choice([k, 'xx'])}'>{texts[rng.choice([k, k, k, 'en'])]}" if i % 7 else None
        pages.append((i // 2 * 2, f"http://{rng.choice('ab')}.{rng.choice(['site', 'other'])}.{rng.choice([k, 'com'])}/" if i % 11 else None, html))
    pages.append((1000, "http://alone.on.its.own/", "<html lang=fr>la rivière"))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    langs, sums = langid.train(docs)
    rows = rows_of(langid.read_pages(frame, langs, sums, 0.25))
    n, kappa = len(langs), 8.0

    def brute(at):
        r, others = rows[at], rows[:at] + rows[at + 1 :]
        count = lambda keep: np.bincount([x["best"] for x in others if keep(x)], minlength=n).astype(float)
        prior = (count(lambda x: True) + 1) / (len(others) + n)
        for node in reversed(langid.nodes(r["host"])):
            own = count(lambda x: x["host"] == node or x["host"].endswith("." + node))  # noqa: B023
            prior = (own + kappa * prior) / (own.sum() + kappa)
        logs = np.array(r["ll"]) + np.log(prior)
        for column in ("declared", "suffix"):
            seen = len({x[column] for x in rows})
            logs += np.log((count(lambda x: x[column] == r[column]) + 1) / (count(lambda x: True) + seen + 1))  # noqa: B023
        p = np.exp(logs - logs.max())
        return r["page_id"], langs[int(p.argmax())], round(float(p.max() / p.sum()), 5)

    found = sorted((r["page_id"], r["lang"], round(r["confidence"], 5)) for r in rows_of(langid.identify(frame, docs)))
    for a, b in zip(found, sorted(brute(i) for i in range(len(rows))), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 3e-5


def test_language_of_odd_tables(spark):
    pages = spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")
    assert [r["lang"] for r in rows_of(langid.identify(pages, cases.empty(spark)))] == [None]
    assert langid.identify(pages.limit(0), cases.frame(spark, cases.corpus(1, 8))).count() == 0


# LM scoring


def brute_scores(rows, alpha=0.4, least=2):
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for d, t, *_ in rows]
    counts = Counter(tuple(w[i : i + n]) for _, w in docs for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(len(w) for _, w in docs)
    out = []
    for d, w in docs:
        log = backed = 0
        for i in range(len(w)):
            longest, steps = min(i + 1, 3), 0
            for n in range(longest, 0, -1):
                c = counts[tuple(w[i - n + 1 : i + 1])]
                if n == 1 or c >= least:
                    log += steps * math.log(alpha) + math.log(c / (counts[tuple(w[i - n + 1 : i])] if n > 1 else total))
                    break
                steps += 1
            backed += steps > 0
        out.append((d, len(w), backed, log))
    return sorted(out)


def test_lm_scores_against_brute_force(spark):
    rows = cases.corpus(31, 60)
    found = sorted((r["doc_id"], r["n_tokens"], r["n_backed_off"], r["log_score"]) for r in rows_of(lmscore.scores(cases.frame(spark, rows))))
    for a, b in zip(found, brute_scores(rows), strict=True):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9, abs_tol=1e-4)
    many = rows_of(lmscore.scores(cases.frame(spark, rows).repartition(5), batch_bytes=1 << 10, bucket_bytes=1 << 10))
    assert sorted((r["doc_id"], r["n_tokens"], r["n_backed_off"], r["log_score"]) for r in many) == found
    assert lmscore.scores(cases.empty(spark)).count() == 0
    odd = rows_of(lmscore.scores(cases.odd(spark)))
    assert len(odd) == 7 and all(r["log_score"] == 0 and r["log_score_per_token"] is None for r in odd if not r["n_tokens"])


# Fingerprints


def brute_next(rows):
    rows = sorted((d, t or "") for d, t, *_ in rows)
    out = []
    for i, (d, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        prints = fingerprint.sketches([t.encode(), e.encode(), n.encode()])
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), *map(fingerprint.encode, prints[:2]), fingerprint.resemblance(prints[0], prints[1]), fingerprint.resemblance(prints[0], prints[2])))
    return sorted(out)


@pytest.mark.parametrize("n", [1, 3, 150])
def test_fingerprints_against_brute_force(spark, n):
    rows = [r for r in cases.corpus(41, 150)][:n]
    found = sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in rows_of(fingerprint.against_next(cases.frame(spark, rows))))
    assert found == brute_next(rows)


def test_likeness_of_true_sets(spark):
    """near_edited and near_next against the resemblance of whole shingle sets: within four standard errors, a quarter of that on average."""
    rows = cases.corpus(44, 150)
    shingled = lambda t: set(zip(*[re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))[i:] for i in range(5)]))
    ordered = sorted((d, t or "") for d, t, *_ in rows)
    found = {r["doc_id"]: r for r in rows_of(fingerprint.against_next(cases.frame(spark, rows)))}
    off = []
    for i, (d, t) in enumerate(ordered):
        n = ordered[(i + 1) % len(ordered)][1]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        for name, other in (("near_edited", e), ("near_next", n)):
            a, b = shingled(t), shingled(other)
            if len(a) > 4 and len(b) > 4:
                off.append(abs(found[d][name] - len(a & b) / len(a | b)))
    assert len(off) > 150 and max(off) <= 0.18 and sum(off) / len(off) < 0.02


def test_an_id_that_fills_many_ranges(spark):
    """A third of the rows share an id, with texts of their own: they go in order of text hash over several ranges, and none is lost."""
    rng = random.Random(9)
    rows = [cases.row(7, cases.prose(rng, 12)) for _ in range(150)] + [cases.row(i, cases.prose(rng, 12)) for i in range(300) if i != 7] + [cases.row(None, None)] * 3
    found = rows_of(fingerprint.against_next(cases.frame(spark, rows)))
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    assert sorted(r["fingerprint"] for r in found) == sorted(fingerprint.encode(fingerprint.sketches([(r[1] or "").encode()])[0]) for r in rows)


def test_sketch_estimates():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    a, b = " ".join(words[:3000]), " ".join(words[1000:])
    x, y = fingerprint.sketches([a.encode(), b.encode()])
    assert abs(fingerprint.resemblance(x, y) - 0.5) < 0.15
    assert abs(fingerprint.containment(x, y) - 2 / 3) < 0.2
    assert abs(fingerprint.distinct(x) / 2996 - 1) < 0.3
    both = kernel.shingles([a.encode(), b.encode()], 5)
    union = np.unique(np.concatenate(both) >> np.uint64(16))[: fingerprint.K]
    assert (fingerprint.merge(x, y) == union).all()
    assert (fingerprint.decode(fingerprint.encode(x)) == x).all() and fingerprint.encode(fingerprint.sketches([b""])[0]) == ""
    assert fingerprint.resemblance(x, x) == 1 and rng


def test_merged_fingerprints(spark):
    rows = cases.corpus(43, 60)
    prints = fingerprint.fingerprints(cases.frame(spark, rows)).join(cases.frame(spark, rows).select("doc_id", "source"), "doc_id")
    found = {r["source"]: r["fingerprint"] for r in rows_of(fingerprint.merged(prints.filter("fingerprint != ''"), ["source"]))}
    by = defaultdict(list)
    for _, t, _, source, *_ in rows:
        by[source] += list(fingerprint.sketches([(t or "").encode()])[0])
    assert found == {s: fingerprint.encode(np.unique(np.array(h, np.uint64))[: fingerprint.K]) for s, h in by.items()}


def test_fingerprints_of_odd_tables(spark):
    assert fingerprint.against_next(cases.empty(spark)).count() == 0
    assert fingerprint.against_next(cases.odd(spark)).count() == 7


# Packing


def ids_by(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def check_packing(rows, found, window=4096):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    texts = defaultdict(list)
    for d, t, *_ in rows:
        texts[d].append(t)
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(texts)
    for d, own in pieces.items():
        if len(texts[d]) > 1:
            continue
        ids, at = np.array(ids_by(tokenizer, texts[d][0]), "<u4"), 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    used = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        used += at
    assert len(sequences) == -(-used // window)  # no more sequences than the tokens need


def test_packing_is_whole_and_tight(spark):
    rows = cases.corpus(51, 200)
    check_packing(rows, rows_of(packing.pack(cases.frame(spark, rows), tokenizers.path("word_bpe_49k.json"))))


def test_packing_of_odd_tables(spark):
    path = tokenizers.path("word_bpe_49k.json")
    assert packing.pack(cases.empty(spark), path).count() == 0
    docs = cases.odd(spark)
    found = rows_of(packing.pack(docs, path, window=64, unit=4))
    check_packing([tuple(r) for r in docs.collect()], found, 64)
    assert sum(r["length"] for r in found if r["doc_id"] == 1) == 2 * found[[r["doc_id"] for r in found].index(1)]["doc_tokens"]


def encoded(encode, texts):
    ids, cut = encode([t.encode() for t in texts])
    return [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    tokenizer, encode = Tokenizer.from_file(path), packing.Encoder(path)
    texts = [r[1] or "" for r in cases.corpus(52, 80)] + ["ΣΑΣ Σ. İstanbul", "a\x1cb\x85c", "don't stop—now… (really?) 12,5% #1 a_b", "x" * 300, "漢字かな交じり文", "é ﬁ", "　wide space"]
    texts += ["a\0 a a\0\0 ab", "", " ", "exactly16letters exactly16letters, Exactly16letterx seventeen-letters x", "<|endoftext|> a<|startoftext|>b", "ab\u0338= ab=\u0338 e\u0301.", "क़, क़ ড়, שׁ, שׁ."]
    assert encoded(encode, texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded(encode, []) == [] and encoded(encode, ["", " \n"]) == [[], []]


def test_encoder_on_every_code_point():
    """Every code point alone, before and after letters, punctuation and marks."""
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    tokenizer, encode = Tokenizer.from_file(path), packing.Encoder(path)
    shapes = ["{}", "{},", "a{}", "{}b", "A{}.", "{}'s", "{}\u0301!", "ab{}c;"]
    points = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x1F000)]]
    texts = [" ".join(s.format(c) for c in points[i : i + 500]) for s in shapes for i in range(0, len(points), 500)]
    told = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoded(encode, texts) == told


def test_nnls():
    rng = np.random.default_rng(0)
    a, x = rng.random((20, 6)), np.array([0, 1.5, 0, 2, 0.25, 0])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-8)
    assert (packing.nnls(a, -np.ones(20)) == 0).all()
    assert all(sum(b * m for b, m in c.items()) == 8 for c in packing.combinations(8))


# Sharding


def test_hilbert_curve():
    """A curve visits every cell once, and each step moves one cell along one dimension."""
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    index = sharding.hilbert_index(cells, 3)
    assert sorted(index) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even(spark):
    rows = cases.corpus(61, 150)
    found = rows_of(sharding.shards(cases.frame(spark, rows)))
    texts = {r[0]: r[1] or "" for r in rows}
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    counts = Counter(r["shard"] for r in found)
    assert set(counts) <= set(range(40)) and max(counts.values()) - min(counts[s] for s in range(40)) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(counts[s]))
    for r in found:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    order = sorted(found, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in order)
    places = defaultdict(list)  # copies are neighbours
    for i, r in enumerate(order):
        places[texts[r["doc_id"]]].append(i)
    assert all(p[-1] - p[0] == len(p) - 1 for p in places.values())


def test_shards_of_odd_tables(spark, tmp_path):
    assert sharding.shards(cases.empty(spark)).count() == 0
    found = rows_of(sharding.shards(cases.odd(spark), 3))
    assert len(found) == 7 and sorted(Counter(r["shard"] for r in found).values()) == [2, 2, 3]
    docs = cases.odd(spark)
    sharding.write_shards(docs, f"file://{tmp_path}/odd", 3)
    kept = spark.read.parquet(f"file://{tmp_path}/odd").select(*docs.columns)
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))  # null and repeated ids, each row once


def test_shards_prune_files(spark, tmp_path):
    """Every row is written once, and the least and largest values of files rule most of them out in every dimension."""
    rng = random.Random(6)
    rows = [cases.row(i, f"{i:04d}" + "x" * int(2 ** rng.uniform(3, 12)), rng.choice("abcdefgh"), rng.choice("pqrstuvw")) for i in range(4000)]  # no copies: these share the least language of their group
    docs = cases.frame(spark, rows)
    sharding.write_shards(docs, f"file://{tmp_path}/shards", 64)
    files = defaultdict(list)
    for r in spark.read.parquet(f"file://{tmp_path}/shards").select("*", "_metadata.file_path").collect():
        files[r["file_path"]].append(r)
    assert sorted(r["doc_id"] for rs in files.values() for r in rs) == list(range(4000))
    for value in (lambda r: r["lang"], lambda r: r["source"], lambda r: len(r["text"])):
        wanted = [value(r) for r in rng.sample([r for rs in files.values() for r in rs], 40)]
        spans = [(min(map(value, rs)), max(map(value, rs))) for rs in files.values()]
        read = sum(a <= w <= b for w in wanted for a, b in spans) / len(wanted) / len(spans)
        assert read < 0.5, read  # at random nearly all files
