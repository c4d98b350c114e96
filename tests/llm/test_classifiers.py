"""Language ID and toxicity, row by row against plain Python: n-grams, ratios, margins, losses, decoding, scores."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from paperlode.llm import language_id, ngrams, toxicity

MASK = (1 << 32) - 1


def gram_hash(gram):
    out = ord(gram[0]) * ngrams._MULTIPLIERS[0] & MASK
    for k in range(1, len(gram)):
        out ^= out >> 15
        out = (out * ngrams._MULTIPLIERS[k] + ord(gram[k])) & MASK
    out ^= out >> 16
    out = out * 0x7FEB352D & MASK
    out ^= out >> 15
    return (out + len(gram) * 0x632BE5AB) & MASK


def grams_of(text, orders):
    text = f" {(text or '').lower()} "
    return [gram_hash(text[i : i + n]) for n in orders for i in range(len(text) - n + 1)]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def predict(model, text):
    """Language, score and ambiguity by the definitions, one number at a time."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, False
    counts = Counter(h >> 20 for h in grams_of(text, language_id.ORDERS))
    length = math.sqrt(sum(counts.values()))
    x = {b: math.sqrt(c) / length for b, c in counts.items()}
    margins = [float(model.bias[j]) + sum(v * float(model.weights[b, j]) for b, v in x.items()) for j in range(model.code.shape[1])]
    losses = [sum(float(model.trust[c, j]) * math.log1p(math.exp(-max(-30, min(30, int(model.code[c, j]) * m)))) for j, m in enumerate(margins)) for c in range(len(model.languages))]
    near = [math.exp(min(losses) - v) for v in losses]
    order = sorted(range(len(near)), key=lambda c: -near[c])
    first = near[order[0]] / sum(near)
    second = near[order[1]] / sum(near) if len(near) > 1 else 0.0
    return model.languages[order[0]], first, second >= language_id.AMBIGUOUS_SHARE * (first + second)


def test_language_row_by_row(spark):
    random.seed(14)
    words = {"en": "the and ing tion of with", "de": "der die und ung schön mit", "fr": "le la été que pour où", "es": "el los año que para y"}
    rows = [(i, " ".join(random.choice(words[v].split()) for _ in range(random.randrange(1, 30))), v) for i in range(300) for v in [random.choice(list(words))]]
    rows += [(1000, None, "en"), (1001, "12 ?", "de"), (1002, "the der le el", None), (1003, "", "fr"), (1004, "Ünd THE İstanbul ΑΣ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.train_language_model(docs, most=60)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model, carry=["doc_id", "text"]).collect()}
    for i, text, _ in rows:
        name, score, ambiguous = predict(model, text)
        assert got[i]["lang_pred"] == name and got[i]["lang_score"] == pytest.approx(score, abs=1e-4) and got[i]["text"] == text
        assert got[i]["lang_ambiguous"] == ambiguous or abs(score - 0.6) < 1e-3
    # what is learned from: at most 60 texts a language, the smallest md5 of ids that aren't held out
    taught = [r for r in rows if not held_out(r[0]) and r[1] is not None and r[2]]
    first = lambda v: sorted((hashlib.md5(str(r[0]).encode()).hexdigest(), r[1]) for r in taught if r[2] == v)[:60]
    sample = [(v, h, t) for v in sorted(words) for h, t in first(v)]
    x = np.stack([v.astype(np.float16) for v in language_id.features([t for _, _, t in sample])]).astype(np.float32)
    again = language_id.fit_codes(x, [v for v, _, _ in sample])
    assert again.languages == model.languages and np.abs(again.weights - model.weights).max() < 1e-3


def test_language_blocks(monkeypatch):
    """Texts that are scored a few at a time get what they get alone, also where a block has one text."""
    texts = ["the cat sat", "le chat est là", "der hund ist da", "el gato es", "", "12 34", None, "the hund est"] * 5
    model = language_id.fit_codes(language_id.features(texts[:4] * 3), ["en", "fr", "de", "es"] * 3)
    texts = [t or "" for t in texts]
    alone = [model.predict([t])[0] for t in texts]
    for floats in (1, language_id.BUCKETS * 3, 1 << 21):
        monkeypatch.setattr(language_id, "FLOATS", floats)
        found = model.predict(texts)
        assert [(f[0], f[2]) for f in found] == [(a[0], a[2]) for a in alone]
        assert np.allclose([f[1] for f in found], [a[1] for a in alone], atol=1e-5)


def test_language_losses_never_vanish():
    model = language_id.CodeModel(["a", "b", "c"], language_id.codewords(3), np.zeros((language_id.BUCKETS, 3), np.float32), np.full(3, -30, np.float32), np.full((3, 3), 500, np.float32))
    (name, score, _), = model.predict(["some words"])
    assert name in "abc" and 0 < score <= 1


def test_language_fit_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_TEXTS", 40)
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 20)
    rows = [(i, f"word{i % 25} again{i % 25}", f"l{i % 25:02}") for i in range(1000)]
    seen = []
    monkeypatch.setattr(language_id, "fit_codes", lambda x, labels: seen.append(Counter(labels)) or "model")
    assert language_id.train_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string")) == "model"
    assert len(seen[0]) == 20 and set(seen[0].values()) == {2}


def test_pieces_of_long_texts(monkeypatch):
    random.seed(15)
    texts = ["".join(random.choice("abcdé XY") for _ in range(n)) for n in (0, 1, 3, 49, 50, 51, 55, 56, 200, 1003)]
    whole = language_id.features(texts)
    wanted = [sorted(grams_of(t, toxicity.ORDERS)) for t in texts]
    monkeypatch.setattr(ngrams, "PIECE", 50)
    assert np.array_equal(language_id.features(texts), whole)
    got = {i: [] for i in range(len(texts))}
    for owners, begins, hashes in ngrams.grams(texts, toxicity.ORDERS):
        for at, h in zip(begins, hashes, strict=True):
            for j, i in enumerate(owners.tolist()):
                got[i] += h[at[j] : at[j + 1]].tolist()
    assert [sorted(got[i]) for i in got] == wanted
    assert [i for i, _ in toxicity.distinct_grams(texts, lambda h: h)] == list(range(len(texts)))
    assert [sorted(set(w)) for w in wanted] == [g.tolist() for _, g in toxicity.distinct_grams(texts, lambda h: h)]


def g_statistic(p, n, n_pos, n_neg):
    total, seen = n_pos + n_neg, p + n
    cells = [(p, seen * n_pos / total), (n, seen * n_neg / total), (n_pos - p, (total - seen) * n_pos / total), (n_neg - n, (total - seen) * n_neg / total)]
    return 2 * sum(o * math.log(o / e) for o, e in cells if o > 0)


def test_toxicity_row_by_row(spark):
    random.seed(16)
    words, bits = ["stone", "river", "cloud", "table", "green"], 16
    rows, marks = [], []
    for i in range(260):
        toxic = int(random.random() < 0.4)
        w = [random.choice(words) for _ in range(random.randrange(2, 12))] + (["blorft"] if toxic and random.random() < 0.9 else [])
        rows.append((i, " ".join(w)))
        marks.append((i, toxic))
    rows += [(500, None), (501, ""), (502, "BLORFT İΣ " * 3)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, labels, bits=bits)
    texts = dict(rows)
    taught = sorted(((y, sorted(set(grams_of(texts[i], toxicity.ORDERS)))) for i, y in marks if not held_out(i)), key=lambda r: r[0])
    n_pos = sum(y for y, _ in taught)
    n_neg = len(taught) - n_pos

    def counted(of):
        counts = {}
        for y, grams in taught:
            for x in {of(h) for h in grams}:
                counts.setdefault(x, [0, 0])[y] += 1
        return counts

    tells = {x for x, (n, p) in counted(lambda h: h >> (32 - bits)).items() if g_statistic(p, n, n_pos, n_neg) >= toxicity.LEAST_G}
    exact = {h: c for h, c in counted(lambda h: h).items() if h >> (32 - bits) in tells}
    chosen = sorted(h for h, (n, p) in exact.items() if g_statistic(p, n, n_pos, n_neg) >= toxicity.LEAST_G)
    assert chosen == model.hashes.tolist() and chosen
    ratio = {h: math.log((exact[h][1] + 1) / (n_pos + 2)) - math.log((exact[h][0] + 1) / (n_neg + 2)) for h in chosen}
    # the fit, by the published Adam rule on the mean log loss with decay
    w, b = dict.fromkeys(chosen, 0.0), math.log(n_pos / n_neg)
    m, v, mb, vb = dict.fromkeys(chosen, 0.0), dict.fromkeys(chosen, 0.0), 0.0, 0.0
    own = [(y, [h for h in grams if h in ratio]) for y, grams in taught]
    for k in range(1, 301):
        g, gb = {h: 1e-5 * x for h, x in w.items()}, 0.0
        for y, grams in own:
            miss = (1 / (1 + math.exp(-(b + sum(w[h] * ratio[h] for h in grams)))) - y) / len(own)
            gb += miss
            for h in grams:
                g[h] += ratio[h] * miss
        fix = (1 - 0.999**k) ** 0.5 / (1 - 0.9**k)
        for h in chosen:
            m[h], v[h] = 0.9 * m[h] + 0.1 * g[h], 0.999 * v[h] + 0.001 * g[h] ** 2
            w[h] -= 0.005 * fix * m[h] / (v[h] ** 0.5 + 1e-10)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        b -= 0.025 * fix * mb / (vb**0.5 + 1e-10)
    got = {r["id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    for i, text in rows:
        score = 1 / (1 + math.exp(-(b + sum(w[h] * ratio[h] for h in set(grams_of(text, toxicity.ORDERS)) if h in ratio))))
        assert got[i]["score"] == pytest.approx(score, abs=1e-6) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)
