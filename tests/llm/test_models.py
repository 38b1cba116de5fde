"""Language kernels and boosted trees against exact and naive forms, and that held-out rows teach nothing."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from textloom.llm import language_id as L
from textloom.llm import quality_model as M

WORDS = {"aa": ["kuro", "tama", "shiri", "moka"], "bb": ["gründ", "über", "schlat", "kern"], "cc": ["lopez", "niña", "calle", "verdo"]}


def cells(text):
    """Cells of all runs of one to three bytes."""
    b = [x + 32 * (65 <= x <= 90) for x in text.encode()]
    out = set()
    for i in range(len(b)):
        g = 0
        for j, x in enumerate(b[i : i + 3]):
            g = (g * 257 + x + 1) % (1 << 32) if j else x + 1
            out.add((g * 2654435761 % (1 << 32)) >> 18)
    return out


def kernel(a, b):
    return len(a & b) / math.sqrt(max(len(a), 1) * max(len(b), 1))


def language_rows(seed=0, n=90):
    r = random.Random(seed)
    return [(k, (lang := r.choice(sorted(WORDS))), " ".join(r.choice(WORDS[lang] if r.random() < 0.8 else WORDS[r.choice(sorted(WORDS))]) for _ in range(r.randrange(1, 12)))) for k in range(n)]


def test_language_scores_equal_exact_kernel_regression(spark):
    """With every training text as a landmark the map is exact: dual ridge regression on the whole kernel matrix says the same."""
    rows = language_rows()
    learned = {(lang, frozenset(cells(t))) for k, lang, t in rows if zlib.crc32(str(k).encode()) % 4 != 2}
    learned = sorted(learned, key=str)
    assert len(learned) <= L.LANDMARKS
    langs = sorted(WORDS)
    w = np.array([1 / sum(x[0] == y for x in learned) for y, _ in learned])
    k = np.array([[kernel(a, b) for _, b in learned] for _, a in learned])
    target = np.array([[1.0 if y == lang else -1.0 for lang in langs] for y, _ in learned])
    ridge = L.RIDGE * w.sum() / len(learned)
    dual = np.linalg.solve(k + ridge * np.diag(1 / w), target)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in L.identify(docs, L.train(docs)).collect()}
    right = 0
    for i, lang, text in rows:
        z = np.array([kernel(cells(text), b) for _, b in learned]) @ dual / L.HEAT
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i].score == pytest.approx(p.max(), abs=2e-3)
        if np.sort(p)[-1] - np.sort(p)[-2] > 0.01:
            assert got[i].lang_pred == langs[int(p.argmax())]
        right += got[i].held_out and got[i].lang_pred == lang
    assert right > 0.7 * sum(r.held_out for r in got.values())


def test_held_out_languages_teach_nothing(spark):
    rows = language_rows(3)
    held = [zlib.crc32(str(k).encode()) % 4 == 2 for k, _, _ in rows]
    flipped = [(k, "zz" if h else lang, t) for (k, lang, t), h in zip(rows, held, strict=True)]
    got = []
    for data in (rows, flipped):
        docs = spark.createDataFrame(data, "doc_id long, lang string, text string").coalesce(1)
        got.append([tuple(r) for r in L.identify(docs, L.train(docs)).orderBy("doc_id").collect()])
    assert got[0] == got[1] and [r[1] for r in got[0]] == held


def naive_fit(x, y, trees, depth, rate):
    """(base, trees of nested tuples): every threshold of every statistic is tried at every node, by loops over rows."""
    share = (sum(y) + 1) / (len(y) + 2)
    base = math.log(share / (1 - share))
    edges = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, M.BINS + 1)[1:-1]).tolist())) for f in range(x.shape[1])]
    margin, forest = [base] * len(y), []

    def grow(rows, grad, hess, level):
        if level == depth:
            value = -rate * sum(grad[i] for i in rows) / (sum(hess[i] for i in rows) + M.RIDGE)
            for i in rows:
                margin[i] += value
            return value
        part = lambda some: sum(grad[i] for i in some) ** 2 / (sum(hess[i] for i in some) + M.RIDGE)
        best = (1e-6, None, math.inf)
        for f, cuts in enumerate(edges):
            for c in cuts:
                left = [i for i in rows if x[i, f] <= c]
                right = [i for i in rows if x[i, f] > c]
                if min(len(left), len(right)) >= M.MIN_ROWS:
                    gain = part(left) + part(right) - part(rows)
                    if gain > best[0] + 1e-12:
                        best = (gain, f, c)
        _, f, c = best
        left = [i for i in rows if f is None or x[i, f] <= c]
        right = [i for i in rows if f is not None and x[i, f] > c]
        return (f, c, grow(left, grad, hess, level + 1), grow(right, grad, hess, level + 1))

    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        forest.append(grow(list(range(len(y))), [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p], 0))
    return base, forest


def walk(tree, row):
    while isinstance(tree, tuple):
        f, c, left, right = tree
        tree = left if f is None or row[f] <= c else right
    return tree


def test_trees_equal_naive_splits_and_walks():
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(140, 4)), 2)
    x[:, 3] = r.integers(0, 3, 140)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] == 1) ^ (r.random(140) < 0.1)).astype(float)
    fitted = M.fit(x, y, trees=5, depth=3, rate=0.3)
    base, forest = naive_fit(x, y, 5, 3, 0.3)
    for rows in (x, np.round(r.normal(size=(60, 4)), 2)):
        want = [1 / (1 + math.exp(-(base + sum(walk(t, row) for t in forest)))) for row in rows]
        assert fitted.scores(rows) == pytest.approx(want, abs=1e-9)
    assert len({round(v, 6) for v in fitted.scores(x)}) > 20


def plain_features(text):
    pieces = re.split(r"[ \t\n\x0b\f\r]", text)
    words = [w for w in pieces if w]
    n, chars, lines = max(len(words), 1), max(len(text), 1), text.split("\n")
    count = lambda some: sum(text.count(c) for c in some)
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, count("#*$%&|<>") / n, count("|") / n, count("!") / n, count(".,") / n, count("0123456789") / chars,
        sum(c.isupper() for c in text) / chars, len(lines) / n, (len(lines) - len(set(lines))) / len(lines), len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
    ]


def test_statistics_equal_plain_ones(spark):
    texts = ["", None, " \n", "One two two. #3!\nÉté | A\nOne two two. #3!", "x" * 5000, "a\tb\x0bc", "9,5 % of <b>THIS</b> & that\n\n\n"]
    rows, names = M.with_features(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"))
    for r in rows.collect():
        assert [r[n] for n in names] == pytest.approx(plain_features(texts[r.doc_id] or ""))


def test_held_out_labels_teach_nothing(spark):
    r = random.Random(8)
    docs, labels = [], []
    for k in range(160):
        good = r.random() < 0.5
        docs.append((k, " ".join(r.choice(["fine", "words", "here."] if good else ["BUY!!", "$$$", "now"]) for _ in range(30))))
        labels.append((k, int(good)))
    held = {k for k, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0}
    flipped = [(k, 1 - q if k in held else q) for k, q in labels]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = [[tuple(x) for x in M.score(table, M.train(table, spark.createDataFrame(q, "doc_id long, quality int"))).select("doc_id", "score", "predicted").orderBy("doc_id").collect()] for q in (labels, flipped)]
    assert got[0] == got[1]
    assert all(p == dict(labels)[k] for k, _, p in got[0] if k in held) and held
