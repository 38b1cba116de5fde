"""Corpus operators on small tables: brute force, round trips, held-out accuracy, and awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import chat_format, decontaminate, language_id, mixing, near_dup, pii, quality_model, quality_rules, repeats, url_filter
from textloom.llm.common import without

KIND = "doc_id long, text string, lang string, source string, n_chars long, _words string, key string, node long, value string, bucket string"
VOCAB = ["the", "of", "and", *("".join(p) for p in itertools.product("bdfg", "aeiou", "lmn"))]


def prose(r, n):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def rows_of(texts, ids=None):
    """Rows with extra columns whose names clash with what operators add."""
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", len(t or ""), "x", "y", 1, "z", "b") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="module")
def awkward(spark):
    r = random.Random(1)
    base = prose(r, 60)
    texts = [None, "", " \n\t", base, base, base + " end", "a", "a", prose(r, 3000), "12 !? @ 7", "É" * 500, base]
    return spark.createDataFrame(rows_of(texts, [0, 1, 2, 3, 4, 5, 6, 6, 8, None, 10, 3]), KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def taught():
    return pii.trained([])


ITEMS = "item_id long, text string, win long"


def operators(spark):
    items = spark.createDataFrame([(1, prose(random.Random(9), 30), 0), (2, None, 0), (3, "a", 0), (3, "a", 0), (4, "", 0)], ITEMS)
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, None), (5, 1), (None, 1)], "doc_id long, quality int")
    return {
        "language_id": lambda d: language_id.identify(d, language_id.train(d)),
        "decontaminate": lambda d: decontaminate.contamination(d, items),
        "pii": lambda d: pii.redact(d, pii.Tagger()),
        "mixing": lambda d: mixing.taken(d),
        "near_dup": lambda d: near_dup.kept(d, 2),
        "repeats": lambda d: repeats.without_repeats(d),
        "quality_rules": lambda d: quality_rules.judge(d),
        "quality_model": lambda d: quality_model.score(d, quality_model.train(d, labels)),
    }


@pytest.mark.parametrize("name", ["language_id", "decontaminate", "pii", "mixing", "near_dup", "repeats", "quality_rules", "quality_model"])
def test_awkward_and_empty_tables(spark, awkward, empty, name):
    run = operators(spark)[name]
    got = run(awkward).collect()
    assert len(got) == awkward.count()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in awkward.select("doc_id").collect())
    assert run(empty).collect() == []


def test_without_keeps_nulls_and_repeats(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k long, v string")
    gone = spark.createDataFrame([(1,), (None,), (7,)], "k long")
    assert sorted(r.v for r in without(rows, gone, F.col("k")).collect()) == ["c", "d"]


# 1


def test_language_is_learned_without_held_out_rows(spark):
    r = random.Random(3)
    parts = {"aa": ["bal", "ka", "tor"], "bb": ["éme", "çu", "ois"], "cc": ["schu", "ung", "ßer"]}
    data = [(i, lang, " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(25))) for i in range(240) for lang in [r.choice(list(parts))]]
    docs = spark.createDataFrame([*data, (900, "aa", "12 34"), (901, None, "balkator kabal"), (902, "aa", None)], "doc_id long, lang string, text string")
    got = {x.doc_id: x for x in language_id.identify(docs, language_id.train(docs)).collect()}
    held = [d for d in data if zlib.crc32(str(d[0]).encode()) % 4 == 2]
    assert held and all(got[i].held_out and got[i].lang_pred == lang for i, lang, _ in held)
    assert all(0 <= x.score <= 1 for x in got.values())
    assert got[900].lang_pred == got[902].lang_pred == "und" and got[901].lang_pred == "aa"


def test_presence_is_of_whole_texts():
    texts = [b"abc" * 700_000 + b"xyz", b"", b"Q"]
    rows = language_id.presence(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]))
    tail = language_id.presence(np.frombuffer(b"xyz", np.uint8), np.array([3]))
    assert (rows[0] >= tail[0]).all() and rows[1].sum() == 0 and rows[2].sum() == 1


# 2


def windows_hit(doc, items, n=10):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = low(doc), set(), set()
    for item, text in items:
        q = low(text)
        k = min(n, len(q))
        for a in range(len(q) - k + 1 if q else 0):
            for b in range(len(w) - k + 1):
                if w[b : b + k] == q[a : a + k]:
                    hit |= set(range(b, b + k))
                    found.add(item)
    return len(w), len(hit), sorted(map(str, found))


def test_contamination_against_brute_force(spark):
    r = random.Random(5)
    items = [(i, prose(r, r.choice([1, 2, 4, 12, 25]))) for i in range(8)] + [(20, None), (21, "the of")]
    docs = []
    for i in range(50):
        t = prose(r, r.randrange(0, 60))
        if i % 3 == 0:
            t += " " + items[r.randrange(8)][1].upper() + ", " + prose(r, 5)
        docs.append((i, t))
    out = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    for x in out:
        assert (x.n_words, x.n_hit, x["items"]) == windows_hit(docs[x.doc_id][1], items)


def test_proximity_allows_slack(spark):
    item = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta x gamma delta"), (3, "alpha x x x beta gamma delta")], "doc_id long, text string")
    near = {x.doc_id: x.contaminated for x in decontaminate.contamination(docs, item, slack=1).collect()}
    exact = {x.doc_id: x.contaminated for x in decontaminate.contamination(docs, item).collect()}
    assert near == {1: True, 2: True, 3: False} and exact == {1: True, 2: False, 3: False}


# 3


def test_base_patterns_against_plain_regular_expressions():
    r = random.Random(11)
    pieces = ["a.b@c.de", "x@y", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+12", "a@b.c@d.ef", " ", ",", "é", "7", "-", "."]
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for _ in range(400):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(1, 9)))
        want = []
        for kind, pattern in plain.items():
            for m in re.finditer(pattern, text):
                d = re.sub("[^0-9]", "", m[0])
                luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
                ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]
                want += [(kind, *m.span())] * ok
        assert pii.base_spans(text) == want, text


def test_gradients_and_learning():
    t = pii.Tagger(1)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    ids, tags = pii.examples([], 4, 3)
    ids, tags = ids[:, :24], tags[:, :24]
    _, g = t.step(ids, tags)
    r = np.random.default_rng(0)
    for k in t.p:
        at = (int(ids[0, 5]), 2) if k == "embed" else (0, 1) if k == "move" else tuple(r.integers(0, n) for n in t.p[k].shape)
        old, loss = t.p[k][at], []
        for step in (1e-3, -1e-3):
            t.p[k][at] = old + step
            loss.append(t.step(ids, tags)[0])
        t.p[k][at] = old
        assert (loss[0] - loss[1]) / 2e-3 == pytest.approx(g[k][at], rel=2e-2, abs=1e-3)


def test_model_adds_spans_and_leaves_clean_text(spark, taught):
    tagger = taught
    r = random.Random(2)
    texts = [f"{prose(r, 30)} (555) 010-9999 {prose(r, 30)}", f"{prose(r, 20)} version 3.14 of 2019-03-04 {prose(r, 20)}", prose(r, 50), f"{prose(r, 40)} me@home.org and 10.1.2.3 {prose(r, 9)}"]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tagger).orderBy("doc_id").collect()
    kinds = [[(s.kind, s.base) for s in x.pii] for x in rows]
    assert kinds[0] == [("phone", False)] and kinds[2] == [] and kinds[1] == []
    assert ("email", True) in kinds[3] and ("ip", True) in kinds[3]
    masked = [x.text for x in pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tagger).orderBy("doc_id").collect()]
    assert "[PHONE]" in masked[0] and "[EMAIL] and [IP]" in masked[3] and masked[2] == texts[2]


def test_secrets_are_learned(taught):
    tagger, r = taught, random.Random(21)
    hexed = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    made = [lambda: ("password=", hexed(18), ""), lambda: ("", "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), ""), lambda: ('token = "', hexed(40), '"')]
    texts, want = [], []
    for i in range(60):
        before, secret, after = made[i % 3]()
        left = prose(r, r.randrange(5, 60)) + " " + before
        texts.append(left + secret + after + " " + prose(r, 30))
        want.append(("secret", len(left), len(left) + len(secret)))
    texts += [prose(r, 80) + " " + "".join(r.choice("abdegilmnou") for _ in range(24)) for _ in range(20)]
    got = pii.added(tagger, texts, [pii.base_spans(t) for t in texts])
    assert sum(g == [w] for g, w in zip(got, want, strict=False)) >= 57
    assert sum(map(len, got[60:])) <= 1


def test_decoding_against_all_sequences():
    t = pii.Tagger(3)
    e = np.random.default_rng(1).normal(size=(4, 2, pii.TAGS)).astype(np.float32) * 2
    tags, sure = t.decode(e)
    move = t.p["move"] + pii.BARRED
    for b in range(2):
        weight = {y: e[0, b, y[0]] + pii.BARRED[0, y[0]] + sum(move[y[i - 1], y[i]] + e[i, b, y[i]] for i in range(1, 4)) for y in itertools.product(range(pii.TAGS), repeat=4)}
        best = max(weight, key=weight.get)
        assert tuple(tags[b]) == best
        total = sum(math.exp(w) for w in weight.values())
        for i in range(4):
            assert sure[b, i] == pytest.approx(sum(math.exp(w) for y, w in weight.items() if y[i] == best[i]) / total, rel=1e-3)


def test_long_runs_are_decoded_as_one(taught):
    tagger = taught
    line = "call (555) 010-9999 or 12 people "
    text = line * 300
    (got,) = pii.added(tagger, [text], [[]])
    phones = {(a, z) for k, a, z in got if k == "phone"}
    assert sum((k * len(line) + 5, k * len(line) + 19) in phones for k in range(300)) >= 290


def test_snippets_are_different_and_bounded(spark):
    rows = [(i, "the same footer of 2019 " + "x" * 60) for i in range(300)] + [(1000 + i, f"text number {i} " + "y" * 80) for i in range(40)] + [(2000, None)]
    got = pii.snippets(spark.createDataFrame(rows, "doc_id long, text string"), 64)
    assert len(got) == len(set(got)) <= 64 and len(got) > 20


# 4


def test_mix_meets_targets(spark):
    r = random.Random(8)
    docs = [(i, r.choice(["a", "b", "c", None]), prose(r, r.randrange(0, 90))) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    one, two = (sorted(map(tuple, mixing.taken(df).collect()), key=str) for _ in range(2))
    assert one == two
    by = {}
    for _, source, size, source_size, target, taken in one:
        assert 0 <= taken <= 2 * size
        t = by.setdefault(source, [0, target, source_size])
        t[0] += taken
    assert all(abs(t - goal) <= 1 and goal <= 2 * size for t, goal, size in by.values())
    assert math.isclose(sum(goal for _, goal, _ in by.values()), 1.5 * sum(len(d[2].split()) for d in docs))


def test_slots_follow_blocks_however_different_sources_are(spark):
    goals = spark.createDataFrame([(0, 1, 1.0), (1, 1_200_000, 1_799_999.0), (2, 900, 1800.0), (3, 0, 0.0)], "sid int, source_size long, target double")
    slots = mixing.schedule(goals).collect()
    blocks = {0: 1, 1: 9375 + 4688, 2: 16}
    assert len(slots) == sum(blocks.values()) and len({s.slot for s in slots}) == len(slots)
    for sid, size, target in ((0, 1, 1), (1, 1_200_000, 1_799_999), (2, 900, 1800)):
        own = sorted((s.rank, s.block, s["take"]) for s in slots if s.sid == sid)
        assert [r for r, _, _ in own] == list(range(blocks[sid])) and sum(t for _, _, t in own) == target
        assert all(b == r % -(-size // 128) for r, b, _ in own)
    big = [s.sid == 2 for s in sorted(slots) if s.slot < 14_000]
    assert all(sum(big[a : a + 7000]) >= 6 for a in range(0, len(big) - 7000, 1000))


def test_many_sources_and_equal_ids(spark):
    r = random.Random(5)
    docs = [(r.choice([None, 1, i]), f"s{i % 700}", prose(r, r.randrange(1, 5))) for i in range(2100)]
    got = mixing.taken(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()
    assert len(got) == len(docs)
    by = {}
    for x in got:
        assert 0 <= x.taken <= 2 * x.size
        by.setdefault(x.source, [0, x.target])[0] += x.taken
    assert len(by) == 700 and all(abs(t - goal) <= 0.5001 for t, goal in by.values())


# 5


def test_rules_and_language_models(spark):
    urls = [None, "", "no scheme", "http://A.Net/x", "http://www.example.net/en/1", "http://x.example.com/de/?q", "https://a.org/fr/z#t", "https://net", "ftp://b.net?x"]
    r = random.Random(4)
    good = [f"https://{r.choice(['wiki', 'docs', 'blog'])}.example.net/en/{r.randrange(99)}" for _ in range(60)]
    bad = [f"http://{r.choice(['pills', 'casino', 'spam'])}.net/buy{r.randrange(99)}" for _ in range(60)]
    pages = [*enumerate(urls + good + bad), (500, "https://wiki.example.xyz/en/12"), (501, "http://casino.xyz/buy7"), (501, "http://casino.xyz/buy7")]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()
    assert len(got) == len(pages)
    by = {x.page_id: x for x in got}
    assert [(by[i].host, by[i].path, by[i].rule) for i in range(9)] == [("", "", None), ("", "", None), ("", "", None), ("a.net", "/x", "net/"), ("www.example.net", "/en/1", "example.net/en/"), ("x.example.com", "/de/", "example.com/de/"), ("a.org", "/fr/z", "org/fr/"), ("net", "", None), ("b.net", "", None)]
    assert by[500].verdict == "allow" and by[501].verdict == "block"
    alone = url_filter.judge(spark.createDataFrame([(1, "http://x.yz/")], "page_id long, url string")).first()
    assert alone.verdict == "allow"
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_scores_against_a_plain_restatement(spark):
    ruled = [("http://a.b/cc", "allow"), ("http://a.b/cd", "allow"), ("http://zz.q/9", "block"), ("HTTP://zz.q/97?x=%20", "block")]
    ratios = url_filter.model(spark.createDataFrame(ruled, "url string, verdict string"))
    size, order = url_filter.SIZE, url_filter.ORDER

    def numbers(url):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), url or "")
        return [size - 1] * (order - 1) + [url_filter.PRINTED.find(c) + 1 for c in low] + [size - 2]

    counts = {x: {} for x in ("allow", "block")}
    for url, v in ruled:
        s = numbers(url)
        for i in range(order - 1, len(s)):
            for k in range(1, order + 1):
                counts[v][tuple(s[i - k + 1 : i + 1])] = counts[v].get(tuple(s[i - k + 1 : i + 1]), 0) + 1

    def p(v, g):
        total = sum(n for h, n in counts[v].items() if len(h) == len(g) and h[:-1] == g[:-1])
        if len(g) == 1:
            return (counts[v].get(g, 0) + 1) / (total + size)
        return (counts[v].get(g, 0) + url_filter.ALPHA * p(v, g[1:])) / (total + url_filter.ALPHA)

    seen = set(counts["allow"]) | set(counts["block"])
    assert {r.order * size**order + r.g for r in ratios.where("ratio IS NOT NULL").collect()} == {len(g) * size**order + sum(x * size**i for i, x in enumerate(reversed(g))) for g in seen}
    context = tuple(numbers("a")[:order])[1:]
    for v in counts:  # in any context the probabilities of all symbols sum to 1
        assert sum(p(v, (*context, x)) for x in range(size)) == pytest.approx(1)
    urls = [u for u, _ in ruled] + [None, "", "http://a.b/zq", "new things", "é~", "http://a.b/cc"]
    got = url_filter.scored(spark.createDataFrame(list(enumerate(urls)), "id long, url string"), ratios).collect()
    assert len(got) == len(urls)
    for x in got:
        s = numbers(x.url)
        each = [math.log(p("allow", tuple(s[i - order + 1 : i + 1])) / p("block", tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s))]
        assert x.score == pytest.approx(sum(each) / len(each))


def test_threshold_is_equally_far_from_both(spark):
    scores = [("allow", 1.0), ("allow", 3.0), ("block", -4.0), ("block", -2.0), ("block", -3.0)]
    cut = url_filter.threshold(spark.createDataFrame(scores, "verdict string, score double"))
    a, b = np.array([1.0, 3.0]), np.array([-4.0, -2.0, -3.0])
    assert (a.mean() - cut) / a.std() == pytest.approx((cut - b.mean()) / b.std())
    assert url_filter.threshold(spark.createDataFrame([("allow", 1.0), ("block", 0.0)], "verdict string, score double")) == 0.5
    assert url_filter.threshold(spark.createDataFrame([("allow", 1.0)], "verdict string, score double")) == 0.0


# 6


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "\\l<s>", "[/INST", "a\\b[INST]", "", None, "<s><s>\\\\", "[INST]\n</s>"]
    rows = [(c, t, ["user", "assistant", "assistant", None, "tool</s>"][(t * 7 + c) % 5], odd[(t + c) % 9]) for c in range(6) for t in range(12)]
    rows += [(99, t, "user", "x") for t in range(600)] + [(None, None, "user", "y")]
    back = chat_format.read_back(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert len(back) == 8
    for x in back:
        own = sorted((r for r in rows if r[0] == x.conv_id), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in x.turns] == [(r[2] or "", r[3] or "") for r in own]
        assert x.loss_text == "".join(r[3] or "" for r in own if r[2] == "assistant")
    assert chat_format.digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


# 7


def shingles(text, k):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("k", [2, 5])
def test_groups_against_all_pairs(spark, k):
    r = random.Random(k)
    texts = []
    for _ in range(12):
        base = [r.choice(VOCAB) + str(r.randrange(30)) for _ in range(r.choice([1, 3, 12, 80, 150]))]
        for _ in range(r.choice([1, 2, 9])):
            w = list(base)
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = r.choice(VOCAB)
            texts.append(" ".join(w))
    base = [r.choice(VOCAB) + str(i) for i in range(120)]  # a list longer than SHORT
    for _ in range(90):
        w = list(base)
        for _ in range(6):
            w[r.randrange(len(w))] = r.choice(VOCAB)
        texts.append(" ".join(w))
    texts += [None, "", "The OF", "the of"]
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        c = len(sets[i] & sets[j])
        if c and 100 * c >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    got = {x.doc_id: x for x in near_dup.kept(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k).collect()}
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find(i), find(i) == i)


# 8


def test_repeats_against_all_windows(spark):
    r = random.Random(6)
    shared = [prose(r, 40) for _ in range(3)]
    texts = [prose(r, r.randrange(0, 50)) + (r.choice(shared)[: r.randrange(90, 180)] if i % 2 else "") + prose(r, 10) for i in range(40)]
    texts += [texts[3], "a" * 350, "a" * 99, "é" * 120, None, "xy" * 200 + prose(r, 30) + "xy" * 90]
    seen, want = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want.append((len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest(), kept))
    got = repeats.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256, bytes(x.kept)) for x in got] == want


def test_deep_shallow_order():
    r = random.Random(0)
    data = "".join(r.choice("ab") * r.choice([1, 1, 40]) for _ in range(120)).encode()
    at = np.arange(len(data) - 99)
    order = repeats.sorted_windows(data, at)
    flat = [int(i) for same in order for i in same]
    assert sorted(flat) == list(range(len(at)))
    assert [data[i : i + 100] for i in flat] == sorted(data[i : i + 100] for i in range(len(at)))
    assert len(order) == len({data[i : i + 100] for i in range(len(at))})


def test_long_texts_are_cut_with_overlap(monkeypatch):
    monkeypatch.setattr(repeats, "UNIT", 250)
    pieces = [p for unit in repeats._units(np.array([1000, 1050, 1300])) for p in unit]
    covered = {(k, i) for k, a, z in pieces for i in range(a, z - 99)}
    assert covered == {(0, i) for i in range(901)} | {(2, i) for i in range(151)}


# 9


def test_order_of_rules_changes_no_verdict(spark, awkward):
    rules = quality_rules.base_rules() + quality_rules.method_rules()
    stats = quality_rules.statistics(awkward)
    one = [r.failed_rule is None for r in quality_rules.cascade(stats, rules).orderBy("doc_id", "text").collect()]
    two = [r.failed_rule is None for r in quality_rules.cascade(stats, rules[::-1]).orderBy("doc_id", "text").collect()]
    assert one == two
    found = {"a": (1.0, 0.1), "b": (0.1, 0.1), "c": (1.0, 0.9)}
    assert [r.name for r in quality_rules.ordered([quality_rules.Rule(n, F.lit(True)) for n in "abc"], found)] == ["b", "c", "a"]


def test_clean_prose_is_kept_and_junk_goes(spark):
    r = random.Random(1)
    names = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    clean = " ".join(r.choice(names) for _ in range(120))
    junk = ["short text", " ".join(w + "***" for w in clean.split()), clean.upper(), "\n".join(["same line again and again here now"] * 30), " ".join(["w"] * 90)]
    out = quality_rules.judge(spark.createDataFrame(list(enumerate([clean, *junk])), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [x.kept for x in out] == [True, *[False] * len(junk)]


# 10


def test_trees_learn_and_walk():
    r = np.random.default_rng(0)
    x = r.random((1500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    forest = quality_model.fit(x[:1000], y[:1000])
    assert ((forest.scores(x[1000:]) > 0.5) == y[1000:]).mean() > 0.97
    assert forest.scores(x[:0]).shape == (0,)
    one = quality_model.fit(x[:10], np.ones(10))
    assert np.allclose(one.scores(x[:3]), 11 / 12)
