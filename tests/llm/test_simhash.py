"""SimHash groups against a plain restatement and all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from textloom.llm import simhash as S

KIND = "doc_id long, text string, fp string, node string, comp string, component_id string, m int, key string"


def plain_fingerprint(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    runs = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    hs = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(values, distance=3):
    """The least connected value of each, from all pairs."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def prose(r, n):
    return " ".join(r.choice(["Alpha", "beta", "ÉCOLE", "école", "x1", "O'Neil", "foo-bar", "naïve", "Zed", "die", "Straße"]) for _ in range(n))


def test_equals_all_pairs_on_texts(spark):
    r = random.Random(3)
    base = [prose(r, 200) for _ in range(12)]
    near = lambda t: " ".join(x if r.random() > 0.02 else "changed" for x in t.split())
    texts = [near(r.choice(base)) for _ in range(80)] + [None, "", " \n", "a", "a b", "A B", "a b c", prose(r, 150_000), base[0], base[0]]
    ids = [*range(1, len(texts) - 2), None, 3, 3]
    rows = list(zip(ids, texts, strict=True))
    got = S.groups(spark.createDataFrame([(*x, "", "", "", "", 0, "") for x in rows], KIND)).collect()
    fps = {t: plain_fingerprint(t) for _, t in rows}
    comp = plain_components(sorted(set(fps.values())))
    least = {}
    for i, t in rows:
        if i is not None:
            c = comp[fps[t]]
            least[c] = min(least.get(c, i), i)
    want = sorted(((i, fps[t], least.get(comp[fps[t]])) for i, t in rows), key=str)
    assert sorted(((x.doc_id, x.fp % (1 << 64), x.component_id) for x in got), key=str) == want
    assert len(set(least.values())) < len(set(fps.values()))


@pytest.mark.parametrize(("chunk", "partitions"), [(1024, 4), (8, 4), (5, 1), (3, 7)])
def test_index_equals_all_pairs_on_codes(spark, chunk, partitions):
    """Also where a node has many runs, and where partitions cut through it."""
    r = random.Random(chunk)
    codes = set()
    for _ in range(6):
        centre = r.getrandbits(64)
        for _ in range(60):
            codes.add(centre ^ sum(1 << b for b in r.sample(range(r.choice([12, 64])), r.randint(0, 6))))
    codes |= {r.getrandbits(64) for _ in range(60)} | {0, 1, 7, 15, (1 << 64) - 1, 1 << 63}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {x.node: x.comp for x in S.linked(spark.createDataFrame([(signed(c),) for c in codes], "fp long"), chunk=chunk).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    members = {}
    for v, c in plain_components(sorted(codes)).items():
        members.setdefault(c, []).append(signed(v))
    assert {v: got.get(v, v) for v in map(signed, codes)} == {v: min(vs) for vs in members.values() for v in vs}


def test_masks_catch_every_pair_near_enough():
    r = random.Random(1)
    cuts = [m % (1 << 64) for m in S.masks()]
    assert len(set(cuts)) == 16 and all(m.bit_count() == 28 for m in cuts)
    for _ in range(500):
        differing = sum(1 << b for b in r.sample(range(64), 3))
        assert any(differing & m == 0 for m in cuts)


def test_gray_order_and_back(spark):
    r = random.Random(2)
    signed = [r.getrandbits(64) - (1 << 63) for _ in range(50)] + [0, -1]
    ranks = [x.g for x in spark.createDataFrame([(v,) for v in signed], "fp long").select("fp", S.gray_rank(S.F.col("fp")).alias("g")).collect()]
    assert S.at_rank(np.array(ranks)).tolist() == signed
    row = S.at_rank(np.arange(-4, 4))
    assert np.bitwise_count((row[1:] ^ row[:-1]).view(np.uint64)).tolist() == [1] * 7


def test_majority_in_pieces(monkeypatch):
    r = np.random.default_rng(0)
    sizes = np.array([0, 3, 40, 1, 0, 7])
    values = r.integers(-(1 << 63), (1 << 63) - 1, sizes.sum())
    whole = S.majority(values, sizes)
    monkeypatch.setattr(S, "PIECE", 5)
    assert S.majority(values, sizes).tolist() == whole.tolist()
    at = np.cumsum(sizes) - sizes
    for k, n in enumerate(sizes):
        hs = [int(v) % (1 << 64) for v in values[at[k] : at[k] + n]]
        assert int(whole[k]) % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > n)


def test_empty_table(spark):
    assert S.groups(spark.createDataFrame([], KIND)).collect() == []
