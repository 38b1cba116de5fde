"""Personal data: fixed base patterns, and a character BiLSTM with CRF transitions.

The model is trained in numpy, on the driver, from labelled spans: snippets of the corpus
that the base patterns label, and the same snippets with generated personal data written
into them in forms that the patterns don't know (``(555) 010-9999``, ``me [at] home.org``),
with secrets (values of passwords, tokens and keys, which no base pattern has) or with
look-alikes that are none (dates, versions, long words). It reads texts in overlapping
windows around everything that personal data and secrets can't do without (a digit, "@", a
bracketed "at", a long run of letters and digits); each character takes its emissions from
the window in whose middle it lies, and one Viterbi pass runs over all windows that touch, so
that spans are put together over the text and not window by window. Spans that the model
adds must not touch a base span.

Defined cases: a null text is empty and has no spans; repeated rows are judged alike; null
ids are carried along; very long texts are read whole, window by window; spans that begin at
one place are ordered by end; empty tables give no rows (the model is then trained on generated
text alone); extra columns are not used by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

BASE_KINDS = ("email", "ip", "card", "phone")
#: What the model tells apart: the base kinds in further forms, and secrets (keys, tokens, passwords).
KINDS = (*BASE_KINDS, "secret")
#: Base patterns; no start within a digit run can match where the run's first digit doesn't. Fixed values.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What personal data and secrets can't do without; the same for Java and Python.
TRIGGER = r"[0-9@]|[\[(] ?at ?[\])]|[A-Za-z0-9+/_-]{16}"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALNUM = UPPER + UPPER.lower() + "0123456789"
#: Runs that may be a secret.
UNSURE = re.compile(r"[A-Za-z0-9+/_-]{12,}")
#: Tags: none, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
CHARS, EMBED, HIDDEN = 98, 12, 20
#: A window, and the part in its middle whose tags count.
WIDE, CORE = 96, 32
#: Cores of a run that are decoded together, and those of its neighbours on either side.
RUN, LAP = 64, 4
#: Of the corpus the model is trained on: snippets, and characters of each.
SNIPPETS, SNIPPET = 1500, 72
STEPS, BATCH, SURE = 400, 48, 0.9
#: Characters of texts that are decoded together; a longer text is alone.
TOGETHER = 1 << 20


def _luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed, then start. Linear in the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        host = DOMAIN.match(text, at + 1) if start < at else None
        if host:
            out.append(("email", start, host.end()))
            last = host.end()
        at = text.find("@", max(at + 1, last))
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for kind, pattern, least, most in (("card", CARD, 16, 19), ("phone", PHONE, 8, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == "phone" or _luhn(digits)):
                out.append((kind, *m.span()))
    return out


def numbers(text: str) -> np.ndarray:
    """Characters as numbers: 0 is padding, printable ASCII has one each, other ASCII 96, all else 97."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(c > 126, 97, np.where(c < 32, 96, c - 31)).astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


#: Tag sequences that can't be: an inside tag follows its own begin or inside only.
BARRED = np.zeros((TAGS, TAGS), np.float32)
for _k in range(len(KINDS)):
    BARRED[[t for t in range(TAGS) if t not in (1 + 2 * _k, 2 + 2 * _k)], 2 + 2 * _k] = -1e4


class Tagger:
    """Embedding, one LSTM in each direction, a linear layer and CRF transitions. Arrays are time x batch x width."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        n = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"embed": n(CHARS, EMBED) * 3, "out": n(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            gate = np.zeros(4 * HIDDEN, np.float32)
            gate[HIDDEN : 2 * HIDDEN] = 1  # remember at first
            self.p |= {f"{d}x": n(EMBED, 4 * HIDDEN), f"{d}h": n(HIDDEN, 4 * HIDDEN), f"{d}b": gate}

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states in the order of ``x``; what the way back needs."""
        p, H = self.p, HIDDEN
        given = x @ p[f"{d}x"] + p[f"{d}b"]
        h = c = np.zeros((x.shape[1], H), np.float32)
        out, kept = np.zeros((*x.shape[:2], H), np.float32), [None] * len(x)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = given[t] + h @ p[f"{d}h"]
            s = _sigmoid(z[:, : 3 * H])
            g = np.tanh(z[:, 3 * H :])
            new = s[:, H : 2 * H] * c + s[:, :H] * g
            q = np.tanh(new)
            if keep:
                kept[t] = (s, g, c, q, h)
            h, c = s[:, 2 * H :] * q, new
            out[t] = h
        return out, kept

    def emissions(self, ids: np.ndarray, keep: bool = False):
        x = self.p["embed"][ids.T]
        (f, fk), (b, bk) = self._run(x, "f", keep), self._run(x, "b", keep)
        both = np.concatenate([f, b], 2)
        return both @ self.p["out"] + self.p["bias"], (x, both, fk, bk)

    def _forward_backward(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        move = self.p["move"] + BARRED
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[0] = e[0] + BARRED[0]  # a window begins as if after no span
        for t in range(1, len(e)):
            a[t] = _lse(a[t - 1][:, :, None] + move, 1) + e[t]
        for t in range(len(e) - 2, -1, -1):
            b[t] = _lse(move + (e[t + 1] + b[t + 1])[:, None, :], 2)
        return a, b, _lse(a[-1], 1)

    def step(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of a batch, and its gradients."""
        e, (x, both, fk, bk) = self.emissions(ids, True)
        T, B, _ = e.shape
        H, y, move, rows = HIDDEN, tags.T, self.p["move"] + BARRED, np.arange(B)
        a, b, z = self._forward_backward(e)
        gold = e[np.arange(T)[:, None], rows, y].sum(0) + move[y[:-1], y[1:]].sum(0)
        de = np.exp(a + b - z[:, None])
        g = {"move": np.zeros_like(move)}
        for t in range(1, T):
            g["move"] += np.exp(a[t - 1][:, :, None] + move + (e[t] + b[t])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(g["move"], (y[:-1].ravel(), y[1:].ravel()), -1)
        de[np.arange(T)[:, None], rows, y] -= 1
        de /= B
        g["move"] /= B
        g |= {"out": np.einsum("tbh,tbk->hk", both, de), "bias": de.sum((0, 1))}
        dboth = de @ self.p["out"].T
        dx = np.zeros_like(x)
        for d, kept, dout in (("f", fk, dboth[..., :H]), ("b", bk, dboth[..., H:])):
            dz = np.zeros((T, B, 4 * H), np.float32)
            dh, dc, gh = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32), np.zeros_like(self.p[f"{d}h"])
            for t in range(T - 1, -1, -1) if d == "f" else range(T):
                s, gg, c, q, before = kept[t]
                i, f, o = s[:, :H], s[:, H : 2 * H], s[:, 2 * H :]
                dh = dh + dout[t]
                dc = dc + dh * o * (1 - q * q)
                dz[t] = np.concatenate([dc * gg * i * (1 - i), dc * c * f * (1 - f), dh * q * o * (1 - o), dc * i * (1 - gg * gg)], 1)
                gh += before.T @ dz[t]
                dh, dc = dz[t] @ self.p[f"{d}h"].T, dc * f
            g |= {f"{d}h": gh, f"{d}x": np.einsum("tbe,tbz->ez", x, dz), f"{d}b": dz.sum((0, 1))}
            dx += dz @ self.p[f"{d}x"].T
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], ids.T, dx)
        return float((z - gold).mean()), g

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int = STEPS, rate: float = 0.02, seed: int = 0) -> float:
        """Adam over seeded batches; the last loss."""
        r, loss = np.random.default_rng(seed), 0.0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for n in range(1, steps + 1):
            pick = r.integers(0, len(ids), BATCH)
            loss, g = self.step(ids[pick], tags[pick])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            now = rate * min(1, 2 * (1 - n / (steps + 1)))
            for k in self.p:
                x = g[k] * min(1, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-6)).astype(np.float32)
        return loss

    def decode(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag sequence for emissions (time x batch x tags), as batch x time, and the probability of each of its tags."""
        move = self.p["move"] + BARRED
        score, back = e[0] + BARRED[0], np.zeros(e.shape, np.int8)
        for t in range(1, len(e)):
            step = score[:, :, None] + move
            back[t] = step.argmax(1)
            score = step.max(1) + e[t]
        rows = np.arange(e.shape[1])
        tags = np.zeros(e.shape[1::-1], np.int64)
        tags[:, -1] = score.argmax(1)
        for t in range(len(e) - 1, 0, -1):
            tags[:, t - 1] = back[t][rows, tags[:, t]]
        a, b, z = self._forward_backward(e)
        p = np.exp(a + b - z[:, None]).transpose(1, 0, 2)
        return tags, np.take_along_axis(p, tags[:, :, None], 2)[:, :, 0]


def _written(r: np.random.Generator) -> tuple[str, str, str, str | None]:
    """What stands before it, something that looks like personal data, what stands after it, and its kind (None: it is none)."""
    d = lambda n: "".join(str(x) for x in r.integers(0, 10, n))
    w = lambda: "".join(chr(97 + x) for x in r.integers(0, 26, r.integers(3, 9)))
    site = f"{w()}.{r.choice(['com', 'org', 'net', 'example.com'])}"
    octets = ".".join(str(x) for x in r.integers(0, 256, 4))
    some = lambda letters, n: "".join(r.choice(list(letters), n))
    if r.random() < 0.3:  # a secret: only its value, after a name that tells or with a shape of its own
        name = str(r.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_token", "client_secret", "Password", "TOKEN"]))
        between = str(r.choice(["=", " = ", ": ", ":", '="', ' = "', ': "', "='", " "]))
        end = '"' if '"' in between else "'" if "'" in between else ""
        value = (r.bytes(int(r.integers(6, 22))).hex(), some(ALNUM, int(r.integers(12, 40))))[r.integers(0, 2)]
        shape = int(r.integers(0, 5))
        if shape == 0:
            return "", str(r.choice(["AKIA", "ASIA"])) + some(UPPER + "234567", 16), "", "secret"
        if shape == 1:
            return "", str(r.choice(["ghp_", "sk_live_", "sk-", "xoxb-", "glpat-"])) + some(ALNUM, int(r.integers(20, 40))), "", "secret"
        return name + between, value, end, "secret"
    made = (
        (f"({d(3)}) {d(3)}-{d(4)}", "phone"), (f"{d(3)}-{d(3)}-{d(4)}", "phone"), (f"{d(3)}.{d(3)}.{d(4)}", "phone"), (f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", "phone"),
        (f"{w()}@{site}", "email"), (f"{w()}.{w()}{d(2)}@{site}", "email"), (f"{w()} [at] {site}", "email"), (f"{w()}(at){site}", "email"), (f"{w()} @ {site}", "email"),
        (octets, "ip"), (" ".join(d(4) for _ in range(4)), "card"), ("-".join(d(4) for _ in range(4)), "card"), ("4" + d(15), "card"),
        (f"{r.integers(1, 29)}/{r.integers(1, 13)}/{r.integers(1900, 2030)}", None), (f"{r.integers(1900, 2030)}-0{r.integers(1, 9)}-{r.integers(10, 29)}", None), (f"v{r.integers(0, 20)}.{r.integers(0, 20)}.{r.integers(0, 20)}", None),
        (d(int(r.integers(1, 8))), None), (f"${r.integers(1, 999)}.{d(2)}", None), (f"{r.integers(0, 24)}:{d(2)}", None), (w() + w() + w() + w(), None), (f"{w()}-{w()}-{w()}-{w()}", None),
        (f"{w()}{w()}{w()}{w()}".upper(), None), (f"{w()}_{w()}={d(2)}", None), (r.bytes(4).hex(), None), (f"password {w()}", None), (f"@{w()}", None), (f"[{r.integers(1, 99)}]", None),
    )
    what, kind = made[r.integers(0, len(made))]
    return "", what, "", kind


def examples(snippets: list[str], n: int = 4000, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Character numbers and tags of labelled windows: snippets as the base patterns label them, and with things written in."""
    r = np.random.default_rng(seed)
    gone = re.compile(rf"\S*[0-9@]\S*|{UNSURE.pattern}")
    plain = [gone.sub("", s) for s in snippets] or [" ".join("".join(chr(97 + x) for x in r.integers(0, 26, r.integers(1, 9))) for _ in range(10)) for _ in range(99)]
    # what base patterns don't name may be a secret or not: such pieces are no examples of either
    known = [s for s in snippets if not any(re.search("[0-9]|^[A-Z]*$", m[0]) and not any(a < m.end() and m.start() < z for _, a, z in base_spans(s)) for m in UNSURE.finditer(s))]
    ids, tags = np.zeros((n, SNIPPET), np.int64), np.zeros((n, SNIPPET), np.int64)
    for row in range(n):
        if known and row % 3 == 0:
            text = known[row // 3 % len(known)][:SNIPPET]
            spans = base_spans(text)
        else:
            around, (before, what, after, kind) = plain[r.integers(0, len(plain))], _written(r)
            words = around.split(" ")
            at = int(r.integers(0, len(words) + 1))
            left = " ".join(words[:at])[-int(r.integers(1, SNIPPET)) :]
            left += " " * bool(left) + before
            text = (left + what + after + r.choice([" ", ". ", ", ", "\n"]) + " ".join(words[at:]))[:SNIPPET]
            spans = [(kind, len(left), min(len(left) + len(what), len(text)))] if kind and len(left) < len(text) else []
        c = numbers(text)
        ids[row, : len(c)] = c
        for kind, a, z in reversed(spans):
            tags[row, a] = 1 + 2 * KINDS.index(kind)
            tags[row, a + 1 : z] = 2 + 2 * KINDS.index(kind)
    return ids, tags


def trained(snippets: list[str], seed: int = 0) -> Tagger:
    tagger = Tagger(seed)
    tagger.fit(*examples(snippets, seed=seed), seed=seed)
    return tagger


def snippets(docs: DataFrame, most: int = SNIPPETS) -> list[str]:
    """Up to ``most`` different pieces of text around triggers: of each of so many parts of all hashes the piece with the least. Every row is looked at."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                end = 0
                for m in re.finditer(TRIGGER, text):
                    if m.start() >= end:
                        a = max(0, m.start() - hash(m.start()) % (SNIPPET // 2))
                        end = a + SNIPPET
                        out.append(text[a:end])
            yield pd.DataFrame({"piece": pd.Series(out, dtype=object)})

    pieces = docs.select("text").where(F.col("text").rlike(TRIGGER)).mapInPandas(cut, "piece string")
    # partial results hold ``most`` pieces at most, and so does what is gathered
    pieces = pieces.groupBy(F.pmod(F.xxhash64("piece"), F.lit(most)).alias("part")).agg(F.min_by("piece", F.xxhash64(F.lit(1), "piece")).alias("piece"))
    return sorted(r["piece"] for r in pieces.collect())


def added(tagger: Tagger, texts: list[str], base: list[list], chunk: int = 2048) -> list[list[tuple[str, int, int]]]:
    """Spans that the model adds to each text; about ``TOGETHER`` characters are held as numbers at a time."""
    out, first, size = [], 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= TOGETHER or k == len(texts) - 1:
            out += _added(tagger, texts[first : k + 1], base[first : k + 1], chunk)
            first, size = k + 1, 0
    return out


def _added(tagger: Tagger, texts: list[str], base: list[list], chunk: int) -> list[list[tuple[str, int, int]]]:
    triggers = re.compile(TRIGGER)
    coded, jobs = [numbers(t) for t in texts], []
    for k, text in enumerate(texts):
        cores = {m.start() // CORE + j for m in triggers.finditer(text) for j in (-1, 0, 1)}
        jobs += [(k, c) for c in sorted(cores) if 0 <= c * CORE < len(text)]
    tags = [np.zeros(len(c), np.int8) for c in coded]
    sure = [np.zeros(len(c), np.float32) for c in coded]
    side = (WIDE - CORE) // 2
    middle = np.zeros((len(jobs), CORE, TAGS), np.float32)
    for a in range(0, len(jobs), chunk):
        part = jobs[a : a + chunk]
        ids = np.zeros((len(part), WIDE), np.int64)
        for row, (k, c) in enumerate(part):
            first = c * CORE - side
            piece = coded[k][max(first, 0) : first + WIDE]
            ids[row, max(-first, 0) : max(-first, 0) + len(piece)] = piece
        e, _ = tagger.emissions(ids)
        middle[a : a + chunk] = e[side : side + CORE].transpose(1, 0, 2)
    # cores that touch are decoded as one; very long runs in parts that share LAP cores, of which each part's own count
    runs, first = [], 0
    for j in range(1, len(jobs) + 1):
        if j == len(jobs) or jobs[j] != (jobs[j - 1][0], jobs[j - 1][1] + 1):
            runs += [(max(first, x - LAP), min(j, x + RUN + LAP), x, min(j, x + RUN)) for x in range(first, j, RUN)]
            first = j
    runs.sort(key=lambda x: (x[1] - x[0], x))
    at = 0
    while at < len(runs):
        z = at + 1
        while z < len(runs) and runs[z][1] - runs[z][0] == runs[at][1] - runs[at][0] and (z - at) * (runs[z][1] - runs[z][0]) < chunk:
            z += 1
        e = np.stack([middle[lo:hi].reshape(-1, TAGS) for lo, hi, _, _ in runs[at:z]], 1)
        found, p = tagger.decode(e)
        for row, (lo, _, x, y) in enumerate(runs[at:z]):
            k, c = jobs[x]
            n = min((y - x) * CORE, len(coded[k]) - c * CORE)
            own = slice((x - lo) * CORE, (x - lo) * CORE + n)
            tags[k][c * CORE : c * CORE + n] = found[row, own]
            sure[k][c * CORE : c * CORE + n] = p[row, own]
        at = z
    out = []
    for k, text in enumerate(texts):
        spans, t = [], tags[k]
        for a in np.flatnonzero(t % 2 == 1):
            z = a + 1
            while z < len(t) and t[z] == t[a] + 1:
                z += 1
            free = all(z <= s or a >= e for _, s, e in base[k])
            card = KINDS[t[a] // 2] == "card"
            if free and sure[k][a:z].mean() >= SURE and triggers.search(text, a, z) and z - a > 5 and (not card or _luhn(re.sub("[^0-9]", "", text[a:z]))):
                spans.append((KINDS[t[a] // 2], int(a), int(z)))
        out.append(spans)
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1:])))


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """``docs`` with ``pii``: spans in code points, base or added, by kind as listed, then start."""

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        own = [t or "" for t in texts]
        base = [base_spans(t) for t in own]
        more = added(tagger, own, base)
        order = lambda s: (KINDS.index(s[0]), s[1:])
        return pd.Series([[dict(kind=k, start=a, end=z, base=b) for k, a, z, b in sorted([(*s, True) for s in x] + [(*s, False) for s in y], key=order)] for x, y in zip(base, more, strict=True)])

    # texts without any trigger have no spans and needn't go to Python
    return docs.withColumn("pii", spans.asNondeterministic()(F.when(F.col("text").rlike(TRIGGER), F.col("text"))))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; touching spans become one, named by the first."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        own = list(texts)
        base = [base_spans(t or "") for t in own]
        more = added(tagger, [t or "" for t in own], base)
        return pd.Series([None if t is None else mask(t, x + y) for t, x, y in zip(own, base, more, strict=True)], dtype=object)

    some = F.col("text").rlike(TRIGGER)
    changed = masked.asNondeterministic()(F.when(some, F.col("text")))
    (new,) = fresh(docs.columns, "_masked")
    return docs.withColumn(new, changed).withColumn("text", F.when(some, F.col(new)).otherwise(F.col("text"))).drop(new)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, end = [], 0
    for kind, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, z)
    return "".join([*out, text[end:]])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = find(docs, trained(snippets(docs)))
    base = F.filter("pii", lambda s: s["base"])
    of = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return rows.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"))
