"""Sessions: text that grows chunk by chunk, from which entities or classes are asked.

``Session`` holds what an extraction session knows: text, word offsets, span scores.
``append`` scores the spans that a chunk can change and returns the entities of all text so
far. ``ClassSession`` holds text alone and scores all of it against the labels that come
with a question, which may be others each time. The same classes run in a stream
(``stream``, ``stream_classes``: one state per key, rows in order of ``seq``) and over a table
(``replay``, ``replay_classes``); one key's rows are one after another in either.

In a stream the state is kept in parts that grow: a list of chunks, a list of word offsets, a
map of span scores. A row adds to the lists, and of the map only the spans that it scored
are written; what was there before stays untouched.

A chunk that would not fit leaves the session as it was and is reported; a scorer that
fails closes the session; an explicit close event or a time without rows frees it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: word pattern, with ASCII word characters.
WORD = re.compile(r"\w+(?:[-_]\w+)*|[^ \t\n\x0B\f\r]", re.ASCII)

ScoreFn = Callable[[str, str], float]


def hash_score(label: str, surface: str) -> float:
    return int.from_bytes(hashlib.md5(f"{label}|{surface}".encode()).digest()[:3]) / 16777215.0


def candidate_spans(past: int, added: int, width: int, right: int) -> list[tuple[int, int]]:
    """Spans (first, last word, inclusive) to score when ``added`` words follow ``past``: those that end in new words, and those that end within ``right`` words of the last."""
    if not added:
        return []
    total = past + added
    least_end = min(past, max(0, total - 1 - right))
    first = max(0, least_end - (width - 1))
    return [(s, e) for s in range(first, total) for e in range(max(s, least_end), min(total, s + width))]


class Closed(RuntimeError):
    pass


class Overflow(RuntimeError):
    pass


@dataclass
class Session:
    labels: tuple[str, ...]
    width: int = 12
    right: int | None = None
    capacity: float = 4096
    prompt_tokens: int | None = None
    text: str = ""
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    scores: dict[tuple[int, int], list[float]] = field(default_factory=dict)
    tokens: int = 0
    failure: str | None = None
    #: A threshold and, of the spans in ``scores``, those with a score above it, as a choice meets them.
    above: tuple[float | None, dict[tuple[int, int], list[tuple]]] = field(default_factory=lambda: (None, {}))
    #: Chunks, words and spans since the last ``written``.
    news: tuple[list[str], int, set[tuple[int, int]]] = field(default_factory=lambda: ([], 0, set()))

    def __post_init__(self):
        if not self.labels:
            raise ValueError("a session needs labels")
        if self.right is None:
            self.right = self.width
        if self.prompt_tokens is None:
            self.prompt_tokens = 2 * len(self.labels) + 1

    def append(self, chunk: str | None, threshold: float, score: ScoreFn = hash_score) -> list[tuple]:
        """Entities (label, text, p, start, end) of all text after ``chunk``; null or empty text changes nothing."""
        if self.failure:
            raise Closed(self.failure)
        if not chunk:
            return self.snapshot(threshold)
        words = [m.span() for m in WORD.finditer(chunk)]
        chunks, added, spans = self.news
        if not words:
            self.text += chunk
            chunks.append(chunk)
            return self.snapshot(threshold)
        used = self.tokens or self.prompt_tokens
        if used + len(words) > self.capacity:
            raise Overflow(f"{used} + {len(words)} tokens exceed {self.capacity}")
        past, offset = len(self.starts), len(self.text)
        self.tokens = used + len(words)
        self.text += chunk
        self.news = ([*chunks, chunk], added + len(words), spans)
        self.starts += [offset + a for a, _ in words]
        self.ends += [offset + z for _, z in words]
        try:
            for s, e in candidate_spans(past, len(words), self.width, self.right):
                piece = self.text[self.starts[s] : self.ends[e]]
                self.scores[s, e] = [score(label, piece) for label in self.labels]
                spans.add((s, e))
                self._hold(s, e)
        except Exception as x:
            self.failure = f"{type(x).__name__}: {x}"
            raise
        return self.snapshot(threshold)

    def snapshot(self, threshold: float) -> list[tuple]:
        """Greedy choice over word ranges; only scores strictly above the threshold count, all labels compete."""
        if self.above[0] != threshold:
            self.above = (threshold, {})
            for s, e in self.scores:
                self._hold(s, e)
        taken, kept = set(), []
        for p, s, e, k in sorted(x for found in self.above[1].values() for x in found):
            if taken.isdisjoint(range(s, e + 1)):
                taken.update(range(s, e + 1))
                kept.append((s, e, k, -p))
        return [(self.labels[k], self.text[self.starts[s] : self.ends[e]], p, self.starts[s], self.ends[e]) for s, e, k, p in sorted(kept)]

    def _hold(self, s: int, e: int) -> None:
        """Keeps what a scored span has above the threshold of the last question, so that a chunk goes over its own spans alone."""
        at, held = self.above
        if at is None:
            return
        found = [(-p, s, e, k) for k, p in enumerate(self.scores[s, e]) if p > at]
        if found:
            held[s, e] = found
        else:
            held.pop((s, e), None)

    def close(self) -> None:
        self.failure = self.failure or "the session is closed"
        self.scores.clear()
        self.above = (None, {})

    def written(self) -> tuple[list[str], list[tuple[int, int]], list[tuple[int, int]]]:
        """New chunks, offsets of new words, and spans scored since the last call."""
        chunks, added, spans = self.news
        self.news = ([], 0, set())
        first = len(self.starts) - added
        return chunks, list(zip(self.starts[first:], self.ends[first:], strict=True)), sorted(spans)


@dataclass
class ClassSession:
    """Text that grows; a question scores all of it against the question's own labels."""

    capacity: float = math.inf
    text: str = ""
    tokens: int = 0
    failure: str | None = None
    news: list[str] = field(default_factory=list)

    def append(self, chunk: str | None) -> None:
        """Null or empty text changes nothing; words count as tokens."""
        if self.failure:
            raise Closed(self.failure)
        if chunk:
            added = sum(1 for _ in WORD.finditer(chunk))
            if self.tokens + added > self.capacity:
                raise Overflow(f"{self.tokens} + {added} tokens exceed {self.capacity}")
            self.text += chunk
            self.tokens += added
            self.news.append(chunk)

    def classify(self, labels: Sequence[str], threshold: float, single: bool = False, score: ScoreFn = hash_score, scale: float = 4.0) -> list[tuple[str, float]]:
        """(label, p), most probable first: labels that reach the threshold, or all with shares of 1; nothing without labels."""
        if self.failure:
            raise Closed(self.failure)
        try:
            raw = [scale * score(label, self.text) for label in labels]
        except Exception as x:
            self.failure = f"{type(x).__name__}: {x}"
            raise
        if single and raw:
            powers = [math.exp(v - max(raw)) for v in raw]
            found = [v / sum(powers) for v in powers]
        else:
            found = [1 / (1 + math.exp(-v)) for v in raw]
        ranked = sorted(zip(labels, found, strict=True), key=lambda x: -x[1])
        return [x for x in ranked if single or x[1] >= threshold]

    def close(self) -> None:
        self.failure = self.failure or "the session is closed"


OUT = "session_id string, seq long, entities array<struct<type:string,text:string,confidence:float,start:int,end:int>>, input_tokens int, error string"


def _row(key: str, seq: int, session: Session, chunk: str | None, threshold: float, score: ScoreFn) -> dict:
    found, error = [], None
    try:
        found = session.append(chunk, threshold, score)
    except Exception as x:  # reported in the row; what it does to the session is the session's matter
        error = f"{type(x).__name__}: {x}"
    spans = [dict(type=t, text=w, confidence=p, start=a, end=z) for t, w, p, a, z in found]
    return {"session_id": key, "seq": seq, "entities": spans, "input_tokens": session.tokens, "error": error}


def replay(chunks: DataFrame, labels: tuple[str, ...], threshold: float, width: int = 12, capacity: float = 4096, score: ScoreFn = hash_score) -> DataFrame:
    """A row per chunk of (session_id, seq, chunk): the session's entities after it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        session = Session(labels, width, capacity=capacity)
        rows = pdf.sort_values("seq", kind="stable")
        return pd.DataFrame([_row(k, q, session, c, threshold, score) for k, q, c in zip(rows.session_id, rows.seq, rows.chunk, strict=True)])

    return chunks.select("session_id", "seq", "chunk").groupBy("session_id").applyInPandas(run, OUT)


CLASSES = "session_id string, seq long, classes array<struct<label:string,p:double>>, tokens int, error string"


def _answer(key: str, seq: int, session: ClassSession, chunk: str | None, labels, threshold: float, single: bool, score: ScoreFn) -> dict:
    """What a row gets: it adds its chunk, then asks for its labels; without labels (null) it only adds."""
    found, error = None, None
    try:
        session.append(chunk)
        found = None if labels is None else [{"label": x, "p": p} for x, p in session.classify(list(labels), threshold, single, score)]
    except Exception as x:  # as in ``_row``
        error = f"{type(x).__name__}: {x}"
    return {"session_id": key, "seq": seq, "classes": found, "tokens": session.tokens, "error": error}


def replay_classes(rows: DataFrame, threshold: float, single: bool = False, capacity: float = math.inf, score: ScoreFn = hash_score) -> DataFrame:
    """A row per row of (session_id, seq, chunk, labels): the classes of its session's text, if it asks for labels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        session = ClassSession(capacity)
        pdf = pdf.sort_values("seq", kind="stable")
        return pd.DataFrame([_answer(k, q, session, c, x, threshold, single, score) for k, q, c, x in zip(pdf.session_id, pdf.seq, pdf.chunk, pdf.labels, strict=True)])

    return rows.select("session_id", "seq", "chunk", "labels").groupBy("session_id").applyInPandas(run, CLASSES)


class Keyed(StatefulProcessor):
    """What sessions in a stream share: rows in order of ``seq``, late rows, closing, and a timer.

    A null ``seq`` closes the session; a seq that isn't above the last one is reported and its
    row left out. Subclasses say what their states are, and how a session is read, fed and written.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "tokens int, last long, failure string")
        self.chunks = handle.getListState("chunks", "chunk string")
        self.states = [self.head, self.chunks, *self.more(handle)]

    def more(self, handle: StatefulProcessorHandle) -> list:
        return []

    def clear(self) -> None:
        for state in self.states:
            state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tokens, last, failure = self.head.get() if self.head.exists() else (0, None, None)
        last = -math.inf if last is None else last
        session = self.read(tokens, failure, self.head.exists())
        out, closed = [], False
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable", na_position="last")
        for row in frame.itertuples(index=False):
            if pd.isna(row.seq):
                closed = True
            elif row.seq <= last:
                out.append(self.late(key[0], int(row.seq), session))
            else:
                out.append(self.feed(key[0], int(row.seq), session, row))
                last = row.seq
        if closed:
            self.clear()
        elif last > -math.inf:
            self.head.update((session.tokens, int(last), session.failure))
            self.write(session)
            if self.idle_ms:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clear()
        return iter(())

    def close(self) -> None:
        pass


LATE = "LateChunk: a later chunk came first"


class SpanProcessor(Keyed):
    """One extraction session per key: chunks, word offsets, and the scores of each span."""

    def __init__(self, labels: tuple[str, ...], threshold: float, width: int, capacity: float, score: ScoreFn, idle_ms: int):
        super().__init__(idle_ms)
        self.args = (labels, threshold, width, capacity, score)

    def more(self, handle: StatefulProcessorHandle) -> list:
        self.words = handle.getListState("words", "start int, end int")
        self.spans = handle.getMapState("spans", "first int, last int", "scores array<double>")
        return [self.words, self.spans]

    def read(self, tokens: int, failure: str | None, there: bool) -> Session:
        labels, _, width, capacity, _ = self.args
        session = Session(labels, width, capacity=capacity, tokens=tokens, failure=failure)
        if there:
            session.text = "".join(c for (c,) in self.chunks.get()) if self.chunks.exists() else ""
            for a, z in self.words.get() if self.words.exists() else ():
                session.starts.append(a)
                session.ends.append(z)
            session.scores = {(s, e): list(v) for (s, e), (v,) in self.spans.iterator()} if self.spans.exists() else {}
        return session

    def feed(self, key: str, seq: int, session: Session, row) -> dict:
        _, threshold, _, _, score = self.args
        return _row(key, seq, session, row.chunk, threshold, score)

    def late(self, key: str, seq: int, session: Session) -> dict:
        return {"session_id": key, "seq": seq, "entities": [], "input_tokens": session.tokens, "error": LATE}

    def write(self, session: Session) -> None:
        chunks, words, spans = session.written()
        if chunks:
            self.chunks.appendList([(c,) for c in chunks])
        if words:
            self.words.appendList(words)
        for span in spans:
            self.spans.updateValue(span, (session.scores[span],))


class ClassProcessor(Keyed):
    """One classification session per key: its chunks."""

    def __init__(self, threshold: float, single: bool, capacity: float, score: ScoreFn, idle_ms: int):
        super().__init__(idle_ms)
        self.args = (threshold, single, capacity, score)

    def read(self, tokens: int, failure: str | None, there: bool) -> ClassSession:
        text = "".join(c for (c,) in self.chunks.get()) if there and self.chunks.exists() else ""
        return ClassSession(self.args[2], text, tokens, failure)

    def feed(self, key: str, seq: int, session: ClassSession, row) -> dict:
        threshold, single, _, score = self.args
        return _answer(key, seq, session, row.chunk, row.labels, threshold, single, score)

    def late(self, key: str, seq: int, session: ClassSession) -> dict:
        return {"session_id": key, "seq": seq, "classes": None, "tokens": session.tokens, "error": LATE}

    def write(self, session: ClassSession) -> None:
        if session.news:
            self.chunks.appendList([(c,) for c in session.news])


def stream(chunks: DataFrame, labels: tuple[str, ...], threshold: float, width: int = 12, capacity: float = 4096, score: ScoreFn = hash_score, idle_ms: int = 0) -> DataFrame:
    """``chunks`` (session_id, seq, chunk) as a stream. The session's state store must be RocksDB."""
    processor = SpanProcessor(labels, threshold, width, capacity, score, idle_ms)
    mode = "ProcessingTime" if idle_ms else "None"
    return chunks.select("session_id", "seq", "chunk").groupBy("session_id").transformWithStateInPandas(processor, OUT, "Update", mode)


def stream_classes(rows: DataFrame, threshold: float, single: bool = False, capacity: float = math.inf, score: ScoreFn = hash_score, idle_ms: int = 0) -> DataFrame:
    """``replay_classes`` of ``rows`` (session_id, seq, chunk, labels) as a stream: chunks and questions are events of one key."""
    processor = ClassProcessor(threshold, single, capacity, score, idle_ms)
    mode = "ProcessingTime" if idle_ms else "None"
    return rows.select("session_id", "seq", "chunk", "labels").groupBy("session_id").transformWithStateInPandas(processor, CLASSES, "Update", mode)
