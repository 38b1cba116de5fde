"""The registered session query: no capacity, and errors that can't be overlooked."""

import math

import pytest

from textloom.plans import analytics
from textloom.streaming import sessions as Z


@pytest.fixture
def chats(spark, tmp_path):
    spark.createDataFrame([(1, 0, "alice bob"), (1, 1, " carol dave")], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def test_no_capacity(spark, chats, monkeypatch):
    asked, replay = [], Z.replay
    monkeypatch.setattr(Z, "replay", lambda rows, labels, at, width, capacity: asked.append(capacity) or replay(rows, labels, at, width, capacity))
    assert [r.input_tokens for r in analytics.stream_sessions(spark, chats).orderBy("seq").collect()] == [7, 9]
    assert asked == [math.inf]


def test_a_chunk_that_is_left_out_fails_the_query(spark, chats, monkeypatch):
    replay = Z.replay
    monkeypatch.setattr(Z, "replay", lambda rows, labels, at, width, _: replay(rows, labels, at, width, 8))
    with pytest.raises(Exception, match="Overflow"):
        analytics.stream_sessions(spark, chats).collect()
