import json
import pickle
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from diglot.functions import glossary as gl
from diglot.plans import translate as tr
from diglot.plans.client import CallFailed, Chat, Echo, Reply, Spacing, Translator, Usage, pause, retry_after, transient
from diglot.sources import records


def chat(replies, **more):
    """A client whose endpoint gives these replies; and the bodies it was sent, and its pauses."""
    sent, waits, left = [], [], list(replies)

    def post(body):
        sent.append(body)
        return left.pop(0)

    return Chat("http://x", "k", post=post, sleep=waits.append, gap=0, **more), sent, waits


def ok(text, why="stop", **usage):
    return 200, {}, json.dumps(dict(usage=usage, choices=[dict(finish_reason=why, message=dict(content=text))]))


def test_retries_and_backoff():
    c, sent, waits = chat([(500, {}, "x"), (429, {"Retry-After": "7"}, "x"), ok("好", prompt_tokens=3, completion_tokens=2)])
    assert c.chat("p") == "好" and len(sent) == 3 and 2 <= waits[0] <= 2.5 and 7 <= waits[1] <= 8.75
    assert (c.usage.input, c.usage.output, c.usage.total, c.usage.calls) == (3, 2, 5, 1)


def test_lasting_errors_are_raised_at_once():
    c, sent, _ = chat([(401, {}, "no")])
    with pytest.raises(CallFailed):
        c.chat("p")
    assert len(sent) == 1


def test_odd_replies():
    c, sent, _ = chat([(200, {}, "<html>"), (200, {}, '{"error": {"code": 503}}'), ok("x")])
    assert c.chat("p") == "x" and len(sent) == 3
    c, sent, _ = chat([(200, {}, '{"error": {"code": "400"}}')])
    with pytest.raises(CallFailed):
        c.chat("p")
    c, sent, _ = chat([ok(None)])
    assert c.chat("p") == "" and len(sent) == 1


def test_cut_replies_get_double_room_once():
    c, sent, _ = chat([ok("短", "length"), ok("长一点", "length")])
    assert (reply := c.chat("p", 900)) == "长一点" and [b["max_tokens"] for b in sent] == [900, 1800] and reply.cut
    c, sent, _ = chat([ok("短", "length", prompt_tokens=3), ok("长一点", prompt_tokens=4)])
    assert (reply := c.chat("p", 900)) == "长一点" and not reply.cut and reply.counts == (7, 0, 7, 2)


def test_the_first_answer_stays_when_double_room_fails():
    c, sent, waits = chat([ok("短", "length"), (500, {}, "x")])
    assert (reply := c.chat("p")) == "短" and reply.cut and len(sent) == 2 and not waits


def test_calls_of_one_endpoint_keep_their_gap():
    c, _, waits = chat([ok("a"), ok("b", "length"), ok("bb"), ok("c")])
    c.gap, c.base = 5.0, "http://gap"
    first = pickle.loads(pickle.dumps(Chat("http://gap", "k", gap=5.0)))
    assert Chat("http://gap", "k", gap=5.0).spacing() is first.spacing() is not c.spacing()
    for _ in range(3):
        c.chat("p")
    assert len(waits) == 3 and all(4 < w <= 5 for w in waits)


class Refused(Translator):
    """Counts its calls in a folder; each is refused."""

    model = "refused"

    def __init__(self, folder, status=401):
        self.folder, self.status = folder, status

    def chat(self, prompt, max_tokens=4000):
        (self.folder / uuid.uuid4().hex).touch()
        raise CallFailed(f"status {self.status}", self.status)


def test_a_refused_key_ends_the_run_after_a_call_a_task(spark, tmp_path):
    blocks = spark.createDataFrame([("f", i, f"text number {i} " * 40, "x") for i in range(60)], "file string, n int, text string, visible string")
    with pytest.raises(CallFailed, match="401"):
        tr.translate(blocks, Refused(tmp_path), tasks=2)
    assert 1 <= len([*tmp_path.iterdir()]) <= 2


class Cut(Translator):
    model = "cut"

    def chat(self, prompt, max_tokens=4000):
        return Reply.of("1. 译文", cut="编号输出" in prompt, counts=(1, 2, 3, 1))


def test_cut_replies_are_used_but_not_kept(spark, tmp_path):
    blocks = spark.createDataFrame([("f", i, f"text number {i}", "x") for i in range(2)], "file string, n int, text string, visible string")
    done, fresh = tr.translate(blocks, Cut(), tasks=1, log=str(tmp_path / "log"))
    assert {r.n: r.translation for r in done.collect()} == {0: "译文", 1: "1. 译文"}
    assert sorted((r.cut, r.admitted, r.total) for r in fresh.collect()) == [(False, True, 3), (True, False, 3)]
    assert [r.response for r in records.open_cache(spark, str(tmp_path / "log")).collect()] == ["1. 译文"]


def test_the_log_is_compacted_when_it_is_opened(spark, tmp_path):
    log = str(tmp_path / "log")
    assert records.open_cache(spark, log).count() == 0
    for i in range(4):
        records.log_replies(log, [("k", f"v{i}"), (f"k{i}", "w")])
        time.sleep(0.02)
    before = {r.key: r.response for r in records.open_cache(spark, log, slack=3).collect()}
    assert len(before) == 5 and before["k"] == "v3" and spark.read.text(log).count() == 8
    assert {r.key: r.response for r in records.open_cache(spark, log, slack=2).collect()} == before and spark.read.text(log).count() == 5


def test_small_rules():
    assert retry_after("3") == 3 and retry_after("-3") == 0 and retry_after("nan") is None and retry_after("soon") is None and retry_after(None) is None
    assert retry_after("Wed, 21 Oct 2015 07:28:00 GMT", now=1445412470.0) == 10
    assert pause(0, None, 0) == 2 and pause(1, None, 1) == 5 and pause(0, 30, 0) == 30
    assert transient(TimeoutError()) and transient(CallFailed("x")) and not transient(CallFailed("x", 404)) and not transient(ValueError())
    now, waits = [0.0], []
    s = Spacing(1.0, lambda: now[0], waits.append)
    s.wait()
    now[0] = 0.25
    s.wait()
    assert waits == [0.75]


def test_usage_is_safe_between_threads():
    u = Usage()
    threads = [threading.Thread(target=lambda: [u.add({"input_tokens": 1, "output_tokens": 2}) for _ in range(500)]) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert (u.total, u.calls) == (6000, 2000) and u.line() == "calls=2000 input=2000 output=4000 total=6000"
    u.add({}), u.add(None), u.add({"prompt_tokens": 0})
    assert u.calls == 2000 and pickle.loads(pickle.dumps(u)) == u


class Odd(Translator):
    """No numbered reply before the reminder; item 2 only when it is alone; item 3 has an empty reply."""

    model = "odd"

    def chat(self, prompt, max_tokens=4000):
        if "项三" in prompt and "编号" not in prompt:
            return ""
        if "编号输出" not in prompt:
            return '"单独的译文 @@BT0@@"'
        return "1. 第一条 @@BT0@@" if "注意格式" in prompt else "对不起"


def test_fallbacks(spark):
    blocks = spark.createDataFrame([("f", 0, "alpha one", "alpha one"), ("f", 1, "alpha two", "alpha two"), ("f", 2, "项三 three", "x")], "file string, n int, text string, visible string")
    terms = spark.createDataFrame([(0, "alpha", "阿尔法", [])], gl.TERM)
    done, fresh = tr.translate(blocks, Odd(), terms, tasks=2)
    got = {r.n: r.translation for r in done.collect()}
    assert got == {0: "第一条 阿尔法", 1: "单独的译文 阿尔法", 2: "项三 three"}
    assert sorted(r.response for r in fresh.where("admitted").collect()) == ['"单独的译文 @@BT0@@"', "1. 第一条 @@BT0@@"]


def test_cached_replies_are_not_asked_again(spark):
    blocks = spark.createDataFrame([("f", i, f"text number {i}", "x") for i in range(30)], "file string, n int, text string, visible string")
    first, fresh = tr.translate(blocks, Echo(), tasks=2)

    class Silent(Echo):
        def chat(self, prompt, max_tokens=4000):
            raise AssertionError("asked")

    again, new = tr.translate(blocks, Silent(), cache=fresh.where("admitted"), tasks=2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect())) and new.count() == 0
    assert tr.accepted(again).count() == 30 and again.where(F.col("translation").startswith("译文：")).count() == 30


def test_a_translation_keeps_its_last_quote(spark):
    blocks = spark.createDataFrame([("f", i, t, t) for i, t in enumerate(['Of thndes inre token = "abc"', "Other text"])], "file string, n int, text string, visible string")
    done, _ = tr.translate(blocks, Echo(), tasks=2)
    assert {r.n: r.translation for r in done.collect()} == {0: '译文：Of thndes inre token = "', 1: "译文：Other text"}
    assert tr.translator_items(Echo(), "", ['Of thndes inre token = "abc"', "Other text"]) == ['译文：Of thndes inre token = "', "译文：Other text"]


class Recorder(Chat):
    """Numbers its replies and keeps what it was asked in the reply."""

    def __init__(self):
        super().__init__("http://x", "k")

    def chat(self, prompt, max_tokens=4000):
        n = prompt.count("EN: ")
        count = prompt.rpartition("\n\n")[2].count("\n") + 1
        return "\n".join(f"{i + 1}. 译文带有 {n} 对前文 {'@@BT0@@' if '@@BT0@@' in prompt else ''}" for i in range(count))


def test_context_goes_from_batch_to_batch(spark):
    blocks = spark.createDataFrame([("f", i, f"alpha text number {i}", "alpha") for i in range(30)] + [("g", 0, "other", "other")], "file string, n int, text string, visible string")
    terms = spark.createDataFrame([(0, "alpha", "阿尔法", [])], gl.TERM)
    got = {(r.file, r.n): r.translation for r in tr.translate_in_order(blocks, Recorder(), terms, 2).collect()}
    assert "0 对前文 阿尔法" in got["f", 0] and "2 对前文 阿尔法" in got["f", 12] and "2 对前文" in got["f", 29] and got["g", 0].strip() == "译文带有 0 对前文"


def test_stream_resumes(spark, tmp_path):
    from diglot.streaming.resume import latest_state, resume

    schema = "book string, dest string, text string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    work = lambda df: df.withColumn("landed", F.col("text") != "bad")
    go = lambda: resume(spark, str(tmp_path / "in"), schema, work, str(tmp_path / "data"), str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()
    put([("b", "x", "ok"), ("b", "y", "bad")])
    go()
    assert {r.dest: (r.attempts, r.done) for r in latest_state(spark, str(tmp_path / "state")).collect()} == {"x": (0, True), "y": (1, False)}
    for _ in range(3):
        put([("b", "x", "ok"), ("b", "y", "bad")])
        go()
    assert {r.dest: (r.attempts, r.done) for r in latest_state(spark, str(tmp_path / "state")).collect()} == {"x": (0, True), "y": (3, True)}
    worked = spark.read.parquet(str(tmp_path / "data"))
    assert worked.where("dest = 'x'").count() == 1 and worked.where("dest = 'y'").count() == 3
