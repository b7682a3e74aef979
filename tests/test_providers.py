"""Calls of a provider: how many at once, in which order, and what happens when they fail."""

import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from graphweave.plans.providers import CannedProvider, OfflineProvider, ask, calls_at_once, in_order, keeping, payloads


class Sleeper:
    """Says how many of its calls were in flight at most so far in this process."""

    name = "sleeper"

    def __init__(self, seconds=0.05):
        self.seconds, self.now, self.most = seconds, 0, 0
        self.lock = None

    def __getstate__(self):
        return {"seconds": self.seconds, "now": 0, "most": 0, "lock": None}

    def complete(self, task, prompt):
        global LOCK
        with LOCK:
            self.now += 1
            self.most = max(self.most, self.now)
        # Later prompts answer first.
        time.sleep(self.seconds * (1 + (7 - int(prompt) % 8) / 8))
        with LOCK:
            self.now -= 1
            return f"{prompt} {self.most}"


LOCK = threading.Lock()


def prompts(spark, n, parts=1):
    return spark.range(n).repartition(parts, "id").sortWithinPartitions("id") if parts > 1 else spark.range(0, n, 1, 1)


def test_a_window_of_calls_in_input_order(spark):
    cores = spark.sparkContext.defaultParallelism
    df = ask(prompts(spark, 60), Sleeper(), F.lit("t"), F.col("id").cast("string"), parallel=6 * cores)
    rows = df.collect()
    assert [r["id"] for r in rows] == list(range(60)) and all(r["response"].split()[0] == str(r["id"]) for r in rows)
    assert max(int(r["response"].split()[1]) for r in rows) == 6


def test_no_prompt_is_moved(spark):
    for parallel in (1, 3, 4, 64, None):
        df = ask(spark.range(0, 100, 1, 7), OfflineProvider(), F.lit("t"), F.col("id").cast("string"), parallel=parallel)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "ArrowEvalPython" in plan, plan
    assert calls_at_once(8, 3) == (3, 1) and calls_at_once(8, 8) == (None, 1) and calls_at_once(8, 50) == (None, 6) and calls_at_once(8, None) == (None, 1)


def test_fewer_calls_than_cores(spark):
    """Then there are as many tasks as calls."""
    df = ask(spark.range(0, 40, 1, 9), OfflineProvider(), F.lit("t"), F.col("id").cast("string"), parallel=2)
    assert df.select(F.spark_partition_id()).distinct().count() == 2


@pytest.mark.parametrize(("window", "n"), [(1, 0), (1, 5), (3, 1), (3, 50), (64, 20)])
def test_in_order(window, n):
    lock, state = threading.Lock(), {"now": 0, "most": 0}

    def call(i):
        with lock:
            state["now"] += 1
            state["most"] = max(state["most"], state["now"])
        time.sleep(0.002 * (i % 3))
        with lock:
            state["now"] -= 1
        return str(i)

    assert list(in_order((lambda i=i: call(i) for i in range(n)), window)) == [str(i) for i in range(n)]
    assert state["most"] <= window


def test_the_first_error_in_order_is_raised_and_the_rest_dropped():
    began = []

    def call(i):
        began.append(i)
        time.sleep(0.05 if i == 2 else 0.01)
        if i in (2, 3):
            raise OSError(str(i))
        return str(i)

    got = []
    with pytest.raises(OSError, match="2"):
        for x in in_order((lambda i=i: call(i) for i in range(1000)), 4):
            got.append(x)
    assert got == ["0", "1"] and len(began) < 20


class Breaking:
    """Streams; fails twice on every prompt, in the middle of its answer."""

    name = "breaking"

    def __init__(self):
        self.turns = {}

    def complete(self, task, prompt):
        return "whole"

    def stream(self, task, prompt):
        self.turns[prompt] = self.turns.get(prompt, 0) + 1
        yield "a" + prompt
        if self.turns[prompt] < 3:
            raise OSError
        yield "b"


def test_pieces_are_joined_and_broken_answers_asked_for_again(spark):
    df = prompts(spark, 5).select(F.col("id").cast("string").alias("p"))
    got = ask(df, Breaking(), F.lit("t"), F.col("p"), retries=2, wait=0.001, stream=True, parallel=16).collect()
    assert [r["response"] for r in got] == [f"a{i}b" for i in range(5)]
    assert {r["response"] for r in ask(df, Breaking(), F.lit("t"), F.col("p")).collect()} == {"whole"}
    assert {r["response"] for r in ask(df, OfflineProvider(), F.lit("local_query_answer"), F.col("p"), stream=True).collect()} == {OfflineProvider().complete("local_query_answer", "")}
    instead = ask(df, Breaking(), F.lit("t"), F.col("p"), retries=1, wait=0.001, stream=True, strict=False, instead="none").collect()
    assert {r["response"] for r in instead} == {"none"}
    with pytest.raises(Exception, match="OSError"):
        ask(df, Breaking(), F.lit("t"), F.col("p"), retries=1, wait=0.001, stream=True).collect()


def test_every_call_is_kept(spark):
    df = prompts(spark, 3).select(F.col("id").cast("string").alias("p"))
    with keeping() as kept:
        a = ask(df, CannedProvider({"x": "said"}), F.lit("x"), F.col("p"))
        b = ask(df.limit(1), OfflineProvider(), F.lit("y"), F.concat("p", F.lit("!")), "other")
    assert a.columns == ["p", "response"] and b.columns == ["p", "other"]
    rows = payloads(kept).orderBy("task", "prompt").collect()
    assert [(r["task"], r["prompt"], r["prompt_length"], r["provider"]) for r in rows] == [("x", str(i), 1, "canned") for i in range(3)] + [("y", "0!", 2, "offline")]
    assert rows[0]["response"] == "said" and rows[0]["response_length"] == 4 and re.match(r"\d{4}-\d\d-\d\dT", rows[0]["timestamp"])
    with keeping(False) as kept:
        ask(df, OfflineProvider(), F.lit("x"), F.col("p"))
    assert payloads(kept) is None
