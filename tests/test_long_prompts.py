"""Local prompts of any length: their lines are rows, and a provider that reads gets them piece by piece."""

from dataclasses import replace

from pyspark.sql import functions as F

from graphweave.plans import modes, prompts, providers
from graphweave.plans.providers import OfflineProvider, Spool, lines_of

from .test_hubs import N, asked, hub  # noqa: F401


class Reader:
    """Fails at its first try of a prompt, when it has read some of it."""

    name = "reader"

    def __init__(self):
        self.tried = False

    def read(self, task, pieces):
        shown, titles = [], []
        for line in lines_of(pieces):
            if not self.tried:
                self.tried = True
                raise OSError("broken off")
            (shown if line.startswith("- ") else titles).append(line)
        relations = [x for x in shown if " -R-> " in x]
        return f"{len(shown)};{relations == sorted(relations)};{'|'.join(titles)}"


def test_a_reading_provider_gets_more_than_a_string_may_hold(spark, hub, monkeypatch):  # noqa: F811
    monkeypatch.setattr(modes, "LISTED", N // 4)
    got = modes.query(hub, asked(spark), "local", top_k=1, provider=Reader()).answers.first().answer
    assert got == f"{3 * N + 2};True;Answer the question from these data only.|Question: hub|{'|'.join(prompts.LOCAL)}"
    assert modes.query(hub, asked(spark), "local", top_k=1).answers.first().answer.startswith("Offline mock answer")
    assert len(modes.source_ids(modes.query(hub, asked(spark), "local", top_k=1).details, "local").first().source_ids) == N + 2


def test_lists_are_in_order_and_empty_ones_say_so(spark, monkeypatch):
    class Echo:
        name = "echo"

        def complete(self, task, prompt):
            return f"{task}>{prompt}"

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "q long, x string")
    lines = spark.range(3000).select(F.lit(1).cast("long").alias("q"), (F.col("id") % 2 * 2).cast("int").alias("section"), F.format_string("%06d", 3000 - F.col("id")).alias("k1"), F.lit("").alias("k2"), F.lit("").alias("k3"), F.format_string("line %d", 3000 - F.col("id")).alias("line"))
    with providers.keeping() as kept:
        got = providers.ask_lists(rows, lines, "q", Echo(), F.concat(F.lit("t"), "x"), F.col("x"), ("A:", "B:", "C:"), F.lit("end"), parallel=2)
        got = {r.q: r.response for r in got.collect()}
    part = lambda start: "\n".join(f"- line {i}" for i in range(start, 3001, 2))
    assert got[1] == f"ta>a\nA:\n{part(2)}\nB:\n(none)\nC:\n{part(1)}\nend"
    assert got[2] == "tb>b\nA:\n(none)\nB:\n(none)\nC:\n(none)\nend"
    assert {(r.task, r.prompt_length) for r in providers.payloads(kept).collect()} == {(a[:2], len(a) - 3) for a in got.values()}


def test_a_spool_is_read_again_across_pieces(monkeypatch):
    monkeypatch.setattr(providers, "READ", 7)
    spool = Spool()
    for text in ("one\r\ntwo", " and three\n", "four"):
        spool.add(text)
    assert [list(lines_of(spool)) for _ in range(2)] == [["one\r", "two and three", "four"]] * 2 and len(spool) == 23
    assert OfflineProvider().read("drift_reduce", spool) == OfflineProvider().complete("drift_reduce", "")
