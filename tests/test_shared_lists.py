"""Lists that several prompts show: lines are sorted once for all lists, and a list comes to a task once for all prompts."""

from pyspark.sql import functions as F

from graphweave.operators import graph
from graphweave.plans import providers


class Echo:
    name = "echo"

    def complete(self, task, prompt):
        return f"{task}>{prompt}"


class Reader(Echo):
    def read(self, task, pieces):
        return f"{task}>{''.join(pieces)}"


def test_prompts_of_one_list_and_of_many(spark):
    """70 lists are two blocks; list i shows what i divides, and some lists are shown by no, or by many prompts."""
    lists = providers.in_blocks(spark.range(70).select(F.col("id").alias("alike")), "alike")
    assert {(r.block, r.bit) for r in lists.collect()} == {(i // 62, i % 62) for i in range(70)}
    names = spark.range(200).withColumn("alike", F.explode(F.sequence(F.lit(0), F.lit(69)))).filter("alike > 0 and id % alike = 0").select("alike", F.format_string("é %03d", "id").alias("name"))
    held = graph.held_by(names.join(lists, "alike"))
    assert held.count() <= 2 * 200 < names.count()
    lines = held.select("block", "bits", F.lit(1).alias("section"), F.col("name").alias("k1"), F.lit("").alias("k2"), F.lit("").alias("k3"), F.col("name").alias("line"))
    assert sum(r["lines"] for r in providers.shared_pieces(lines).collect()) == names.count()
    rows = spark.range(90).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("q"), F.when(F.col("id") < 20, 7).otherwise(F.col("id") - 20).alias("alike"))
    who = rows.join(lists, "alike").select("q", "block", "bit")
    for provider in (Echo(), Reader()):
        got = providers.ask_lists(rows, lines, "q", provider, F.lit("t"), F.col("q"), ("A:", "B:"), F.lit("end"), parallel=4, lists=who)
        shown = {r.q: r.response for r in got.collect()}
        for p in range(90):
            i = 7 if p < 20 else p - 20
            own = "".join(f"\n- é {n:03d}" for n in range(200) if i and n % i == 0)
            assert shown[f"p{p}"] == f"t>p{p}\nA:\n(none)\nB:{own or chr(10) + '(none)'}\nend"


def test_relations_of_many_searches_are_one_row_a_block(spark):
    lists = providers.in_blocks(spark.range(5).select(F.col("id").alias("q")), "q")
    names = spark.createDataFrame([(q, n) for q in range(5) for n in "abcd"[: q + 1]], "q long, name string")
    r = spark.createDataFrame([("a", "b"), ("a", "d"), ("d", "d"), ("x", "a")], "source string, target string")
    got = {(x.source, x.target): x.bits for x in graph.induced_by(r, graph.held_by(names.join(lists, "q"))).collect()}
    want = {}
    for x in graph.induced(r, names, by=("q",)).collect():
        want[x.source, x.target] = want.get((x.source, x.target), 0) | 1 << x.q
    assert got == want == {("a", "b"): 0b11110, ("a", "d"): 0b11000, ("d", "d"): 0b11000}
