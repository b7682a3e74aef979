"""Numbers of lines and rows that no single task counts."""

import json

import pytest

from graphweave.plans import evaluate
from graphweave.sources.documents import with_ids
from graphweave.sources.lines import numbered_lines


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_lines_of_files_that_many_tasks_read(spark, tmp_path, small_splits):
    files = {"a.txt": [f"line {i} " + "x" * (i % 97) for i in range(2000)], "b.txt": ["", " ", "one\r", "é", ""], "c.txt": [f"{i}" for i in range(700)]}
    for name, lines in files.items():
        (tmp_path / name).write_bytes("\n".join(lines).encode() + (b"\n" if name == "c.txt" else b""))
    rows = numbered_lines(spark, str(tmp_path))
    got = {(r["file"].rsplit("/", 1)[1], r["line"]): r["text"] for r in rows.collect()}
    want = {(name, i): x.rstrip("\r") for name, lines in files.items() for i, x in enumerate(lines, 1)}
    want.pop(("b.txt", 5))  # a line begins behind the last line end only if something is there
    assert got == want
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_cases_in_many_splits(spark, tmp_path, small_splits):
    path = tmp_path / "cases.jsonl"
    lines = [json.dumps({"id": f"c{i}", "query": "who " * (i % 30 + 1)}) for i in range(400)]
    lines[10] = ""
    path.write_text("\n".join(lines))
    assert evaluate.read_cases(spark, str(path)).count() == 399
    for bad in ('{"id": "x"}', '{"id": "x", "query": "q", "modes": ["none"]}', "{broken", '{"id": "x", "query": "q", "top_k": 99}'):
        path.write_text("\n".join([*lines[:317], bad, *lines[317:], '{"id": ""}']))
        (tmp_path / ".cases.jsonl.crc").unlink(missing_ok=True)
        with pytest.raises(ValueError, match=r"line 318 of .*cases\.jsonl"):
            evaluate.read_cases(spark, str(path))


def test_ids_for_rows_without(spark):
    texts = ["b", "a", None, "c", "a", ""]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, n int")
    got = with_ids(df.repartition(3), "x")
    assert got.columns == ["doc_id", "text", "n"]
    rows = sorted((int(r["doc_id"].removeprefix("x_doc_")), r["text"]) for r in got.collect())
    assert rows == [(0, None), (1, ""), (2, "a"), (3, "a"), (4, "b"), (5, "c")]
    named = spark.createDataFrame([(7, "t")], "doc_id long, text string")
    assert with_ids(named, "x").collect() == named.collect()
