"""Global and drift search under a provider that reads its prompts."""

import os
from collections import Counter

import duckdb
import pytest

from graphweave.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def by_sql(name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return sorted(map(repr, con.execute(ORACLE[name]).fetchall()))


@pytest.mark.parametrize("name", ["global_reading", "drift_reading"])
def test_equals_sql(spark, name):
    got = QUERIES[name](spark, SF).collect()
    assert sorted(repr(tuple(x)) for x in got) == by_sql(name)
    if name == "drift_reading":
        ends = [x for x in got if x.kind == "end"]
        assert set(Counter(x.id for x in ends)) == {"no_followups", "max_depth", "max_actions"}
        assert {x.depth for x in ends} >= {0, 2} and all(x.place <= 5 for x in ends)
        assert any(x.depth == 2 and x.parent_id.startswith("primer_") for x in got if x.kind == "evidence")
        # Nobody looks into a question twice, nor into its own.
        asked = [(x.question_id, x.text.split("?")[0]) for x in got if x.kind == "evidence"]
        assert len(asked) == len(set(asked)) and all(f"NATION_{q}" != t.split()[-1] for q, t in asked)
    else:
        assert len({x.answer for x in got}) > 5
