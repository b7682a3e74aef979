"""Chat formatting by perspective rotation, native.

For every participant of a conversation (every role but the system's) the
dialogue is rendered once with that speaker as the assistant and the others as
named users. Loss spans cover what the assistant says and its end mark, so a
model learns each participant's turns from that participant's own rendering.

A rendering comes in parts of PART messages, by their place in the conversation
and not by turn numbers, which may be times or anything that has an order; a
usual conversation is one part, and no conversation, however long, is gathered
in one task. Every later part begins with the conversation's first system
message and with the last OVERLAP messages of the part before, said again as
context: they carry no loss, so a turn is learnt once for each perspective.
A part is rendered for those who speak in it, so no rendering is without loss and
a conversation of n speakers costs PART renderings of a message at most.

Defined cases: rows that agree in conversation, turn, role and text are one
message; messages of one turn go by role, then text; a null turn is before all
others; a null role is the speaker "unknown"; a null text is an empty message; a
null conversation is one conversation; one of system messages alone has no
participant and gives no rows; nor does an empty table. Only the four columns are
read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import global_rank
PART, OVERLAP = 64, 4
SYSTEM = "system"
UNKNOWN = "unknown"
BEGIN, END = "<|im_start|>", "<|im_end|>"


def rotate(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part: int = PART, overlap: int = OVERLAP) -> DataFrame:
    """(conv_id, perspective, part, n_turns: without what is said again, text, loss_spans: array<struct<start, end>> in characters of the text)."""
    m = messages.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(UNKNOWN)).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).distinct()
    m = global_rank(m, [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "place")
    ends = m.groupBy("conv_id").agg(F.min("place").alias("least"), F.max("place").alias("last")).select(F.col("conv_id").alias("c"), "least", "last")
    m = m.join(ends, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", (F.col("place") - F.col("least")).alias("at"), (F.col("last") - F.col("least")).alias("end"), "role", "text")
    of = F.floor(F.col("at") / part)
    later = (F.col("at") % part >= part - overlap) & ((of + 1) * part <= F.col("end"))
    place = lambda p, again: F.struct(p.cast("long").alias("part"), F.lit(again).alias("again"))
    m = m.withColumn("p", F.explode(F.when(later, F.array(place(of, False), place(of + 1, True))).otherwise(F.array(place(of, False)))))
    message = F.struct("at", "role", "text", F.col("p.again").alias("again"))
    parts = m.groupBy("conv_id", "p.part").agg(F.sort_array(F.collect_list(message)).alias("m"))
    system = m.filter((F.col("role") == SYSTEM) & ~F.col("p.again")).groupBy(F.col("conv_id").alias("c")).agg(F.min(F.struct("at", "role", "text", F.lit(True).alias("again"))).alias("lead"))
    parts = parts.join(system, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    led = F.coalesce(F.col("lead.at") < F.element_at("m", 1)["at"], F.lit(False))
    said = F.filter("m", lambda x: ~x["again"])
    speakers = F.array_distinct(F.transform(F.filter(said, lambda x: x["role"] != SYSTEM), lambda x: x["role"]))
    rows = parts.select("conv_id", "part", F.size(said).alias("n_turns"), F.when(led, F.concat(F.array("lead"), "m")).otherwise(F.col("m")).alias("m"), F.explode(speakers).alias("perspective"))
    own = lambda x: x["role"] == F.col("perspective")
    head = lambda x: F.when(own(x), F.lit(f"{BEGIN}assistant\n")).when(x["role"] == SYSTEM, F.lit(f"{BEGIN}system\n")).otherwise(F.concat(F.lit(f"{BEGIN}user name="), x["role"], F.lit("\n")))
    rows = rows.withColumn("s", F.transform("m", lambda x: F.struct(head(x).alias("head"), F.concat(x["text"], F.lit(END)).alias("body"), (own(x) & ~x["again"]).alias("own"))))
    rows = rows.withColumn("n", F.transform("s", lambda x: F.length(x["head"]) + F.length(x["body"]) + 1))
    before = F.transform("s", lambda x, i: F.struct(x.alias("x"), F.aggregate(F.slice("n", 1, i), F.lit(0), lambda a, b: a + b).alias("at")))
    spans = F.transform(F.filter(before, lambda y: y["x"]["own"]), lambda y: F.struct(
        (y["at"] + F.length(y["x"]["head"])).alias("start"), (y["at"] + F.length(y["x"]["head"]) + F.length(y["x"]["body"])).alias("end")))
    return rows.select(
        "conv_id", "perspective", "part", F.col("n_turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("s", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("text"), spans.alias("loss_spans"),
    )


ORACLE_SQL = """
WITH own AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM own),
o AS (SELECT conv_id, k // 64 AS part, k, role, text, 0 AS again FROM r UNION ALL SELECT conv_id, k // 64 + 1, k, role, text, 1 FROM r WHERE k % 64 >= 60 AND (k // 64 + 1) * 64 < n),
sys AS (SELECT conv_id, k, role, text FROM r WHERE role = 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k) = 1),
m AS (SELECT * FROM o UNION ALL SELECT sys.conv_id, f.part, sys.k, sys.role, sys.text, 1 FROM sys JOIN (SELECT conv_id, part, min(k) AS least FROM o GROUP BY conv_id, part) f ON f.conv_id IS NOT DISTINCT FROM sys.conv_id AND sys.k < f.least),
p AS (SELECT DISTINCT conv_id, part, role AS perspective FROM o WHERE again = 0 AND role <> 'system'),
s AS (SELECT p.conv_id, p.perspective, p.part, m.k, again, m.role = p.perspective AND again = 0 AS own,
  '<|im_start|>' || CASE WHEN m.role = p.perspective THEN 'assistant' WHEN m.role = 'system' THEN 'system' ELSE 'user name=' || m.role END || chr(10) AS head,
  m.text || '<|im_end|>' AS body FROM p JOIN m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.part = p.part),
c AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM s)
SELECT conv_id, perspective, part::BIGINT AS part, (count(*) - sum(again))::BIGINT AS n_turns, string_agg(head || body || chr(10), '' ORDER BY k) AS text,
  coalesce(string_agg(CASE WHEN own THEN (pos + length(head))::VARCHAR || '-' || (pos + length(head) + length(body))::VARCHAR END, ',' ORDER BY k), '') AS loss_spans
FROM c GROUP BY conv_id, perspective, part
"""
