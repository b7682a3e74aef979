"""Text providers: who answers a prompt. A provider is asked from within tasks,
so it must be picklable; it is given the task's name and the prompt.

A provider mostly waits, so each task keeps a window of calls in flight, in
threads, and hands their answers on in the order of its rows. How many calls the
cluster makes at once is bounded by tasks times window: no prompt is moved.
"""

from __future__ import annotations

import codecs
import contextvars
import logging
import tempfile
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from threading import Lock
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.rank import global_rank
from ..sources.scratch import save

log = logging.getLogger("graphweave.providers")


class Provider(Protocol):
    name: str

    def complete(self, task: str, prompt: str) -> str: ...


#: What the offline provider says to each task, by the task's name or its beginning.
OFFLINE_ANSWERS = (
    ("entity_extraction", '{"entities": [{"name": "Sample Entity", "type": "CONCEPT", "description": "Deterministic mock entity for offline execution"}], "relations": []}'),
    ("claim_extraction", '{"claims":[]}'),
    ("community_summary", "Offline mock community summary generated for development testing."),
    ("global_map_", '{"points": [{"description": "Offline mock global evidence point.", "score": 50}]}'),
    ("global_reduce", "Offline mock global answer. Configure LLM_PROVIDER=openai for model-generated synthesis."),
    ("drift_primer", '{"answer":"Offline mock DRIFT primer.","follow_ups":[{"question":"Which indexed entities provide the strongest local evidence?","score":80}]}'),
    ("drift_followup_", '{"answer":"Offline mock DRIFT local evidence.","confidence":0.75,"follow_ups":[]}'),
    ("drift_reduce", "Offline mock DRIFT answer. Configure LLM_PROVIDER=openai for model-generated iterative synthesis."),
)
OFFLINE_ANSWER = "Offline mock answer. Configure LLM_PROVIDER=openai for model-generated answers."


@dataclass(frozen=True)
class OfflineProvider:
    """Deterministic, no network: the default."""

    name: str = "offline"

    def complete(self, task: str, prompt: str) -> str:
        for start, answer in OFFLINE_ANSWERS:
            if task == start or (start.endswith(("_", "summary")) and task.startswith(start)):
                return answer
        if task.endswith("query_answer"):
            return OFFLINE_ANSWER
        return f"Offline mock response for task: {task}"

    def read(self, task: str, pieces: Iterable[str]) -> str:
        return self.complete(task, "")


@dataclass(frozen=True)
class CannedProvider:
    """Answers by task, for tests and replays; else the fallback's."""

    answers: Mapping[str, str]
    fallback: Provider = field(default_factory=OfflineProvider)
    name: str = "canned"

    def complete(self, task: str, prompt: str) -> str:
        return self.answers[task] if task in self.answers else self.fallback.complete(task, prompt)

    def read(self, task: str, pieces: Iterable[str]) -> str:
        return self.answers[task] if task in self.answers else told(self.fallback, task, pieces)


class StreamingProvider(Provider, Protocol):
    """One that can hand out an answer piece by piece."""

    def stream(self, task: str, prompt: str) -> Iterator[str]: ...


class ReadingProvider(Provider, Protocol):
    """One that reads a long prompt piece by piece, as often as it likes, so that it need not hold all of it."""

    def read(self, task: str, pieces: Iterable[str]) -> str: ...


def lines_of(pieces: Iterable[str]) -> Iterator[str]:
    """The lines of a prompt that comes in pieces."""
    rest = ""
    for piece in pieces:
        *whole, rest = (rest + piece).split("\n")
        yield from whole
    yield rest


#: Characters of a prompt that wait in memory, the others on disk; of a piece that is read; of one that is shuffled.
SPOOLED, READ, PIECE = 1 << 24, 1 << 20, 1 << 14


class Spool:
    """A list that is written once and read in pieces, by several calls at once and again for each try."""

    def __init__(self) -> None:
        self.file, self.size, self.bytes, self.lock = tempfile.SpooledTemporaryFile(SPOOLED, "w+b"), 0, 0, Lock()

    def add(self, text: str | bytes, size: int | None = None) -> None:
        """size: the characters of bytes."""
        self.file.write(own := text.encode() if isinstance(text, str) else text)
        self.size, self.bytes = self.size + (len(text) if size is None else size), self.bytes + len(own)

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[str]:
        decode, at = codecs.getincrementaldecoder("utf-8")().decode, 0
        while at < self.bytes:
            with self.lock:
                self.file.seek(at)
                piece = self.file.read(READ)
            at += len(piece)
            if text := decode(piece, at == self.bytes):
                yield text


@dataclass(frozen=True)
class Prompt:
    """A list between what comes before and after it."""

    head: str
    spool: Spool
    tail: str

    def __len__(self) -> int:
        return len(self.head) + len(self.spool) + len(self.tail)

    def __iter__(self) -> Iterator[str]:
        yield self.head
        yield from self.spool
        yield self.tail


def told(provider: Provider, task: str, prompt: str | Iterable[str], stream: bool = False) -> str:
    """The provider's answer to a prompt, whole or in pieces, by what it has for it."""
    if not isinstance(prompt, str):
        if read := getattr(provider, "read", None):
            return read(task, prompt)
        prompt = "".join(prompt)
    pieces = getattr(provider, "stream", None) if stream else None
    return "".join(pieces(task, prompt)) if pieces else provider.complete(task, prompt)


#: Where ask() leaves what was asked and answered, inside keeping().
_kept: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("graphweave_payloads", default=None)


@contextmanager
def keeping(wanted: bool = True) -> Iterator[list[DataFrame]]:
    """Every call that is made inside is kept, for payloads(); unless it isn't wanted."""
    kept: list[DataFrame] = []
    token = _kept.set(kept if wanted else None)
    try:
        yield kept
    finally:
        _kept.reset(token)


def payloads(kept: list[DataFrame]) -> DataFrame | None:
    """(task, prompt, response, prompt_length, response_length, provider, timestamp) of all calls kept; None without any."""
    return reduce(DataFrame.unionByName, kept) if kept else None


def calls_at_once(cores: int, parallel: int | None) -> tuple[int | None, int]:
    """(at most so many tasks, calls in flight in each) for so many calls in the whole cluster: tasks use all cores and
    share the calls; where there are fewer calls than cores, there are fewer tasks of one call each."""
    if parallel is None:
        return None, 1
    return (parallel, 1) if parallel < cores else (None, parallel // cores)


def in_order(calls: Iterator[Callable[[], str | None]], window: int) -> Iterator[str | None]:
    """The calls' results in their order, window calls in flight. The first error, in that order, is raised; calls that
    have not begun by then are dropped."""
    with ThreadPoolExecutor(window) as pool:
        flying: deque[Future] = deque()
        try:
            for call in calls:
                flying.append(pool.submit(call))
                # Those behind the window are ready when one ends; answers wait here no longer than for the slowest.
                if len(flying) > 2 * window:
                    yield flying.popleft().result()
            while flying:
                yield flying.popleft().result()
        finally:
            for f in flying:
                f.cancel()


def trying(
    provider: Provider, retries: int = 3, wait: float = 0.5, valid: Callable[[str], bool] | None = None, instead: str | None = None, strict: bool = True, stream: bool = False,
) -> Callable[[str, str | Prompt], str | None]:
    """A call of the provider with its tries, as ask() says."""

    def one(t: str, p: str | Prompt) -> str | None:
        for turn in range(retries + 1):
            try:
                got = told(provider, t, p, stream)
                log.info("asked %s for %s: %d characters, %d back", provider.name, t, len(p), len(got or ""))
                if turn == retries or valid is None or valid(got):
                    return got
            except Exception as e:
                log.warning("asking %s for %s failed: %s", provider.name, t, type(e).__name__)
                if turn == retries:
                    if strict:
                        raise
                    return instead
                time.sleep(wait * 2**turn)
        raise AssertionError

    return one


def ask(
    df: DataFrame, provider: Provider, task: Column, prompt: Column, name: str = "response", retries: int = 3, wait: float = 0.5, parallel: int | None = None,
    valid: Callable[[str], bool] | None = None, instead: str | None = None, strict: bool = True, stream: bool = False,
) -> DataFrame:
    """df with the provider's answer. Errors, and answers that are not valid, are tried again, after a wait that doubles.
    After the last try an error is raised if strict, else the answer is `instead`; an invalid answer stays as it is.
    parallel bounds the calls in flight in the whole cluster; tasks are joined, without a shuffle, only where it is less
    than the cores. stream: an answer is joined from its pieces where the provider has any. Prompts and answers are
    never logged, only their lengths."""
    tasks, window = calls_at_once(df.sparkSession.sparkContext.defaultParallelism, parallel)
    one = trying(provider, retries, wait, valid, instead, strict, stream)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        sizes: deque[int] = deque()

        def calls() -> Iterator[Callable[[], str | None]]:
            for ts, ps in batches:
                sizes.append(len(ts))
                # Prompts become Python's own one by one, as they are asked.
                yield from (lambda t=t, p=p: one(t.as_py(), p.as_py()) for t, p in zip(ts, ps))

        done: list[str | None] = []
        for answer in in_order(calls(), window):
            done.append(answer)
            while sizes and len(done) >= sizes[0]:
                n = sizes.popleft()
                yield pa.array(done[:n], pa.string())
                done = done[n:]
        yield from (pa.array([], pa.string()) for _ in sizes)  # empty batches at the end

    rows = df.coalesce(tasks) if tasks else df
    kept = _kept.get()
    if kept is not None:
        rows = rows.withColumns({"task_": task, "prompt_": prompt})
        task, prompt = F.col("task_"), F.col("prompt_")
    # Not deterministic for Spark: it is asked once a row, and never again for another column.
    got = rows.withColumn(name, F.arrow_udf(run, "string").asNondeterministic()(task, prompt))
    if kept is None:
        return got
    got = save(got)
    _keep(got, kept, provider, name)
    return got.drop("task_", "prompt_")


def _keep(got: DataFrame, kept: list[DataFrame], provider: Provider, name: str) -> None:
    now = F.lit(datetime.now(timezone.utc).isoformat())
    kept.append(got.select(
        F.col("task_").alias("task"), F.col("prompt_").alias("prompt"), F.col(name).alias("response"), F.length("prompt_").alias("prompt_length"), F.length(name).alias("response_length"),
        F.lit(provider.name).alias("provider"), now.alias("timestamp")))


def in_pieces(lines: DataFrame, key: str) -> DataFrame:
    """lines(key, section, k1, k2, k3, line) -> (key, section, part, n, lines, text): each section's lines in the order
    of k1, k2, k3 as texts of some PIECE characters, by part, then n. Ranges are sorted on their own, so a list of any
    length is neither a row nor a task."""
    order = [key, "section", "k1", "k2", "k3"]
    rows = lines.repartitionByRange(*order).sortWithinPartitions(*order).select(key, "section", F.spark_partition_id().alias("part"), F.concat(F.lit("\n- "), F.col("line")).alias("line"))
    kind = to_arrow_type(rows.schema[key].dataType)
    schema = pa.schema([(key, kind), ("section", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("lines", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, own, held, size = 0, None, [], 0
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (row[:3] != own or size > PIECE):
                    out.append((*own, n, len(held), "".join(held)))
                    n, held, size = n + 1, [], 0
                own = row[:3]
                held.append(row[3])
                size += len(row[3])
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*own, n, len(held), "".join(held))))], schema)

    return rows.mapInArrow(run, f"{key} {lines.schema[key].dataType.simpleString()}, section int, part int, n long, lines long, text string")


#: Lists of a block: each is a bit of a long.
BLOCK = 62


def in_blocks(lists: DataFrame, key: str) -> DataFrame:
    """lists(key) -> (key, block, bit): a bit of a block for each, saved."""
    placed = global_rank(lists.select(key).distinct(), [F.col(key)], "nth_")
    return save(placed.select(key, F.floor(F.col("nth_") / BLOCK).cast("int").alias("block"), (F.col("nth_") % BLOCK).cast("int").alias("bit")))


def shared_pieces(lines: DataFrame) -> DataFrame:
    """lines(block, bits, section, k1, k2, k3, line) -> (block, bit, section, part, n, lines, size, text: bytes), as
    in_pieces() does: a line is sorted and read once, however many lists of its block show it."""
    order = ["section", "k1", "k2", "k3"]
    rows = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("block", "bits", "section", F.spark_partition_id().alias("part"), F.concat(F.lit("\n- "), F.col("line")).alias("line"))
    schema = pa.schema([("block", pa.int32()), ("bit", pa.int32()), ("section", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("lines", pa.int64()), ("size", pa.int64()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            block, bits, section, part = (b.column(i).to_numpy() for i in range(4))
            line = b.column(4)
            size = pc.utf8_length(line).to_numpy()
            for s in np.unique(section):
                for at in np.unique(block[section == s]):
                    own = np.flatnonzero((section == s) & (block == at))
                    for bit in range(BLOCK):
                        some = own[(bits[own] >> bit) & 1 == 1]
                        if not len(some):
                            continue
                        # The texts of an array stand one behind the other.
                        got = line.take(pa.array(some)).cast(pa.large_string())
                        ends = np.frombuffer(got.buffers()[1], np.int64)[got.offset : got.offset + len(got) + 1]
                        text, ends = got.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes(), ends - ends[0]
                        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], PIECE)), len(some)))
                        out = []
                        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                            out.append((int(at), bit, int(s), int(part[0]), n, z - a, int(size[some[a:z]].sum()), text[ends[a] : ends[z]]))
                            n += 1
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(run, "block int, bit int, section int, part int, n long, lines long, size long, text binary")


def ask_lists(
    df: DataFrame, lines: DataFrame, key: str, provider: Provider, task: Column, head: Column, titles: tuple[str, ...], tail: Column | None = None, name: str = "response",
    listed: int | None = None, retries: int = 3, wait: float = 0.5, parallel: int | None = None, stream: bool = False, lists: DataFrame | None = None,
) -> DataFrame:
    """df(key, ..) with the provider's answer to prompts of head, a list under each title, and tail. lines: see
    in_pieces(); section 0 is the first title's. With lists(key, block, bit), which may name a list for several prompts,
    see shared_pieces(). Pieces of a list come to a task in order and are spooled there, once for all prompts that show
    it, and a provider with read() gets them so; prompts of one list are dealt to several tasks only if there are too few
    others. For other providers pieces are joined, and more than `listed` lines under a title are an error. Tries, and
    calls in flight, are as in ask()."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks, window = calls_at_once(cores, parallel)
    one, last = trying(provider, retries, wait, stream=stream), len(titles)
    most = listed if getattr(provider, "read", None) is None else None
    asked_ = df.select(F.col(key).alias("key"), task.alias("task"), head.alias("head"), (F.lit("") if tail is None else F.concat(F.lit("\n"), tail)).alias("tail"))
    if lists is None:
        of = [F.col("key").alias("list"), F.lit(0).alias("bit"), F.lit(0).alias("copy")]
        pieces = in_pieces(lines, key).select(F.col(key).alias("list"), F.lit(0).alias("bit"), F.lit(0).alias("copy"), "section", "part", "n", "lines", F.length("text").cast("long").alias("size"), F.col("text").cast("binary").alias("text"))
    else:
        of = [F.col("block").alias("list"), "bit", "copy"]
        n, whole = F.count(F.lit(1)).over(Window.partitionBy("block", "bit")), df.count()
        own = lists.select(F.col(key).alias("key"), "block", "bit").join(asked_.select("key"), "key")
        own = own.withColumn("copies", F.least(n, F.ceil(n * (tasks or cores) / max(1, whole)))).withColumn("copy", ((F.row_number().over(Window.partitionBy("block", "bit").orderBy("key")) - 1) % F.col("copies")).cast("int"))
        own = save(own)
        asked_ = asked_.join(own, "key")
        copies = own.select("block", "bit", "copy").distinct()
        pieces = shared_pieces(lines).join(copies, ["block", "bit"]).select(*of, "section", "part", "n", "lines", "size", "text")
    no = lambda kind: F.lit(None).cast(kind)
    kind = to_arrow_type(df.schema[key].dataType)
    key_type = df.schema[key].dataType.simpleString()
    frames = asked_.select(*of, F.lit(last).alias("section"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("size"), no("binary").alias("text"), "key", "task", "head", "tail")
    rows = pieces.withColumns({"key": no(key_type), "task": no("string"), "head": no("string"), "tail": no("string")}).unionByName(frames)
    rows = (rows.repartition(tasks, "list", "bit", "copy") if tasks else rows.repartition("list", "bit", "copy")).sortWithinPartitions("list", "bit", "copy", "section", "part", "n").drop("part", "n")
    kept = _kept.get()
    keep = kept is not None
    schema = pa.schema([(key, kind), (name, pa.string()), ("task_", pa.string()), ("prompt_", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: deque[tuple] = deque()

        def calls() -> Iterator[Callable[[], str | None]]:
            at = spool = None
            opened = count = 0
            for b in batches:
                for list_, bit, copy, section, n, size, text, k, t, head_, tail_ in zip(*(c.to_pylist() for c in b.columns)):
                    if spool is None or at != (list_, bit, copy):
                        at, spool, opened, count = (list_, bit, copy), Spool(), 0, 0
                    while opened <= min(section, last - 1):
                        spool.add("\n" + titles[opened] + ("\n(none)" if opened < section else ""))
                        opened, count = opened + 1, 0
                    if section < last:
                        count += n
                        if most is not None and count > most:
                            raise ValueError(f"over {most} lines under '{titles[section]}' are around one question; set shown_items, or read prompts in pieces")
                        spool.add(text, size)
                        continue
                    prompt = Prompt(head_, spool, tail_)
                    asked.append((k, t, prompt))
                    yield lambda t=t, prompt=prompt: one(t, prompt)

        for answer in in_order(calls(), window):
            k, t, prompt = asked.popleft()
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (k, answer, t, "".join(prompt) if keep else None)))], schema)

    got = save(rows.mapInArrow(run, f"{key} {key_type}, {name} string, task_ string, prompt_ string"))
    if keep:
        _keep(got, kept, provider, name)
    return df.join(got.drop("task_", "prompt_"), key)
