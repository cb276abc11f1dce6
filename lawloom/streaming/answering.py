"""Which questions a model is asked: the answer cache and the cooldown in one state, over tables and streams.

Callers share a scope.  In the order of time, a question of which the scope has
an answer of at most CACHE_SECONDS is a hit, which changes nothing.  Another one
is skipped if the scope's last call is less than COOLDOWN_SECONDS ago, unless it
is forced, and told how long to wait.  All others are calls; a call that
succeeds is remembered under the question's normal form, and each call, also one
that fails, begins the cooldown anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import blank, normalize_query
from ..operators.lineage import cut
from .spacing import CACHE_SECONDS, COOLDOWN_SECONDS, micros

SECOND = 1_000_000
HIT, SKIPPED, CALLED = "hit", "skipped", "called"
OUTCOME = "outcome string, retry_after int, source long"
#: Seconds of a scope's time that are never parted: many times what the cache remembers, so that what segments hand on is less than what they read.
BLOCK_SECONDS = 4 * CACHE_SECONDS
#: Kinds of rows: what a state holds (a call's time, or an answer with its question), a request, and the digest of a state.
STATE, REQUEST, DIGEST = range(3)
_ROW = "seg int, scope string, kind int, n long, us long, q binary, forced boolean, fails boolean"


class Memory:
    """The state of one scope: when it last called, and (time, call) by question."""

    def __init__(self, last: int | None = None, cache: Iterable[tuple[str | bytes, int, int]] = ()):
        self.last = last
        self.cache = {q: (us, source) for q, us, source in cache}

    def judge(self, order: int, us: int, question: str | bytes, forced: bool, fails: bool) -> tuple[str, int | None, int | None]:
        """(outcome, seconds to wait, the call whose answer holds) of the next request."""
        known = self.cache.get(question)
        if known and us - known[0] <= CACHE_SECONDS * SECOND:
            return HIT, None, known[1]
        waited = None if self.last is None else us - self.last
        if not forced and waited is not None and waited < COOLDOWN_SECONDS * SECOND:
            return SKIPPED, (COOLDOWN_SECONDS * SECOND - waited) // SECOND, None
        self.last = us
        if not fails:
            self.cache[question] = us, order
        return CALLED, None, order

    def kept(self, us: int) -> tuple[int | None, list[tuple[str | bytes, int, int]]]:
        """What still matters from ``us`` on."""
        last = self.last if self.last is not None and us - self.last < COOLDOWN_SECONDS * SECOND else None
        return last, sorted((q, t, s) for q, (t, s) in self.cache.items() if us - t <= CACHE_SECONDS * SECOND)


def _requests(rows: DataFrame, order: str, ts: str, question: str, scope: str | None, forced: str | None, fails: str | None, normal: bool = False) -> DataFrame:
    """(scope, n, us, q, forced, fails); rows without a time are no requests."""
    q = blank(F.col(question)) if normal else normalize_query(F.col(question))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c else F.lit(False)
    name = F.coalesce(F.nullif(F.trim(blank(F.col(scope))), F.lit("")), F.lit("default")) if scope else F.lit("default")
    picked = rows.select(name.alias("scope"), F.col(order).cast("long").alias("n"), micros(ts).alias("us"), q.alias("q"), flag(forced).alias("forced"), flag(fails).alias("fails"))
    return picked.where("us is not null")


def _judged(memory: Memory, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["us", "n"])
    out = [memory.judge(*r) for r in rows[["n", "us", "q", "forced", "fails"]].itertuples(index=False, name=None)]
    return pd.DataFrame({"n": rows["n"].to_numpy(), "outcome": [o[0] for o in out], "retry_after": pd.array([o[1] for o in out], "Int32"), "source": pd.array([o[2] for o in out], "Int64")})


def _digest(last: int | None, cache: list[tuple[str | bytes, int, int]]) -> bytes:
    return hashlib.sha256(repr((last, cache)).encode()).digest()


_NOTHING = _digest(None, [])


def _values(c: pa.Array) -> list:
    # to_pylist makes an object of Arrow's for each value.
    return c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist()


def _columns(batch: pa.RecordBatch) -> Iterator[list]:
    """The columns of _ROW as lists in which equal scopes and questions are one object."""
    for c in batch.select(_ROW_ARROW.names).columns:
        if pa.types.is_integer(c.type) or pa.types.is_boolean(c.type):
            yield _values(c)
        else:
            c = c.dictionary_encode()
            words = c.dictionary.to_pylist()
            yield [None if i is None else words[i] for i in _values(c.indices)]


_ROW_ARROW = pa.schema([("seg", pa.int32()), ("scope", pa.string()), ("kind", pa.int32()), ("n", pa.int64()), ("us", pa.int64()), ("q", pa.binary()), ("forced", pa.bool_()), ("fails", pa.bool_())])
_OUT_ARROW = pa.schema([("n", pa.int64()), ("outcome", pa.string()), ("retry_after", pa.int32()), ("source", pa.int64())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema)


def _pass(onward: dict[tuple[int, str], tuple[int, int]] | None, whole: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over rows in the order of scope, segment, kind and time that holds one state and one batch.

    With ``onward``, (segment, scope) to the next segment and its first time, it
    gives the rows of the states that are handed on, else the outcomes.  A state
    ends with its segment, or if ``whole`` with its scope.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, at, out = Memory(), (None, None), []

        def leave() -> Memory:
            to = onward and onward.get(at)
            if not to:
                return memory
            last, cache = memory.kept(to[1])
            held = [(last, None, None)] if last is not None else []
            out.extend((to[0], at[1], STATE, n, us, q, None, None) for us, q, n in [*held, *((us, q, n) for q, us, n in cache)])
            out.append((to[0], at[1], DIGEST, None, None, _digest(last, cache), None, None))
            return Memory(last, cache)

        for batch in batches:
            for seg, scope, kind, n, us, q, forced, fails in zip(*_columns(batch), strict=True):
                if seg != at[0] or scope != at[1]:
                    kept = leave()
                    memory, at = kept if whole and scope == at[1] else Memory(), (seg, scope)
                if kind == REQUEST:
                    judged = memory.judge(n, us, q, forced, fails)
                    if onward is None:
                        out.append((n, *judged))
                elif q is None:
                    memory.last = us
                else:
                    memory.cache[q] = us, n
            if out:
                yield _table(out, _OUT_ARROW if onward is None else _ROW_ARROW)
                out.clear()
        leave()
        if out:
            yield _table(out, _ROW_ARROW)

    return step


def decide(rows: DataFrame, order: str, ts: str, question: str, scope: str | None = None, forced: str | None = None, fails: str | None = None, normal: bool = False) -> DataFrame:
    """(order, outcome, retry_after, source) of each request: hit, skipped or called; ``source`` is the call whose answer holds.

    Requests of one time come in the order of ``order``.  A blank scope is
    ``default``, and without ``scope`` all callers share one.  ``fails`` says of a
    request that its call, if it is one, gives no answer.  Rows without a time
    are left out.  Questions are put in their normal form, unless they are in it
    already (``normal``).

    Requests are dealt by scope and block of time into segments of like size, and
    all segments are judged at once, each from the state that the one before left
    for it: the first time from nothing.  Segments whose state became another are
    judged again.  Where callers are few and far between states soon come to be
    the same, whatever they were, so few are left in each turn.  Where they are
    many they may never: what is left is then followed from one segment to the
    next, each scope in one pass that holds its state only.
    """
    length = BLOCK_SECONDS * SECOND
    # Questions are compared by 128 bits of SHA-256, as their words are many times longer.
    q = F.substring(F.unhex(F.sha2("q", 256)), 1, 16)
    asked = _requests(rows, order, ts, question, scope, forced, fails, normal).withColumns({"q": q, "block": F.expr(f"us - pmod(us, {length}L)")})
    asked = asked.persist(StorageLevel.DISK_ONLY)
    dealt = asked.repartitionByRange("scope", "block").sortWithinPartitions("scope", "us", F.asc_nulls_last("n"))
    dealt = cut(dealt.select(F.spark_partition_id().alias("seg"), "scope", F.lit(REQUEST).alias("kind"), "n", "us", "q", "forced", "fails"))
    asked.unpersist()
    spark = dealt.sparkSession

    # A row for each segment: where a scope goes on in the next one.
    ends = dealt.groupBy("seg").agg(F.min(F.struct("scope", "us")).alias("first"), F.max("scope").alias("to")).orderBy("seg").collect()
    onward = {(a.seg, a.to): (b.seg, b.first.us) for a, b in pairwise(ends) if a.to == b.first.scope}
    scopes = {to: scope for (_, scope), (to, _) in onward.items()}

    def run(some: DataFrame, states: DataFrame, by: list[str], step: Callable, schema: str) -> DataFrame:
        both = some.unionByName(states.where(F.col("kind") == STATE)).repartition(*by)
        return both.sortWithinPartitions("scope", "seg", "kind", "us", F.asc_nulls_last("n")).mapInArrow(step, schema)

    def told(states: DataFrame) -> dict[int, bytes]:
        return {r.seg: bytes(r.q) for r in states.where(F.col("kind") == DIGEST).select("seg", "q").collect()}

    def of(frame: DataFrame, some: DataFrame, how: str) -> DataFrame:
        return frame.join(F.broadcast(some), ["seg", "scope"], how)

    left = cut(dealt.mapInArrow(_pass(onward), _ROW)) if onward else spark.createDataFrame([], _ROW)
    used, now = dict.fromkeys(scopes, _NOTHING), told(left) if onward else {}
    before = 2 * len(scopes) + 1
    while wrong := [to for to, name in scopes.items() if now[to] != used[to] and (to, name) in onward]:
        apart = 2 * len(wrong) < before
        begin = [(to, scopes[to]) for to in wrong] if apart else [(to, name) for name, to in {scopes[to]: to for to in sorted(wrong, reverse=True)}.items()]
        at = spark.createDataFrame(begin, "seg int, scope string")
        some = of(dealt, at, "left_semi") if apart else dealt.join(F.broadcast(at.withColumnRenamed("seg", "begin")), "scope").where("seg >= begin").drop("begin")
        new = cut(run(some, of(left, at, "left_semi"), ["seg", "scope"] if apart else ["scope"], _pass(onward, whole=not apart), _ROW))
        fresh = told(new)
        used |= {to: now[to] for to, _ in begin} | ({} if apart else fresh)
        now |= fresh
        left = cut(of(left, spark.createDataFrame([(to, scopes[to]) for to in fresh], "seg int, scope string"), "left_anti").unionByName(new))
        before = len(wrong)
    return run(dealt, left, ["seg", "scope"], _pass(None), f"n long, {OUTCOME}").withColumnRenamed("n", order)


class _Callers(StatefulProcessor):
    """A scope's last call as one value, and its answers as a map from question to time and call."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long")
        self.cache = handle.getMapState("cache", "q string", "us long, source long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows))
        known = [(q[0], us, n) for q, (us, n) in self.cache.iterator()]
        memory = Memory(self.last.get()[0] if self.last.exists() else None, known)
        yield _judged(memory, rows).assign(scope=key[0])
        _, live = memory.kept(int(rows["us"].max()))
        for q in {q for q, _, _ in known} - {q for q, _, _ in live}:
            self.cache.removeKey((q,))
        for q, us, n in set(live) - set(known):
            self.cache.updateValue((q,), (us, n))
        if memory.last is not None:
            self.last.update((memory.last,))

    def close(self) -> None:
        pass


#: What a session needs for states of several variables.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def decide_stream(rows: DataFrame, order: str, ts: str, question: str, scope: str | None = None, forced: str | None = None, fails: str | None = None) -> DataFrame:
    """The same for a stream, with one state for each scope; the session's state store must be STATE_STORE.

    Requests of one batch are put in order; one that comes in a later batch than
    a newer one is judged by the state that it finds.
    """
    asked = _requests(rows, order, ts, question, scope, forced, fails)
    out = asked.groupBy("scope").transformWithStateInPandas(_Callers(), f"n long, {OUTCOME}, scope string", "append", "none")
    return out.withColumnRenamed("n", order)
