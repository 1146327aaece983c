"""Keyed state of streaming jobs, kept by Spark's state store.

A micro-batch reads and writes the state of its own keys and of no others, so
its cost does not grow with what came before.  What a job knows is read from the
store of its checkpoint; nothing is kept twice, and the store itself drops old
versions.  A restarted job goes on where the last batch was committed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that a task holds while it reduces a batch to the last rows of each key.
HELD = 50_000


@contextmanager
def state_store(spark: SparkSession):
    """The store that keyed processors need, for queries started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _rank(row, order: list[str]) -> tuple:
    """Later rows rank higher, NULL lowest."""
    return tuple((row[c] is not None, row[c]) for c in order)


class LastRows(StatefulProcessor):
    """List state of the last ``n`` rows of a key by ``order``; idle keys expire after ``idle_ms``."""

    def __init__(self, schema: T.StructType, order: list[str], n: int, idle_ms: int | None):
        self.schema, self.order, self.n, self.idle_ms = schema, order, n, idle_ms

    def init(self, handle) -> None:
        self.rows = handle.getListState("rows", self.schema, ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = self.schema.names
        held = [dict(zip(names, r, strict=True)) for r in self.rows.get()] if self.rows.exists() else []
        fresh = ({c: r[c] for c in names} for r in rows)
        best = heapq.nlargest(self.n, (x for part in (held, fresh) for x in part), key=lambda x: _rank(x, self.order))
        self.rows.put([tuple(x[c] for c in names) for x in best])
        yield Row(kept=len(best))

    def close(self) -> None:
        pass


class FirstRows(StatefulProcessor):
    """Passes on the first row of a key that the store has not seen; ``known`` rows only mark their key."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("seen", T.BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, known = None, self.seen.exists()
        for row in rows:
            known = known or row["__known"]
            first = first or row
        self.seen.update((True,))
        if not known:
            yield Row(**{c: first[c] for c in self.names})

    def close(self) -> None:
        pass


def _reduced(keys: list[str], order: list[str], n: int):
    """The last ``n`` rows of each key in a task's part of a batch, so a hot key moves few rows."""

    def fewer(table: pa.Table) -> pa.Table:
        ranked = table.sort_by([(c, "descending") for c in order])
        at = ranked.select(keys).to_pandas().groupby(keys, sort=False, dropna=False).cumcount()
        return ranked.filter(pa.array(at < n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = fewer(table if held is None else pa.concat_tables([held, table]))
            if len(held) > HELD:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    return run


def last_rows(stream: DataFrame, keys: list[str], order: list[str], n: int, idle_ms: int | None = None) -> DataFrame:
    """Stream that keeps the last ``n`` rows of each key in its state; it gives how many a changed key has."""
    fewer = stream.mapInArrow(_reduced(keys, order, n), stream.schema)
    processor = LastRows(stream.schema, order, n, idle_ms)
    out = T.StructType([T.StructField("kept", T.IntegerType())])
    return fewer.groupBy(*keys).transformWithState(processor, out, "update", "processingTime" if idle_ms else "none")


def first_rows(stream: DataFrame, key: str) -> DataFrame:
    """Rows of ``stream`` (with ``__known``) whose key has never come before and is not known."""
    names = [c for c in stream.columns if c != "__known"]
    return stream.groupBy(key).transformWithState(FirstRows(names), T.StructType([stream.schema[c] for c in names]), "append", "none")


def kept_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The rows that ``last_rows`` holds, from the store of its checkpoint."""
    store = spark.read.format("statestore").option("stateVarName", "rows").option("flattenCollectionTypes", True).load(checkpoint)
    if store.schema["list_element"].dataType.names == ["value", "ttlExpirationMs"]:
        # Rows stay in the store until it next cleans up.
        return store.where(F.col("list_element.ttlExpirationMs") > F.unix_millis(F.current_timestamp())).select("list_element.value.*")
    return store.select("list_element.*")
