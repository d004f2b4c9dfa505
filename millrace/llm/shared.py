"""Small helpers that several corpus operators use."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from millrace.plans.lineage import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(c, UPPER, LOWER)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read back: a cut that survives lost executors
    and, unlike ``checkpoint()``, is compressed and column-wise."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores appended until no column of the input has that name."""
    taken = {c.lower() for c in taken}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns' text and the seed alone: 52 bits of an MD5."""
    text = F.concat_ws("#", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2 ** 52))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once per row. A column that a lambda refers to may be inlined by the optimiser and
    computed anew for each element; a lambda variable never is."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches have been bounded: whole texts travel in them, off the heap and in both
    directions, and Spark's defaults (10 000 rows, 64 MB) are meant for narrow rows. Smaller settings are left as they are."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1_000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = conf.get(key, None) or ""
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


_HELD: dict[Hashable, tuple[int | None, object]] = {}   # in a worker: the stage that something is kept for, and the thing


def _stage() -> int | None:
    context = TaskContext.get()
    return None if context is None else context.stageId()


def held(key: Hashable, make: Callable[[], object]):
    """``make()``, kept in the worker for the tasks of this stage that follow; ``returning`` drops it when one of another stage begins."""
    if key not in _HELD or _HELD[key][0] != _stage():
        _HELD.pop(key, None)
        _HELD[key] = _stage(), make()
    return _HELD[key][1]


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):   # another C library than glibc
        pass


def _let_go() -> None:
    """Drop what this worker has ``held`` for another stage. A function of the module: one that Spark sends by value has a ``_HELD`` of its own."""
    if old := [key for key, (stage, _) in _HELD.items() if stage != _stage()]:
        for key in old:
            del _HELD[key]
        gc.collect()
        _give_back()


def returning(work):
    """``work`` over a task's batches, without what the worker, which Spark keeps for the next stage, has ``held`` for an
    earlier one; then the worker gives memory back to the system."""
    def run(batches):
        _let_go()
        yield from work(batches)
        _give_back()

    return run


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``most`` bytes of ``text`` (one row at least), so that what a task builds from
    them is bounded whatever the number of rows in a batch."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        part, at = (np.cumsum(size) - size) // most, 0
        for end in [*np.flatnonzero(np.diff(part)) + 1, batch.num_rows]:
            if end > at:
                yield batch.slice(at, end - at)
            at = end
