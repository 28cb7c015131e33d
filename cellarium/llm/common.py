"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import json
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce, wraps
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared checkpoint folder.

    The folder is the one the session names in ``spark.checkpoint.dir``. Where that is
    unset, a local session (tests) uses a temporary one; on a cluster that is an error, as
    its executors share no temporary folder. Spark removes the files once the table is no longer
    referred to if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set; else they
    stay until the folder is cleared.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cellarium-checkpoint-"))
    return df.checkpoint(eager=True)


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` that hands its memory back to the system when its task ends.

    Python workers live on between tasks and stages; without this each keeps the most that
    it ever took, beside the memory of the stages that follow.
    """

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # only the GNU library has it
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def sliced(batches: Batches, size: int = 4_000_000) -> Batches:
    """The rows in batches of about ``size`` bytes of text, or elements of lists, in their
    last column; a larger row has a batch to itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.columns[-1]
        length = pc.list_value_length(last) if pa.types.is_list(last.type) else pc.binary_length(last)
        ends = np.cumsum(pc.fill_null(length, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        edges = [0, *(np.flatnonzero(np.diff((ends - 1) // size)) + 1).tolist(), batch.num_rows]
        for a, b in pairwise(edges):
            yield batch.slice(a, b - a)


def may_be_among(column: Column, few: DataFrame, name: str, most_bits: int = 25) -> Column:
    """False only for values that are not in ``few[name]``: a filter of 32 to 64 bits a value.

    It spares the shuffle texts that the join after it would drop. It has 2^most_bits bits
    at most (4 MB), as it is a constant of the plan; with more than some millions of values
    it lets more through, never less.
    """
    bits = min(max((32 * few.count()).bit_length(), 16), most_bits)
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << bits) - 1))
    set_bits = few.select(place(F.col(name)).alias("h")).groupBy(F.shiftright("h", 6).cast("int").alias("word"))
    got = set_bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 AS int))")).alias("bits")).collect()
    words = [0] * (1 << (bits - 6))
    for row in got:
        words[row["word"]] = row["bits"]
    sieve = F.from_json(F.lit(json.dumps(words, separators=(",", ":"))), "array<bigint>")
    h = place(column)
    return F.getbit(F.get(sieve, F.shiftright(h, 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def null_safe(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Join condition in which a null key matches a null key."""
    return reduce(lambda a, b: a & b, (left[n].eqNullSafe(right[n]) for n in names))


def is_held_out(doc_id: str | Column) -> Column:
    """Rows whose crc32 of the id as text leaves 1 modulo 3: never learned from."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % 3 == 1, F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas of the body."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def running(values: Column, combine, zero: Column, block: int = 256) -> Column:
    """Array of inclusive running totals of ``values`` under ``combine``.

    Works in blocks of ``block``, so that n values take about n * block / 2 small
    steps and never an array copy for each value.
    """
    fold = lambda xs: F.aggregate(xs, zero, combine)

    def totalled(bound: Column) -> Column:
        blocks, totals = bound["blocks"], bound["totals"]
        return F.flatten(
            F.transform(
                blocks,
                lambda xs, b: let(
                    fold(F.slice(totals, F.lit(1), b)),
                    lambda before: F.transform(
                        xs, lambda _, i: combine(before, fold(F.slice(xs, F.lit(1), i + 1)))
                    ),
                ),
            )
        )

    def blocked(whole: Column) -> Column:
        last = F.floor((F.greatest(F.size(whole), F.lit(1)) - 1) / block).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(whole, b * block + 1, F.lit(block)))

    return let(
        let(values, blocked),
        lambda blocks: let(
            F.struct(blocks.alias("blocks"), F.transform(blocks, fold).alias("totals")), totalled
        ),
    )
