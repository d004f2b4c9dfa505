"""Shards of equal row counts in one global random order, by a two-pass external shuffle.

Pass one scatters the records by seeded hashes into buckets that fit in memory; pass two shuffles each bucket
(Fisher-Yates) and writes it. A record's place in the whole order is its place in its bucket behind all earlier buckets,
and shards are equal runs of that order, so their counts differ by one at most and no third pass is needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm.shared import free_name, returning, small_batches, stored
from millrace.plans.lineage import scratch_path
from millrace.plans.lookup import fit_lookup, join_lookup

SHARDS, SEED = 8, 1
BUCKET_BYTES = 16 << 20     # text of a bucket, on average
REPEATED = 1_000            # rows of one id beyond which they are scattered one by one
MOST_PARTITIONS = 32_768


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of ``range(n)``: from the last place on, each is swapped with a place drawn from those up to it."""
    order = list(range(n))
    draws = np.random.default_rng([seed, bucket]).integers(0, np.arange(n, 0, -1)).tolist() if n else []
    for last, at in zip(range(n - 1, 0, -1), draws):
        order[last], order[at] = order[at], order[last]
    return np.array(order, np.int64)


def _scattered(docs: DataFrame, id_col: str, seed: int, hashed: str) -> DataFrame:
    """``docs`` with a seeded hash of the id. Rows of an id that repeats often, null ids included, are told apart by their place
    in the input, so that no bucket has to hold them all."""
    key = free_name([*docs.columns, hashed], "_id_hash")
    keyed = docs.withColumn(key, F.xxhash64(F.lit(seed).cast("long"), F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("-"))))
    often = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > REPEATED)
    lookup = fit_lookup(often, [key])
    if not lookup.total:
        return keyed.withColumnRenamed(key, hashed)
    mark = free_name([*keyed.columns, hashed], "_often")
    lookup.table = lookup.table.withColumn(mark, F.lit(True))
    place = free_name([*keyed.columns, hashed, mark], "_place")
    marked = join_lookup(keyed.withColumn(place, F.monotonically_increasing_id()), lookup, [mark])
    # written, so that a place in the input is settled once
    return stored(marked.withColumn(hashed, F.when(F.col(mark), F.xxhash64(key, place)).otherwise(F.col(key))).drop(key, place, mark), "scattered")


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED,
                 bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write ``docs`` below ``folder``, one folder per shard, and return the files' rows: all columns, ``slot`` (0, 1, ... in
    each shard) and ``shard``.

    The order depends on seed, ids and row contents, not on the input's partitions; only rows of an id that occurs more than
    ``REPEATED`` times (or is null so often) are placed by their position in the input, and the table is then written once more
    beforehand. Null ids and texts, equal rows and ties are rows like others. An empty table gives no rows.
    Input columns named shard or slot are replaced. One count per bucket passes through the driver.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    spark = docs.sparkSession
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("shard", "slot")])
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1)).first()[0] or 0
    n_buckets = max(1, -(-size // bucket_bytes))
    hashed = free_name(docs.columns, "_hash")
    bucket = free_name([*docs.columns, hashed], "_bucket")
    records = _scattered(docs, id_col, seed, hashed).withColumn(bucket, F.pmod(F.col(hashed), F.lit(n_buckets)))
    # one number per bucket of memory size: 100 TB of text make six million of them
    counted = records.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts = np.zeros(n_buckets, np.int64)
    counts[counted[bucket].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    bounds = np.array([first[-1] * s // shards for s in range(shards + 1)], np.int64)
    shared = spark.sparkContext.broadcast((first, bounds))
    names = docs.columns
    schema = docs.select("*").schema.add("slot", "long").add("shard", "integer")

    def shuffled(batches):
        first, bounds = shared.value

        def written(rows, number):
            if rows.num_rows != first[number + 1] - first[number]:
                raise ValueError(f"bucket {number} has {rows.num_rows} rows, counted were {first[number + 1] - first[number]}: the input is not the same when read again")
            order = fisher_yates(rows.num_rows, seed, number)
            at = first[number] + np.arange(rows.num_rows)
            shard = np.searchsorted(bounds, at, "right") - 1
            # records move in runs of bounded size
            for k in range(0, rows.num_rows, 500):
                some = rows.take(pa.array(order[k:k + 500])).combine_chunks()
                columns = [some.column(c) for c in names]
                yield from pa.Table.from_arrays([*columns, pa.array(at[k:k + 500] - bounds[shard[k:k + 500]]), pa.array(shard[k:k + 500].astype(np.int32))],
                                                names=[*names, "slot", "shard"]).to_batches()

        held, number = [], None
        for batch in batches:
            own = batch.column(bucket).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for a, b in zip(cuts, cuts[1:]):
                if held and own[a] != number:
                    yield from written(pa.Table.from_batches(held), number)
                    held = []
                number = int(own[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from written(pa.Table.from_batches(held), number)

    dealt = (records.repartition(int(min(max(n_buckets, 1), MOST_PARTITIONS)), bucket)
             .sortWithinPartitions(bucket, hashed, F.xxhash64(*names)))
    small_batches(dealt).drop(hashed).mapInArrow(returning(shuffled), schema).write.partitionBy("shard").parquet(folder)
    return read_shards(spark, folder, schema)


def read_shards(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(folder)


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED,
                    bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The documents as shards in the shared folder, read back: all columns, slot and shard."""
    return write_shards(docs, scratch_path(docs.sparkSession, "shards"), id_col, text, shards, seed, bucket_bytes)
