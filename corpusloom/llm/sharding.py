"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters whole rows into memory-sized buckets by seeded hashes; pass two permutes each bucket
(Spark's shuffle() of an array is a Fisher-Yates shuffle) and writes it, a bucket a task and a file. What
assign_shards tells of a row is read from what was written.

Law `key`: a row's shard is the number with the highest seeded hash of (id, number), so id and shard count
decide, and one more shard takes rows only into itself.

Null id: a key like any other. Null text: no bytes (size 1, crc32 of nothing). Equal ids share a shard;
their buckets differ by text. Rows repeated more than SAME_ROWS times go to several buckets by where they stand, so
that no bucket outgrows a task; below that the result doesn't depend on the order of the input. Empty input: no rows.
All columns of the input are kept, whatever their names; they must be of types that can be ordered.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from corpusloom.llm.common import col, ensure_checkpoint_dir, free

#: Rows equal in id and text that share a bucket, and how many such sets may be larger (their hashes go with the plan).
SAME_ROWS, MOST_SAME = 10_000, 10_000


def shard_of(key: Column, n_shards: int, seed: int) -> Column:
    """Rendezvous hashing: the shard whose seeded hash of the key is the largest."""
    draws = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("h"), F.lit(i).alias("i")) for i in range(n_shards)]
    return (F.greatest(*draws) if n_shards > 1 else draws[0])["i"]


def bucket_count(total_bytes: int, n_shards: int, bucket_bytes: int) -> int:
    """Buckets of a shard, each of about bucket_bytes."""
    return max(1, -(-total_bytes // (n_shards * bucket_bytes)))


def _apart(spark: SparkSession, n: int) -> list[int]:
    """n keys of which repartition(n, key) gives each a partition of its own, in their order."""
    keys, tried = {}, 0
    while len(keys) < n:
        more = spark.range(tried, tried := tried + 16 * n)
        keys = {r[0]: r[1] for r in more.groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))).agg(F.min("id")).collect()} | keys
    return [keys[i] for i in range(n)]


def _names(docs: DataFrame) -> list[str]:
    """Of the written shard, bucket and place, and of the bucket's key: names the input doesn't hold."""
    return free(docs.columns, "__shard", "__bucket", "__place", "__key")


def _bucket(docs: DataFrame, id_col: str, text_col: str, per_shard: int, seed: int) -> DataFrame:
    """docs with a column of the bucket in its shard (under the name _names gives). Rows that are equal in id and text beyond SAME_ROWS are told apart by where they stand."""
    _, name, _, _ = _names(docs)
    at = [F.lit(seed + 1), col(id_col), col(text_col)]
    if per_shard > 1:
        same = docs.groupBy(F.xxhash64(*at).alias("h")).count().filter(F.col("count") > SAME_ROWS).select("h")
        hot = [r[0] for r in same.limit(MOST_SAME + 1).collect()]
        if len(hot) > MOST_SAME:
            raise ValueError(f"more than {MOST_SAME} rows are repeated over {SAME_ROWS} times each: make them distinct first")
        if hot:
            at.append(F.when(F.xxhash64(*at).isin(hot), F.monotonically_increasing_id()))
    return docs.withColumn(name, F.pmod(F.xxhash64(*at), F.lit(per_shard)).cast("int"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 8, seed: int = 17, bucket_bytes: int = 64 << 20) -> None:
    """Write whole rows as Parquet, one folder a shard (`__shard`), a file a bucket (`__bucket`), in the permuted order (`__place`, from 0 in each bucket).

    Where the input has columns of those names, the written ones get more underscores.
    """
    shard, bucket, place, key = _names(docs)
    total = docs.select(F.sum(F.octet_length(F.coalesce(col(text_col), F.lit(""))) + 1)).first()[0] or 0
    per_shard = bucket_count(total, n_shards, bucket_bytes)
    n_buckets = n_shards * per_shard
    placed = _bucket(docs, id_col, text_col, per_shard, seed).withColumn(shard, shard_of(col(id_col), n_shards, seed))
    # a bucket is a task: its key hashes to a partition of its own
    keys = F.array(*map(F.lit, _apart(docs.sparkSession, n_buckets))).cast("array<int>")
    scattered = placed.withColumn(key, F.get(keys, F.col(shard) * per_shard + F.col(bucket))).repartition(n_buckets, key)
    # rows sorted first: the permutation depends on the seed and the rows, not on arrival
    held = scattered.groupBy(key, shard, bucket).agg(F.sort_array(F.collect_list(F.struct(*map(col, docs.columns)))).alias("held"))
    dealt = held.withColumn("held", F.shuffle("held", F.lit(seed))).select(shard, bucket, F.posexplode("held").alias(place, "row"))
    (
        dealt.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], bucket, place, shard)
        .sortWithinPartitions(shard, bucket, place)  # as it is; the writer would sort by shard alone
        .write.partitionBy(shard)
        .parquet(path)
    )


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 8, seed: int = 17, bucket_bytes: int = 64 << 20, path: str | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard, all from the shards written to path (else to the shared folder)."""
    spark = docs.sparkSession
    if path is None:
        ensure_checkpoint_dir(spark)
        path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, id_col, text_col, n_shards, seed, bucket_bytes)
    shard, bucket, place, _ = _names(docs)
    written = spark.read.schema(StructType([*docs.schema.fields, *(StructField(c, IntegerType()) for c in (bucket, place, shard))])).parquet(path)
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = free(written.columns, "base")[0]
    starts = written.groupBy(shard, bucket).count().select(shard, bucket, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(base))
    raw = F.coalesce(col(text_col), F.lit(""))
    return written.join(F.broadcast(starts), [shard, bucket]).select(
        col(id_col).alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col(shard).alias("shard"),
        (F.col(base) + F.col(place)).cast("long").alias("slot"),
        shard_of(col(id_col), n_shards + 1, seed).alias("grown_shard"),
    )
