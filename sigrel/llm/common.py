"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space (bytes.split() has the same rule).
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in one Arrow batch: texts can be long, so batches stay small.
BATCH_ROWS = 1000
_WORDS_KEPT = 400_000


def prepare(spark: SparkSession) -> None:
    """Settings that every operator relies on: small Arrow batches, and a folder for checkpoints.

    The folder is that of ``spark.checkpoint.dir``. Without one, a local master gets a folder of its own; a cluster
    has no folder that all its machines share unless the session names it, so this fails there.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir", None)
        if not where and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="sigrel-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: lost executors don't cost the work again."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Intermediate tables of one run, as Parquet below the shared checkpoint folder.

    ``put`` writes a table and reads it again; ``drop`` deletes one that a later table replaces.
    """

    def __init__(self, spark: SparkSession):
        prepare(spark)
        self.spark, self.where, self.paths = spark, f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}", {}

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.where}/{len(self.paths)}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = (path, back)
        return back

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            if df is not None:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[id(df)][0])
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of a sieve at most: 16 MB, whatever the number of its members.
SIEVE_BITS = 1 << 27
_BLOCK = 1 << 15


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def sieve(members: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A bitmap over the hashed keys of ``members`` (a stored table), in blocks of 4 KB: (block, bits), and its size.

    It takes 16 bits a member, up to SIEVE_BITS; a fuller one passes more rows, never fewer. The bitmap is stored, so
    that plans which use it several times read it instead of building it each time.
    """
    bits = _BLOCK
    many = members.count()
    while bits < min(16 * many, SIEVE_BITS):
        bits *= 2
    at = members.select(_place(F.col(key), bits).alias("at")).select((F.col("at") / _BLOCK).cast("int").alias("block"), (F.col("at") % _BLOCK).alias("at"))
    # dealt by block first: partial bitmaps would be as many as there are tasks
    return cut(at.distinct().repartition("block").groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))), bits


def sifted(df: DataFrame, key: Column, made: tuple[DataFrame, int]) -> DataFrame:
    """``df`` with a boolean ``_may``: false only where the key is surely no member; no shuffle, as a sieve is bounded."""
    blocks, bits = made
    at = _place(key, bits)
    have = df.withColumn("_block", (at / _BLOCK).cast("int")).join(F.broadcast(blocks.withColumnRenamed("block", "_block").withColumnRenamed("bits", "_bits")), "_block", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at % _BLOCK / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.expr("(shiftright(_byte, _bit) & 1) = 1")
    have = have.withColumns({"_byte": F.coalesce(byte, F.lit(0)), "_bit": (at % 8).cast("int")})
    return have.withColumn("_may", hit).drop("_block", "_bits", "_byte", "_bit")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text) -> F.Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5: such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class WordHashes(dict):
    """64-bit hash of a word's bytes, kept for words seen before; the number kept is bounded."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        if len(self) < _WORDS_KEPT:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")
