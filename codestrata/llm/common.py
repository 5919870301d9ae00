"""Helpers that the training-data operators share: the shared folder, stored tables, code shipping."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The same six characters.
SPACE = " \t\n\x0b\x0c\r"

_shipped: set[str] = set()
_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (tests in one JVM)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folder:
            _own_folder[app] = tempfile.mkdtemp(prefix="codestrata-")
            atexit.register(shutil.rmtree, _own_folder[app], ignore_errors=True)
        folder = _own_folder[app]
    return folder.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder now."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def store(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, survives a lost executor."""
    spark = df.sparkSession
    path = path or new_folder(spark, tag)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder of tables that a computation needs on its way; ``clear`` deletes them when their readers are done."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.folder, self.tables = spark, new_folder(spark, tag), 0

    def store(self, df: DataFrame, tag: str) -> DataFrame:
        self.tables += 1
        return store(df, tag, f"{self.folder}/{self.tables}-{tag}")

    def clear(self) -> None:
        delete(self.spark, self.folder)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have: ``name`` with as many underscores behind it as that takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key is hot if it has more than one in HOT of all rows: fewer than HOT keys are.
HOT = 1 << 14


def spread_join(rows: DataFrame, keys: DataFrame, on: list[str], n: str, by: list[str]) -> DataFrame:
    """``rows`` joined with ``keys``, which has a row for each key and in column ``n`` the number of its rows.

    Rows of a hot key are dealt by a hash of ``by`` over as many tasks as they are HOT-ths of all rows; the list of hot
    keys, fewer than HOT by counting, is broadcast. ``keys`` is read three times: it should be a written table."""
    share = max(1, (keys.agg(F.sum(n)).first()[0] or 0) // HOT)
    shares = F.when(F.col(n) > share, F.ceil(F.col(n) / share)).otherwise(1).cast("long")
    hot = keys.filter(F.col(n) > max(share, 16)).select(*on, shares.alias("_shares"))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_deal", F.coalesce(F.pmod(F.xxhash64(*by), "_shares"), F.lit(0).cast("long"))).drop("_shares")
    each = F.when(F.col(n) > max(share, 16), F.sequence(F.lit(0).cast("long"), shares - 1)).otherwise(F.array(F.lit(0).cast("long")))
    return dealt.join(keys.withColumn("_deal", F.explode(each)), [*on, "_deal"]).drop("_deal")


def key_sieve(rows: DataFrame, key: Column, most: int = 28) -> np.ndarray:
    """A bitmap with the low bits of every key: a first selection, an exact join follows.

    It has 32 bits a key, 2^16 at least and 2^``most`` at most (32 MB); beyond that it lets more through."""
    bits = min(most, max(16, (32 * rows.count()).bit_length()))
    slot = key.bitwiseAND(F.lit((1 << bits) - 1))
    got = rows.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m")).collect()  # 32 MB at most
    out = np.zeros((1 << bits) // 8 + 4096, dtype=np.uint8)
    for r in got:
        out[r["b"] * 4096 : r["b"] * 4096 + 4096] |= np.frombuffer(r["m"], dtype=np.uint8)
    return out


def passes(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the sieve. Bucket 1 holds the values 1 to 32768, bucket 0 what is not above 0."""
    slot = keys.view(np.int64) & np.int64((len(sieve) - 4096) * 8 - 1)
    bucket = np.where(slot > 0, 1 + (slot - 1) // 32768, 0)
    bit = np.where(slot > 0, (slot - 1) % 32768, (-slot) % 32768)
    return (sieve[bucket * 4096 + (bit >> 3)] >> (bit & 7)) & 1 == 1


def packed(df: DataFrame) -> Column:
    """All columns of df as one, ``row``, so that a computation's own names cannot clash with them."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns)).alias("row")


def row_key(doc_id: str | Column, text_key: str | Column) -> Column:
    """``key``: one value for an id, null too, and the hash of a text."""
    doc_id, text_key = (F.col(c) if isinstance(c, str) else c for c in (doc_id, text_key))
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.hex(text_key)).cast("binary"))).alias("key")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, so that their Python workers can import it, and bound Arrow batches.

    A thousand rows a batch keep a worker's memory low where texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="codestrata-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(c: str | Column) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text (0)."""
    return F.coalesce(F.crc32(F.col(c).cast("string") if isinstance(c, str) else c.cast("string")), F.lit(0).cast("long"))


def utf8(c: str) -> Column:
    """The UTF-8 bytes of a text; null as the empty text."""
    return F.coalesce(F.encode(F.col(c).cast("string"), "UTF-8"), F.lit(b""))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
