"""What the corpus operators share: scratch tables, words, hashes and distributed running sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A word is a run of anything but ASCII white space; bytes.split() cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A word of letters and digits: ASCII ones, and every character outside ASCII.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone, whatever the locale or the script."""
    return F.translate(c, UPPER, LOWER)


def or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes that Spark hands to a Python worker at once, where the session doesn't say: the JVM and the worker both hold them.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's bound on Arrow batches, unless it has one: whole texts and sets come in batches of some megabytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its scheme: spark.checkpoint.dir; only where it is unset, one in the warehouse."""
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    path = spark._jvm.org.apache.hadoop.fs.Path(set_ or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if not set_ and found.startswith("file:") and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share; {found} is local to each machine")
    return found


class Scratch:
    """Written tables that cut lineage: they live in the shared folder, so a lost executor costs a reread only."""

    #: The folders that operators of this process have used, for release().
    roots: list[str] = []

    def __init__(self, spark: SparkSession, owner: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/ledgerloom/{owner}-{uuid.uuid4().hex}"
        self.made, self.saved = 0, []
        Scratch.roots.append(self.root)

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        self.saved.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *saved: DataFrame) -> None:
        """Removes tables that no later plan reads."""
        for df in saved:
            for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                self._delete(folder)

    def keep_only(self, *needed: DataFrame) -> None:
        """Removes all tables saved here but those that these plans read."""
        kept = {f.rsplit("/", 2)[1] for df in needed for f in df.inputFiles()}
        for path in self.saved:
            if path.rsplit("/", 1)[1] not in kept:
                self._delete(path)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> int:
    """Removes the tables and files that operators of this process have left in the shared folder; returns how many folders.

    Results are lazy and read those tables: write or collect what is wanted first. Other processes' tables stay.
    """
    n, scratch = len(Scratch.roots), Scratch.__new__(Scratch)
    scratch.spark = spark
    while Scratch.roots:
        scratch._delete(Scratch.roots.pop())
    return n


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def finish(h: np.ndarray) -> np.ndarray:
    """The closing mix of a 64-bit hash, so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Odd multipliers for the places of an n-gram; the k-th is a power of the first.
PLACES = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 17)], dtype=np.uint64)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of hashed words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    total = h[:m] * PLACES[0]
    for k in range(1, n):
        total = total + h[k : m + k] * PLACES[k]
    return finish(total)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str, rows: int = 2048) -> Iterator[list[list]]:
    """Python lists of the named columns, a few thousand rows at a time whatever the size of Spark's batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield [part.column(part.schema.get_field_index(n)).to_pylist() for n in names]


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
_ARROW |= {f"array<{k}>": pa.list_(t) for k, t in _ARROW.items()}


def arrow_schema(ddl: str) -> pa.Schema:
    """Flat DDL as an Arrow schema; workers have no session to parse it."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (field.split() for field in ddl.split(","))])


#: Rows of one group are dealt into COARSE x FINE bins by their place in the order, so that running sums need no task with a whole group.
COARSE, FINE = 256, 1024


def content_order(*parts: Column) -> Column:
    """A well-mixed order that the row's content alone decides: the hexadecimal MD5 of its parts."""
    return F.md5(F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def with_bins(df: DataFrame, order: str) -> DataFrame:
    """Adds _coarse and _fine, the bins of a hexadecimal order."""
    top = F.conv(F.substring(order, 1, 5), 16, 10).cast("int")
    return df.withColumn("_coarse", F.shiftright(top, 12)).withColumn("_fine", F.shiftright(top, 2).bitwiseAND(F.lit(FINE - 1)))


def running_sums(df: DataFrame, group: list[str], order: list[str], values: dict[str, str], of_group: DataFrame | None = None) -> DataFrame:
    """Exclusive running sums over each group in the order (_coarse, _fine, *order); with_bins() gives the bins.

    Group columns must not be null: then the sums inside bins and the join with the bins' sums share one shuffle of the
    rows. values: new column -> summed column. of_group: a table with a row for each group, whose other columns are added.
    Bins are summed first (partial aggregation, so a hot group costs a row per bin and task), their sums run up in two
    levels, and rows then run up inside their own bin. No task sees a whole group.
    """
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    run = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    more = [c for c in of_group.columns if c not in group] if of_group is not None else []
    fine = df.groupBy(*group, "_coarse", "_fine").agg(*[F.sum(v).alias(f"_s_{n}") for n, v in values.items()])
    coarse = fine.groupBy(*group, "_coarse").agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in values])
    outer, inner = W.partitionBy(*group).orderBy("_coarse"), W.partitionBy(*group, "_coarse").orderBy("_fine")
    coarse = coarse.select(*group, "_coarse", *[run(f"_t_{n}", outer).alias(f"_o_{n}") for n in values])
    if more:
        coarse = _beside(coarse, of_group, group)
    fine = fine.select(*group, "_coarse", "_fine", *[run(f"_s_{n}", inner).alias(f"_i_{n}") for n in values])
    fine = _beside(fine, coarse, [*group, "_coarse"])
    own = df.withColumns({f"_m_{n}": run(v, W.partitionBy(*group, "_coarse", "_fine").orderBy(*order)) for n, v in values.items()})
    out = _beside(own, fine, [*group, "_coarse", "_fine"])
    out = out.withColumns({n: (F.col(f"_m_{n}") + F.col(f"_i_{n}") + F.col(f"_o_{n}")).cast("long") for n in values})
    return out.drop(*[f"_{p}_{n}" for p in "mio" for n in values], "_coarse", "_fine")


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with right's other columns, by keys that are never null."""
    return left.join(right.select(*keys, *[c for c in right.columns if c not in keys]), keys)


#: Rows of a hot key that one task joins.
SALT_ROWS = 1000


def beside_hot(rows: DataFrame, other: DataFrame, key: str, scratch: Scratch, counted: DataFrame | None = None) -> DataFrame:
    """rows joined with other, which has one row for each key; keys with many rows are dealt out, other's row to each part.

    counted: (key, n), how many rows a key has, where that is known already; else it is counted here.
    """
    counts = counted.select(key, "n") if counted is not None else rows.groupBy(key).agg(F.count("*").alias("n"))
    hot = scratch.save(counts.where(F.col("n") > SALT_ROWS).select(key, F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("_parts")), "hot")
    if hot.isEmpty():
        return rows.join(other, key)
    salted = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    parts = other.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return salted.join(parts, [key, "_salt"]).drop("_salt")
