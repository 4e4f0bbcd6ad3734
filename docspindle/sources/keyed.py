"""Tables with keys in Parquet folders, whose rows replace, keep or delete those of their key, batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOG = "batch long, bucket int, buckets int, rows long"
#: What happens to a key that the table has: its row is replaced, stays, or goes.
HOW = ("update", "keep", "delete")


class KeyedTable:
    """Rows of `schema` with unique `keys` under `path`, in `buckets` hash buckets.

    A batch reads and writes the buckets that its rows fall in, and no others, into a folder of its own;
    one log file that names them is its last step, and readers take each bucket from the newest
    batch in the log. So what a batch that died has written is not seen, and replaced when it runs again;
    a batch that is in the log changes nothing when it comes again. Numbers of batches rise; one writer at a time.

    Null is a key like others. Of a batch's rows with one key the greatest stays, by `newest` and then by
    all columns; columns that the schema lacks are not read. Choose `buckets` so that one fits a task; it can't change.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _exists(self, folder: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _delete(self, folder: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _log(self) -> DataFrame:
        log = f"{self.path}/log"
        return self.spark.read.schema(LOG).parquet(log) if self._exists(log) else self.spark.createDataFrame([], LOG)

    def _held(self) -> dict[int, tuple[int, int]]:
        """bucket -> its newest batch and how many rows that left: no more entries than buckets."""
        held = self._log().groupBy("bucket").agg(F.max(F.struct("batch", "rows", "buckets")).alias("x")).collect()
        if any(r.x.buckets != self.buckets for r in held):
            raise ValueError(f"{self.path} has another number of buckets than {self.buckets}")
        return {r.bucket: (r.x.batch, r.x.rows) for r in held}

    def _read(self, held: dict[int, tuple[int, int]]) -> DataFrame:
        folders = [f"{self.path}/rows/batch={b}/__bucket={k}" for k, (b, rows) in sorted(held.items()) if rows]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The rows as of the newest batch."""
        return self._read(self._held())

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Rows whose keys `wanted` has, from their buckets alone."""
        of = {r[0] for r in wanted.select(self._bucket()).distinct().collect()}
        found = self._read({k: v for k, v in self._held().items() if k in of})
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.keys]
        return found.alias("a").join(wanted.select(*self.keys).alias("b"), same, "left_semi")

    def merge(self, rows: DataFrame, number: int | None = None, how: str = "update", newest: tuple[str, ...] = ()) -> KeyedTable:
        """Takes a batch of rows (for "delete", of keys); without a number it is the next."""
        if how not in HOW:
            raise ValueError(f"how is one of {', '.join(HOW)}")
        held = self._held()
        last = max((b for b, _ in held.values()), default=-1)
        number = last + 1 if number is None else number
        if number <= last:
            return self
        names = self.keys if how == "delete" else self.schema.names
        kinds = {f.name: f.dataType for f in self.schema}
        # The batch is written once, so that both what it touches and what it holds come from the same rows.
        arrived = f"{self.path}/arrived"
        rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in names]).withColumn("__bucket", self._bucket()).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(arrived)
        new = self.spark.read.schema(self.spark.createDataFrame([], self.schema).select(*names).withColumn("__bucket", F.lit(0)).schema).parquet(arrived)
        touched = [r[0] for r in new.select("__bucket").distinct().collect()]
        if touched:
            old = self._read({k: held[k] for k in touched if k in held}).withColumn("__bucket", self._bucket()).withColumn("__new", F.lit(0))
            both = old.unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
            first = F.asc("__new") if how == "keep" else F.desc("__new")
            others = [c for c in names if c not in (*self.keys, *newest)]
            place = F.row_number().over(Window.partitionBy("__bucket", *self.keys).orderBy(first, *[F.desc(c) for c in (*newest, *others)]))
            # One shuffle: rows of a bucket meet, and within it those of a key.
            kept = both.repartition(len(touched), "__bucket").withColumn("__place", place).filter("__place = 1")
            if how == "delete":
                kept = kept.filter("__new = 0")
            folder = f"{self.path}/rows/batch={number}"
            kept.drop("__new", "__place").write.mode("overwrite").partitionBy("__bucket").parquet(folder)
            sizes = {r[0]: r[1] for r in self.spark.read.schema(kept.select(*self.schema.names, "__bucket").schema).parquet(folder).groupBy("__bucket").count().collect()}
            self._commit([(number, k, self.buckets, sizes.get(k, 0)) for k in touched])
        self._delete(arrived)
        return self

    def _commit(self, lines: list[tuple[int, int, int, int]]) -> None:
        """One file, which appears by one rename."""
        self.spark.createDataFrame(lines, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def clean(self) -> None:
        """Deletes what later batches replaced; readers that began before may miss it."""
        held = self._held()
        for r in self._log().filter("rows > 0").select("batch", "bucket").collect():
            if held[r.bucket][0] != r.batch:
                self._delete(f"{self.path}/rows/batch={r.batch}/__bucket={r.bucket}")


def start_merges(stream: DataFrame, table: KeyedTable, checkpoint: str, how: str = "update", newest: tuple[str, ...] = ()):
    """Merges the micro-batches of a stream of rows by their numbers, so each counts once though it run again."""
    return stream.writeStream.foreachBatch(lambda batch, number: table.merge(batch, number, how, newest) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
