"""Named result tables of batch runs, with the previous run at hand.

Layout under a root folder: ``run_id=<id>/<table>`` for results and a ``_manifest_rows``
table (run_id, table_name), partitioned by run, that says what a run has written. A
table is listed once its data are complete, so a job that lost its way leaves nothing
half listed; a run that is dropped loses its part of the list first. The list is never
rewritten. Run ids sort by time; "previous" is the greatest id below the current one.

Column types are a contract between runs: ``_type_rows`` (run_id, table_name, schema)
holds the widest types that any run has needed so far. A run whose values would fit
narrower types is stored in the contract's, one that needs wider types widens it, and
``read_all`` shows all runs of a table in the widest. Text against numbers is refused.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import read_if_there, read_raw, write_table

_MANIFEST = "table_name string, run_id string"
_TYPES = "table_name string, schema string, run_id string"


def widest(spark: SparkSession, table: str, older: T.StructType, newer: T.StructType) -> T.StructType:
    """All columns of both schemas, each in a type that holds the values of both.

    The type is that of a union of both in Spark. An integer beside a float becomes a
    double, as a float does not hold it. Text beside another type is refused.
    """
    merged = {f.name: f for f in older}
    for field in newer:
        known = merged.get(field.name)
        if known is None or known.dataType == field.dataType:
            merged[field.name] = field
            continue
        pair = known.dataType, field.dataType
        if isinstance(pair[0], T.StringType) != isinstance(pair[1], T.StringType):
            names = " and ".join(t.simpleString() for t in pair)
            raise TypeError(f"column {field.name} of {table}: {names}")
        if any(isinstance(t, T.FloatType) for t in pair) and any(isinstance(t, T.IntegralType) for t in pair):
            merged[field.name] = T.StructField(field.name, T.DoubleType())
            continue
        sides = [spark.createDataFrame([], T.StructType([T.StructField("c", t)])) for t in pair]
        merged[field.name] = T.StructField(field.name, sides[0].union(sides[1]).schema["c"].dataType)
    return T.StructType([T.StructField(f.name, f.dataType) for f in merged.values()])


def in_types(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Columns cast to the types of the contract; columns that it lacks stay as they are."""
    known = {f.name: f.dataType for f in contract}
    casts = {
        f.name: F.col(f"`{f.name}`").cast(known[f.name])
        for f in df.schema
        if f.name in known and known[f.name] != f.dataType
    }
    return df.withColumns(casts) if casts else df


class RunStore:
    """Result tables by run and name."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._known: dict[str, T.StructType] | None = None
        self._written: dict[tuple[str, str], T.StructType] = {}

    def _path(self, run_id: str, name: str) -> str:
        return f"{self.root}/run_id={run_id}/{name}"

    def manifest(self) -> DataFrame:
        path = f"{self.root}/_manifest_rows"
        if read_if_there(self.spark, path) is None:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(path)

    def put(
        self, run_id: str, name: str, df: DataFrame, partition_by: list[str] | None = None
    ) -> DataFrame:
        """Write one table without listing it, in the contract's types, and return it as stored."""
        older = self.contract().get(name)
        if older is not None:
            df = in_types(df, widest(self.spark, name, older, df.schema))
        self._written[run_id, name] = df.schema
        write_table(df, self._path(run_id, name), partition_by)
        return self.read(run_id, name)

    def contract(self) -> dict[str, T.StructType]:
        """Types of every table that runs have published; read once per store."""
        if self._known is None:
            path, known = f"{self.root}/_type_rows", {}
            if read_if_there(self.spark, path) is not None:
                rows = self.spark.read.schema(_TYPES).parquet(path)
                for row in rows.orderBy("run_id").collect():  # one per run and table
                    found = T.StructType.fromJson(json.loads(row["schema"]))
                    older = known.get(row["table_name"], found)
                    known[row["table_name"]] = widest(self.spark, row["table_name"], older, found)
            self._known = known
        return self._known

    def put_all(
        self, run_id: str, tables: dict[str, DataFrame], parallel: int = 8
    ) -> dict[str, DataFrame]:
        """Write several tables, a few jobs at a time, to keep the cluster busy."""
        self.contract()  # read before the threads need it
        with ThreadPoolExecutor(parallel) as pool:
            stored = pool.map(lambda item: self.put(run_id, *item), tables.items())
            return dict(zip(tables, stored))

    def publish(self, run_id: str, names: list[str]) -> None:
        """List tables of a run; call it when all of them are written.

        Their types go first: a driver lost in between has widened the contract, which
        narrows nothing.
        """
        self._known = None  # another run may have published since
        known = dict(self.contract())
        for name in names:
            own = self._written.get((run_id, name)) or self.read(run_id, name).schema
            known[name] = widest(self.spark, name, known.get(name, own), own)
        # the contract as a whole, so that it outlives the runs that are dropped
        types = [(name, schema.json(), run_id) for name, schema in known.items()]
        rows = self.spark.createDataFrame(types, _TYPES).coalesce(1)
        rows.write.mode("append").partitionBy("run_id").parquet(f"{self.root}/_type_rows")
        self._known = known
        rows = self.spark.createDataFrame([(n, run_id) for n in names], _MANIFEST).coalesce(1)
        rows.write.mode("append").partitionBy("run_id").parquet(f"{self.root}/_manifest_rows")

    def write(self, run_id: str, tables: dict[str, DataFrame]) -> None:
        """Write the tables of a run, then list them."""
        self.put_all(run_id, tables)
        self.publish(run_id, list(tables))

    def names(self, run_id: str) -> DataFrame:
        """Tables a run has stored."""
        return (
            self.manifest()
            .filter(F.col("run_id") == run_id)
            .select("table_name")
            .distinct()
            .orderBy("table_name")
        )

    def has(self, run_id: str, name: str) -> bool:
        hit = self.manifest().filter(
            (F.col("run_id") == run_id) & (F.col("table_name") == name)
        )
        return not hit.isEmpty()

    def read(self, run_id: str, name: str) -> DataFrame:
        return read_raw(self.spark, self._path(run_id, name))

    def read_all(self, name: str) -> DataFrame:
        """A table of all listed runs as one, in the contract's types, with its ``run_id``.

        A column that a run lacks is null in its rows. The store keeps few runs.
        """
        runs = self.manifest().filter(F.col("table_name") == name).select("run_id").distinct()
        contract = self.contract()[name]
        parts = [
            in_types(self.read(r["run_id"], name), contract).withColumn("run_id", F.lit(r["run_id"]))
            for r in runs.orderBy("run_id").collect()
        ]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def previous(self, run_id: str) -> str | None:
        """Greatest run id below the given one."""
        row = self.manifest().filter(F.col("run_id") < run_id).agg(F.max("run_id")).first()
        return row[0]

    def current_and_previous(self) -> DataFrame:
        """The two runs a reader sees: the latest and the one before it."""
        return self.manifest().select("run_id").distinct().orderBy(F.desc("run_id")).limit(2)

    def drop_older(self, run_id: str) -> list[str]:
        """Keep a run and its previous one, drop the results of all before.

        Of each run its part of the manifest goes first, then its tables: readers never
        see a dropped table, and a driver lost in between leaves tables nobody lists.
        """
        keep = self.previous(run_id)
        if keep is None:
            return []
        runs = self.manifest().filter(F.col("run_id") < keep).select("run_id").distinct()
        old = sorted(r["run_id"] for r in runs.collect())  # one row per run
        for old_id in old:
            self._delete(f"{self.root}/_manifest_rows/run_id={old_id}")
            self._delete(f"{self.root}/_type_rows/run_id={old_id}")
            self._delete(f"{self.root}/run_id={old_id}")
        return old

    def _delete(self, folder: str) -> None:
        """Remove a folder of the store; Spark itself has no call for that."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
