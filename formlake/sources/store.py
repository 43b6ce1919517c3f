"""Documents kept as versioned rows: appended, the latest version read, one key looked up in its own part, old versions compacted away.

A store is a folder of generations (gen=0, gen=1, ...) of parquet rows, dealt by their keys' hash over `part` folders. An append adds rows with
a number `version` that is greater than all before; a row whose `gone` is true deletes its key. Compaction writes the latest rows as
the next generation, which counts once its last file, _SUCCESS, is there: an attempt that a lost driver left behind is written anew, and readers stay with the
generation before until then. One writer at a time; readers need no lock. `vacuum` removes generations that no reader can still be using.

Edge cases: null keys are a key like any other; rows of one append that share a key are ordered by their other columns, the greatest one stays; an empty
append changes nothing but the version; a store without rows reads as an empty table of the given schema; columns named version, gone or part are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OWN = ("version", "gone", "part")


class Store:
    """path: a folder that all executors share; keys: column names; schema: of the rows, keys included; parts: how many folders keys are dealt over."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], parts: int = 64):
        self.spark, self.path, self.keys, self.parts = spark, path.rstrip("/"), keys, parts
        self.columns = spark.createDataFrame([], schema).schema.names
        self.schema = f"{schema}, version long, gone boolean, part int"
        if clash := set(OWN) & set(self.columns):
            raise ValueError(f"reserved column names: {sorted(clash)}")

    def _at(self, path: str):
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), found

    def _generations(self) -> list[int]:
        fs, at = self._at(self.path)
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[4:]) for n in names if n.startswith("gen=") and fs.exists(self._at(f"{self.path}/{n}/_SUCCESS")[1]))

    def _folder(self, generation: int | None = None) -> str:
        return f"{self.path}/gen={(self._generations() or [0])[-1] if generation is None else generation}"

    def rows(self) -> DataFrame:
        """All versions of the generation that counts."""
        if not self._generations():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._folder())

    def _part(self, values: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*values), F.lit(self.parts)).cast("int")

    def append(self, df: DataFrame, gone: bool = False) -> int:
        """Adds df's rows as the next version, which is returned; with gone, their keys are deleted (further columns may be missing)."""
        version = (self.rows().agg(F.max("version")).first()[0] or 0) + 1
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], self.schema).schema}
        own = df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in self.columns])
        out = own.withColumns({"version": F.lit(version).cast("long"), "gone": F.lit(gone), "part": self._part([F.col(k) for k in self.keys])})
        # one task a part, so that an append adds at most one file to each
        out.repartition(self.parts, "part").write.partitionBy("part").mode("append").parquet(self._folder())
        return version

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.columns if c not in self.keys]
        newest = rows.groupBy("part", *self.keys).agg(F.max(F.struct("version", "gone", *rest)).alias("r"))
        return newest.where("not r.gone").select("part", "r.version", *[c if c in self.keys else F.col("r")[c].alias(c) for c in self.columns])

    def latest(self) -> DataFrame:
        """The latest row of each key that isn't deleted."""
        return self._latest(self.rows()).select(*self.columns)

    def get(self, **key) -> DataFrame:
        """The latest row of one key: only the folder of its part is read."""
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], self.schema).schema}
        values = [F.lit(key[k]).cast(kinds[k]) for k in self.keys]
        part = self.spark.range(1).select(self._part(values)).first()[0]
        rows = self.rows().where(F.col("part") == part)
        for k, v in zip(self.keys, values, strict=True):
            rows = rows.where(F.col(k).eqNullSafe(v))
        return self._latest(rows).select(*self.columns)

    def compact(self) -> int:
        """Writes the latest rows, with their versions, as the next generation; its number."""
        now = (self._generations() or [0])[-1] + 1
        kept = self._latest(self.rows()).select(*self.columns, "version", F.lit(False).alias("gone"), "part")
        kept.repartition(self.parts, "part").write.partitionBy("part").mode("overwrite").parquet(self._folder(now))
        return now

    def vacuum(self) -> list[int]:
        """Removes all generations but the one that counts."""
        old = self._generations()[:-1]
        for g in old:
            fs, at = self._at(self._folder(g))
            fs.delete(at, True)
        return old
