"""The catalog of raw tables and of what is derived from them, as tables in one folder."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Parts of the merged index; a key's part is fixed by its hash.
INDEX_PARTS = 64


@dataclass
class Entry:
    """A raw table: where it lies and which of its columns are times, places (with their units) and measures."""

    tbl: str
    name: str
    path: str
    domain: str = ""
    link: str = ""
    t_attrs: list[str] = field(default_factory=list)
    s_attrs: list[tuple[str, str]] = field(default_factory=list)
    num_columns: list[str] = field(default_factory=list)
    descriptions: dict[str, str] = field(default_factory=dict)  # of columns

    def control_variables(self, counted: bool = False) -> list[str]:
        """Variables that may be held fixed: means of the measures; the count where there are none, or on request."""
        return [f"avg_{c}" for c in self.num_columns] + ["count"] * (counted or not self.num_columns)


class Catalog:
    """Entries and derived tables under ``root``, through Spark's readers and writers alone."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.entries: dict[str, Entry] = {}
        self.merged: list[str] = []  # roots of other catalogs whose derived tables are read with this one's

    def register(self, entry: Entry) -> Entry:
        self.entries[entry.tbl] = entry
        return entry

    def add_data_source(self, name: str, path: str, sample: int = 1000) -> Entry:
        """Register a CSV or Parquet table and label its columns by their values."""
        from tidemark.operators.labels import label_columns
        from tidemark.sources.csv import read_csv

        df = read_csv(self.spark, path) if path.endswith(".csv") else self.spark.read.parquet(path)
        found = label_columns(df, sample)
        return self.register(Entry(name, name, path, t_attrs=[c for c, _ in found["t_attrs"]], s_attrs=found["s_attrs"], num_columns=found["num_columns"]))

    def merge(self, other: Catalog) -> Catalog:
        """Entries, measures, statistics and profiles of both; of entries the other's win."""
        self.entries |= other.entries
        self.merged += [r for r in (other.root, *other.merged) if r != self.root and r not in self.merged]
        return self

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def save(self, df: DataFrame, name: str, provenance: dict) -> str:
        """``df`` as CSV files in a folder of this name, and beside it where it comes from, as JSON."""
        path = f"{self.root}/saved/{name}"
        df.write.mode("overwrite").option("header", True).csv(path)
        self.spark.createDataFrame([(json.dumps({"name": name, "columns": df.columns, **provenance}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.provenance")
        return path

    def provenance(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/saved/{name}.provenance").first()["value"])

    def read_raw(self, tbl: str) -> DataFrame:
        from tidemark.sources.csv import read_csv

        path = self.entries[tbl].path
        return read_csv(self.spark, path) if path.endswith(".csv") else self.spark.read.parquet(path)

    def select_columns(self, tbl: str, columns: list[str], joined: str | None = None, formats: dict[str, str] | None = None) -> DataFrame:
        """Columns of a raw table; ``formats`` gives patterns for times, ``joined`` the mark that puts all of them into one text."""
        shown = [F.date_format(c, formats[c]).alias(c) if formats and c in formats else F.col(c) for c in columns]
        rows = self.read_raw(tbl)
        return rows.select(F.concat_ws(joined, *shown).alias("value")) if joined is not None else rows.select(*shown)

    def write(self, name: str, df: DataFrame, partition_by: str | None = None, mode: str = "overwrite") -> None:
        writer = df.write.mode(mode)
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.root}/{name}")

    def _open(self, path: str) -> DataFrame:
        """A stored table; names of its parts stay text, whatever they look like."""
        df = self.spark.read.parquet(path)
        kinds = {"tbl": StringType(), "part": IntegerType()}
        if not set(kinds) & set(df.columns):
            return df
        return self.spark.read.schema(StructType([StructField(f.name, kinds.get(f.name, f.dataType)) for f in df.schema])).parquet(path)

    def read(self, name: str) -> DataFrame:
        others = [self._open(f"{r}/{name}") for r in self.merged if self._exists(f"{r}/{name}")]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, self.own(name))

    def own(self, name: str) -> DataFrame:
        """A table of this catalog alone."""
        return self._open(f"{self.root}/{name}")

    def has(self, name: str) -> bool:
        return self._exists(f"{self.root}/{name}")

    def replace_parts(self, name: str, df: DataFrame, by: str, parts: list) -> None:
        """Write ``df`` in place of the given parts of a table that is split by a column, and of these alone.

        Parts that get no rows are removed. The rows are staged first, so ``df`` may read the table itself, and a failed
        write leaves the old parts.
        """
        staged = f"{self.root}/{name}.staged-{uuid.uuid4().hex}"
        df.write.parquet(staged)
        rows = self.spark.read.schema(df.schema).parquet(staged)
        filled = {r[0] for r in rows.select(by).distinct().collect()}  # at most the given parts
        if filled - set(parts):
            raise ValueError(f"rows of other parts: {sorted(filled - set(parts))[:5]}")
        rows.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.root}/{name}")
        self.drop_parts(name, by, [v for v in parts if v not in filled])
        self._delete(staged)

    def drop_parts(self, name: str, by: str, parts: list) -> None:
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for v in parts:
            self._delete(f"{self.root}/{name}/{by}={escape(str(v))}")

    # The inverted index of a catalog that grows. ``keys`` holds each table's keys, split by raw table; ``index`` the
    # merged lists (kind, val, aggs, cnt), split by a hash of the key.

    def update_keys(self, fresh: DataFrame, tables: list[str]) -> None:
        """Make ``fresh`` (kind, agg, tbl, val) all the keys of these raw tables, in ``keys`` and in the merged index.

        Only keys that one of the tables gains or loses are merged: their lists are rewritten, with the other keys of
        the parts that they fall in. A second run after a failed one ends in the same index.
        """
        own = fresh.select("kind", "agg", "tbl", "val")
        old = self.own("keys").filter(F.col("tbl").isin(tables)).select(own.columns) if self.has("keys") else own.limit(0)
        gained, lost = own.join(old, own.columns, "left_anti"), old.join(own, own.columns, "left_anti")
        changed = gained.withColumn("more", F.lit(True)).unionByName(lost.withColumn("more", F.lit(False)))
        lists = changed.groupBy("kind", "val").agg(F.collect_set(F.when(F.col("more"), F.col("agg"))).alias("more"), F.collect_set(F.when(~F.col("more"), F.col("agg"))).alias("less"))
        place = F.pmod(F.xxhash64("kind", "val"), F.lit(INDEX_PARTS)).cast("int")
        staged = f"{self.root}/changes-{uuid.uuid4().hex}"
        lists.withColumn("place", place).write.parquet(staged)
        changes = self.spark.read.parquet(staged).withColumnRenamed("place", "part")
        parts = [r.part for r in changes.select("part").distinct().collect()]  # at most INDEX_PARTS
        if parts:
            empty = F.array().cast("array<string>")
            now = self.own("index").filter(F.col("part").isin(parts)).select("part", "kind", "val", "aggs") if self.has("index") else changes.select("part", "kind", "val", empty.alias("aggs")).limit(0)
            kept = F.array_except(F.coalesce("aggs", empty), F.coalesce("less", empty))
            merged = now.join(changes, ["part", "kind", "val"], "full_outer").select("part", "kind", "val", F.sort_array(F.array_union(kept, F.coalesce("more", empty))).alias("aggs"))
            self.replace_parts("index", merged.filter(F.size("aggs") > 0).withColumn("cnt", F.size("aggs").cast("long")), "part", parts)
        self.replace_parts("keys", own, "tbl", tables)
        self._delete(staged)

    def index(self) -> DataFrame:
        """kind, val, aggs, cnt of this catalog and those merged with it, one row a key."""
        rows = self.read("index").select("kind", "val", "aggs", "cnt")
        if not self.merged:
            return rows
        together = rows.groupBy("kind", "val").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("aggs")))).alias("aggs"))
        return together.withColumn("cnt", F.size("aggs").cast("long"))

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def read_agg(self, agg: str, variables: list[str] | None = None, round_dp: int | None = 3) -> DataFrame:
        """An aggregated table from the long form: ``val`` and its variables."""
        rows = self.read("measures").filter(F.col("agg") == agg)
        names = variables or [r["var"] for r in rows.select("var").distinct().collect()]
        x = F.bround("x", round_dp) if round_dp is not None else F.col("x")
        return rows.withColumn("x", x).groupBy("val").pivot("var", sorted(names)).agg(F.first("x"))

    def save_entries(self) -> None:
        lines = self.spark.createDataFrame([(json.dumps(asdict(e)),) for e in self.entries.values()], "value string")
        lines.coalesce(1).write.mode("overwrite").text(f"{self.root}/catalog")

    def load_entries(self) -> Catalog:
        for r in self.spark.read.text(f"{self.root}/catalog").collect():
            e = Entry(**json.loads(r["value"]))
            e.s_attrs = [tuple(a) for a in e.s_attrs]
            self.entries[e.tbl] = e
        return self

    def listing(self, t_units: tuple[str, ...] = ("month",)) -> list[tuple[str, str, str]]:
        """tbl, name, link of raw tables, each followed by the tables aggregated from it: by time, by place, by both."""
        out = []
        for e in self.entries.values():
            times = [(f"{t}_{u}", f"{t} ({u})") for t in e.t_attrs for u in t_units]
            places = [(f"{a}_{u}", f"{a} ({u})") for a, u in e.s_attrs]
            keys = times + places + [(f"{t}_{p}", f"{tn} and {pn}") for t, tn in times for p, pn in places]
            out += [(e.tbl, e.name, e.link), *((f"{e.tbl}_{k}", f"{e.name} aggregated by {n}", "") for k, n in keys)]
        return out

    def profile(self) -> dict[str, int]:
        """Counts of tables, of keys by kind, and of measures."""
        es = self.entries.values()
        return {
            "tables": len(es), "temporal": sum(len(e.t_attrs) for e in es), "spatial": sum(len(e.s_attrs) for e in es),
            "st": sum(len(e.t_attrs) * len(e.s_attrs) for e in es), "measures": sum(len(e.num_columns) for e in es),
        }

    def without_keyless(self) -> Catalog:
        self.entries = {t: e for t, e in self.entries.items() if e.t_attrs or e.s_attrs}
        return self
