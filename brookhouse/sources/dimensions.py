"""Dimension tables that take upserts: a folded base plus the batches since."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from ..functions import split_names
from ..operators.changes import latest_by_key
from ..schemas import SINK_DIM
from . import folders

_STORED = "id STRING, data MAP<STRING, STRING>, deleted BOOLEAN, batch BIGINT, seq BIGINT, sink_table STRING"


def _bucket(key: Column, buckets: int) -> Column:
    """The bucket of a key; a numeric key has one however it is written, as lookups compare its number."""
    return F.pmod(F.hash(F.coalesce(key.try_cast("bigint").cast("string"), key)), F.lit(buckets))


@dataclass(frozen=True)
class DimensionStore:
    """All dimension tables below one folder of the shared file system.

    A batch of changes is only appended (`delta/batch=<n>`; a repeated batch finds it
    written). `compact` folds base and deltas into a new base (`base/upto=<n>`), in the job or beside it.
    Every batch leaves a manifest (`manifest/batch=<n>`) that names the deltas not folded yet, and every fold a mark
    (`folds/upto=<n>`). Readers list both folders and open the last manifest: the same few calls however many
    batches there are. A folder that is being read is never written again; `vacuum` removes those no
    reader asks for any more. Data is partitioned by `sink_table`: a lookup reads its own table only.

    A base is cut by key into `buckets` per table, so that `near` reads those of some keys only. Choose as many as
    keep a bucket of the largest table within some 100 MB; each base remembers its own number.
    """

    spark: SparkSession
    root: str
    buckets: int = 16

    def apply(self, dims: DataFrame, batch_id: int, apply_deletes: bool = True, *, sequence: str | list[str]) -> None:
        """Append one batch of routed dimension rows `(type, data, sink_table, sink_pk)`.

        Rows of one key are reduced to the last by the columns of `sequence`, which must tell their
        order of arrival: the first column decides, the next ones among equals.
        """
        if not sequence:
            raise ValueError("changes of one key need a sequence")
        order = [sequence] if isinstance(sequence, str) else list(sequence)
        folder, manifest = f"{self.root}/delta/batch={batch_id}", f"{self.root}/manifest/batch={batch_id}"
        if folders.exists(self.spark, manifest):
            return
        rows = dims.select(
            F.try_element_at("data", F.col("sink_pk")).alias("id"),
            "data",
            (F.lit(apply_deletes) & (F.col("type") == "delete")).alias("deleted"),
            F.lit(batch_id).cast("bigint").alias("batch"),
            # A batch holds one row of a key, so `seq` need not tell more apart.
            F.lit(0).cast("bigint").alias("seq"),
            "sink_table", *[F.col(c).alias(f"_order{i}") for i, c in enumerate(order)],
        ).filter(F.col("id").isNotNull())
        places = [f"_order{i}" for i in range(len(order))]
        last = latest_by_key(rows, ["sink_table", "id"], places).drop(*places)
        # No reader looks at a folder before a manifest names it.
        last.write.mode("overwrite").partitionBy("sink_table").parquet(folder)
        _, deltas = self._live_folders(batch_id - 1)
        folders.write_text(self.spark, manifest, json.dumps([*deltas, batch_id]))

    def _live_folders(self, last_batch: int | None = None) -> tuple[int, list[int]]:
        """(number of the newest base or -1, numbers of the deltas after it), up to a batch or to the last."""
        within = lambda found: [n for n in found if last_batch is None or n <= last_batch]
        base = max(within(folders.numbers(self.spark, f"{self.root}/folds", "upto")), default=-1)
        manifests = within(folders.numbers(self.spark, f"{self.root}/manifest", "batch"))
        deltas = json.loads(folders.read_text(self.spark, f"{self.root}/manifest/batch={manifests[-1]}")) if manifests else []
        return base, [n for n in deltas if n > base]

    def _read(self, paths: list[str], more: str = "") -> DataFrame:
        parts = [self.spark.read.schema(_STORED + more).option("basePath", path).parquet(path) for path in paths]
        return reduce(DataFrame.unionByName, parts)

    def _base(self, upto: int, asked: DataFrame | None) -> DataFrame:
        """The rows of a base; with `asked`, keys in a column `id`, only the buckets these fall into."""
        text = folders.read_text(self.spark, f"{self.root}/folds/upto={upto}")
        rows = self._read([f"{self.root}/base/upto={upto}"], ", bucket INT")
        if asked is not None and text:
            wanted = asked.filter("id IS NOT NULL").select(_bucket(F.col("id"), json.loads(text)["buckets"]).alias("bucket")).distinct()
            # Numbers of buckets: no more than the base has.
            rows = rows.filter(F.col("bucket").isin([row["bucket"] for row in wanted.collect()]))
        return rows.drop("bucket")

    def _live(self, last_batch: int | None = None, table: str | None = None, asked: DataFrame | None = None) -> DataFrame | None:
        """Current rows, of one table or of all, up to a batch or to the last; with `asked` at least those of its keys.

        Base keys are unique, so only the deltas are reduced to one row per key. The
        base then loses the keys the deltas name, by an anti join against the small
        side: as long as Spark can broadcast those keys, the base does not shuffle.
        """
        upto, numbers = self._live_folders(last_batch)
        deltas = [f"{self.root}/delta/batch={n}" for n in numbers]
        mine = F.lit(True) if table is None else F.col("sink_table") == table
        base = self._base(upto, asked).filter(mine) if upto >= 0 else None
        if not deltas:
            return base
        changed = latest_by_key(self._read(deltas).filter(mine), ["sink_table", "id"], ["batch", "seq"])
        live = changed.filter(~F.col("deleted"))
        if base is None:
            return live
        keys = self._read(deltas).filter(mine).select("sink_table", "id")
        return base.join(keys, ["sink_table", "id"], "left_anti").select(*live.columns).unionByName(live)

    def compact(self, upto: int) -> None:
        """Fold everything up to a batch into a new base; keys deleted by then are gone."""
        mark = f"{self.root}/folds/upto={upto}"
        if folders.exists(self.spark, mark):
            return
        live = self._live(last_batch=upto)
        if live is not None:
            cut = live.withColumn("bucket", _bucket(F.col("id"), self.buckets)).repartition("sink_table", "bucket")
            cut.write.mode("overwrite").partitionBy("sink_table", "bucket").parquet(f"{self.root}/base/upto={upto}")
            folders.write_text(self.spark, mark, json.dumps({"buckets": self.buckets}))

    def vacuum(self) -> None:
        """Remove what the last two folds have replaced: readers that began before the last fold still find theirs."""
        folds = folders.numbers(self.spark, f"{self.root}/folds", "upto")
        if len(folds) < 2:
            return
        keep = folds[-2]
        last = max(folders.numbers(self.spark, f"{self.root}/manifest", "batch"), default=-1)
        old = {"folds/upto": lambda n: n < keep, "base/upto": lambda n: n < keep, "delta/batch": lambda n: n <= keep,
               "manifest/batch": lambda n: n < min(keep, last)}
        for name, gone in old.items():
            folder, prefix = name.split("/")
            for n in folders.numbers(self.spark, f"{self.root}/{folder}", prefix):
                if gone(n):
                    folders.remove(self.spark, f"{self.root}/{folder}/{prefix}={n}")

    def table(self, name: str, columns: list[str]) -> DataFrame:
        """Current rows of one dimension: string columns in upper case, `ID` the key.

        A table that never got a row is empty, with the same columns.
        """
        return self._columns(self._live(table=name), columns)

    def near(self, name: str, columns: list[str], keys: DataFrame) -> DataFrame:
        """The same with at least the rows of some keys, given in the only column of `keys`.

        Other rows of their buckets may come with them; buckets without a key are not read. The keys are read
        twice, here and by the lookup: keep a costly batch in memory.
        """
        asked = keys.select(F.col(f"`{keys.columns[0]}`").cast("string").alias("id"))
        return self._columns(self._live(table=name, asked=asked), columns)

    def _columns(self, live: DataFrame | None, columns: list[str]) -> DataFrame:
        others = [c for c in columns if c.lower() != "id"]
        if live is None:
            schema = ", ".join(f"`{c}` STRING" for c in ["ID", *[c.upper() for c in others]])
            return self.spark.createDataFrame([], schema)
        return live.selectExpr("id AS `ID`", *[f"try_element_at(data, '{c}') AS `{c.upper()}`" for c in others])

    def tables(self, rules: DataFrame) -> dict[str, DataFrame]:
        """Every dimension table the rules call for, by name: a table per rule, made without code of its own.

        Columns are those of the rule, under their own names. The key column comes first and is text. A column is text as
        well unless `sink_extend` gives its type, as in `price DECIMAL(16,2), level INT`; a value that does not fit is null.
        """
        found: dict[str, list] = {}
        # Rules are configuration: a row per column of a table.
        for row in table_columns(rules).collect():
            found.setdefault(row["sink_table"], []).append(row)
        made = {}
        for name, columns in found.items():
            columns.sort(key=lambda row: row["position"])
            key = next((row["column"] for row in columns if row["is_key"]), "id")
            kinds = {f.name: f.dataType for f in StructType.fromDDL(columns[0]["extension"]).fields} if columns[0]["extension"] else {}
            others = list(dict.fromkeys(row["column"] for row in columns if row["column"] != key))
            live = self._live(table=name)
            if live is None:
                live = self.spark.createDataFrame([], _STORED)
            made[name] = live.select(F.col("id").alias(key), *[
                F.try_element_at("data", F.lit(c)).try_cast(kinds.get(c, StringType())).alias(c) for c in others])
        return made


@dataclass(frozen=True)
class StoredDimension:
    """One dimension of a store, read when a lookup asks: `near` gives the buckets of the keys asked for."""

    store: DimensionStore
    name: str
    columns: list[str]

    def near(self, keys: DataFrame) -> DataFrame:
        return self.store.near(self.name, self.columns, keys)


def table_columns(rules: DataFrame) -> DataFrame:
    """Columns of the dimension tables the rules call for, as rows.

    Only rules that send inserts to a dimension make a table. Every column is text;
    the key is `id` unless the rule names another, the extension is empty unless given.
    """
    tables = rules.filter((F.col("sink_type") == SINK_DIM) & (F.col("operate_type") == "insert"))
    return tables.select(
        "sink_table",
        F.posexplode(split_names("sink_columns")).alias("position", "column"),
        F.coalesce("sink_pk", F.lit("id")).alias("_pk"),
        F.coalesce("sink_extend", F.lit("")).alias("extension"),
    ).select(
        "sink_table", "position", "column", F.lit("STRING").alias("kind"),
        (F.col("column") == F.col("_pk")).alias("is_key"), "extension",
    )
