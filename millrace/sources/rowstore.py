"""A partitioned source over a store of rows that is not Spark's own: only the columns asked for are fetched, conditions are met where rows are read, and a cap counts the rows read.

``spark.read.format("rowstore")`` takes the options ``path``, ``columns`` (a comma list; default: all), ``limit`` (rows read
at most, in the store's order, whatever conditions keep of them) and ``where`` (conditions as a JSON list of column,
comparison and value, all of which hold). Conditions are an option and not what Spark pushes down by itself: a DataFrame of
a Python source that was filtered once keeps that filter in later plans (seen with 4.1.2), which loses rows. A store is cut into fragments, each with a number of
rows that is known without reading them; a fragment is a task's work, and fragments beyond the cap are not touched. Here
the store is Parquet behind any file system that Arrow opens by its address; another one needs ``fragments`` and ``batches``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from millrace.tables import let_workers_import

NAME = "rowstore"


@dataclass
class Fragment(InputPartition):
    """``rows`` rows from the beginning of a row group."""

    path: str
    group: int
    rows: int


class ParquetStore:
    def __init__(self, address: str) -> None:
        self.address = address
        if "://" not in address and not address.startswith("file:"):
            self.fs, self.root = pafs.LocalFileSystem(), address
        else:
            self.fs, self.root = pafs.FileSystem.from_uri(address.replace("file:/", "file:///", 1) if not address.startswith("file://") else address)

    def files(self) -> list[str]:
        if self.fs.get_file_info(self.root).type == pafs.FileType.File:
            return [self.root]
        found = self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True))
        return sorted(f.path for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))

    def schema(self) -> pa.Schema:
        return pq.read_schema(self.files()[0], filesystem=self.fs)

    def fragments(self, limit: int | None) -> Iterator[Fragment]:
        left = limit
        for path in self.files():
            with self.fs.open_input_file(path) as f:
                told = pq.ParquetFile(f).metadata
            for group in range(told.num_row_groups):
                rows = told.row_group(group).num_rows
                if left is not None:
                    rows = min(rows, left)
                    left -= rows
                if rows:
                    yield Fragment(path, group, rows)
                elif left == 0:
                    return

    def batches(self, fragment: Fragment, columns: list[str]) -> Iterator[pa.RecordBatch]:
        left = fragment.rows
        with self.fs.open_input_file(fragment.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=1024, row_groups=[fragment.group], columns=columns):
                yield batch.slice(0, min(left, batch.num_rows))
                left -= batch.num_rows
                if left <= 0:
                    return


_COMPARE = {"=": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}


def _keeps(batch: pa.RecordBatch, column: str, how: str, value: Any) -> pa.Array:
    """Nulls meet no condition but ``null``."""
    c = batch.column(column)
    if how in ("null", "there"):
        return c.is_null() if how == "null" else c.is_valid()
    if how == "in":
        return pc.fill_null(pc.is_in(c, pa.array(value, c.type)), False)
    return pc.fill_null(_COMPARE[how](c, pa.scalar(value, c.type)), False)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.address, self.columns = options["path"], schema.names
        self.limit = int(options["limit"]) if "limit" in options else None
        self.where: list[tuple[str, str, Any]] = json.loads(options.get("where", "[]"))

    def partitions(self) -> list[InputPartition]:
        return list(ParquetStore(self.address).fragments(self.limit))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Fragment):  # a store without rows has no fragment
            return
        fetched = list(dict.fromkeys([*self.columns, *(c for c, *_ in self.where)]))
        for batch in ParquetStore(self.address).batches(partition, fetched):
            for column, how, value in self.where:
                batch = batch.filter(_keeps(batch, column, how, value))
            if batch.num_rows:
                yield batch.select(self.columns)


class RowStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        told = ParquetStore(self.options["path"]).schema()
        asked = self.options.get("columns")
        return from_arrow_schema(told if asked is None else pa.schema([told.field(c) for c in asked.split(",")]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, limit: int | None = None, where: list[tuple[str, str, Any]] | None = None) -> DataFrame:
    """Rows of a store, of these columns only and the first ``limit`` at most, of which those are kept that meet ``where``: (column, one of = > >= < <= in null there, value)."""
    let_workers_import(spark)
    spark.dataSource.register(RowStore)
    options: dict[str, Any] = {"columns": ",".join(columns)} if columns else {}
    options |= {} if limit is None else {"limit": limit}
    options |= {"where": json.dumps(where)} if where else {}
    return spark.read.format(NAME).option("path", path).options(**options).load()
