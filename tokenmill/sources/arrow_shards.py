"""A Spark data source over a directory of Arrow IPC shards.

``spark.read.format("arrow_shards").load(path)`` reads
``data-NNNNN-of-MMMMM.arrow`` files (or one ``.arrow`` file). A shard in the
IPC *file* format is as many input partitions as its size asks for, each a
run of its record batches; one in the IPC *stream* format, which has no
footer, is one. Record batches go to Spark as they are (no per-row Python),
and of the columns only those of the schema are read.
Columns ``_shard`` and ``_row`` (row number inside the shard) keep the
storage order available for order-sensitive operators.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import fs

#: Bytes of a shard that one task reads.
SPLIT_BYTES = 128 << 20
ORDER_COLUMNS = {"_shard": "int", "_row": "bigint"}


def find_shards(path: str) -> list[str]:
    """Shard files in name order; a single .arrow file is accepted as is.
    Plain paths and URIs (shared storage) both work."""
    if fs.is_file(path):
        if not path.endswith(".arrow"):
            raise ValueError(f"not an .arrow file: {path}")
        return [path]
    if not fs.exists(path):
        raise FileNotFoundError(path)
    names = [f for f in fs.list_files(path) if f.endswith(".arrow")]
    shards = [f for f in names if re.search(r"data-\d+-of-\d+\.arrow$", f)]
    files = shards or names
    if not files:
        raise FileNotFoundError(f"no .arrow shards under {path}")
    return files


def iter_batches(fp: str):
    """Record batches of one shard, one at a time: IPC file format first,
    then stream format."""
    with fs.open_input(fp) as f:
        try:
            reader = ipc.open_file(f)
        except pa.ArrowInvalid:
            reader = None
        if reader is not None:
            for i in range(reader.num_record_batches):
                yield reader.get_batch(i)
            return
    with fs.open_input(fp) as f:
        yield from ipc.open_stream(f)


def shard_schema(fp: str) -> pa.Schema:
    with fs.open_input(fp) as f:
        try:
            return ipc.open_file(f).schema
        except pa.ArrowInvalid:
            pass
    with fs.open_input(fp) as f:
        return ipc.open_stream(f).schema


def open_batches(fp: str):
    """All record batches of one shard and its schema (small shards, tests)."""
    return list(iter_batches(fp)), shard_schema(fp)


def _spark_type(t: pa.DataType) -> str:
    if pa.types.is_int8(t):
        return "tinyint"
    if pa.types.is_int16(t):
        return "smallint"
    if pa.types.is_int32(t):
        return "int"
    if pa.types.is_int64(t):
        return "bigint"
    if pa.types.is_float32(t):
        return "float"
    if pa.types.is_float64(t):
        return "double"
    if pa.types.is_boolean(t):
        return "boolean"
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "string"
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return f"array<{_spark_type(t.value_type)}>"
    raise TypeError(f"unsupported Arrow type {t}")


class _Part(InputPartition):
    """Part ``part`` of the ``parts`` equal runs of record batches of one shard."""

    def __init__(self, index: int, path: str, part: int, parts: int):
        super().__init__(index)
        self.path, self.part, self.parts = path, part, parts


class ArrowShardReader(DataSourceReader):
    def __init__(self, path: str, schema, split_bytes: int):
        self.path = path
        self.names = list(schema.fieldNames())
        self.split_bytes = split_bytes

    def partitions(self):
        """By file sizes alone: the driver opens no shard, however many there are."""
        sizes = dict(fs.list_sizes(self.path))
        out = []
        for i, p in enumerate(find_shards(self.path)):
            parts = max(1, -(-sizes[p] // self.split_bytes))
            out += [_Part(i, p, k, parts) for k in range(parts)]
        return out

    def read(self, partition):
        wanted = [n for n in self.names if n not in ORDER_COLUMNS]
        with fs.open_input(partition.path) as f:
            try:
                reader = ipc.open_file(f, options=self._only(f, wanted))
            except pa.ArrowInvalid:
                reader = None
            if reader is not None:
                n = reader.num_record_batches
                first, stop = partition.part * n // partition.parts, (partition.part + 1) * n // partition.parts
                row = self._rows_before(f, first) if "_row" in self.names and first < stop else 0
                for i in range(first, stop):
                    b = reader.get_batch(i)  # one batch in memory at a time
                    yield self._row_batch(b, partition.value, row)
                    row += b.num_rows
                return
        if partition.part == 0:  # a stream has no footer: one task reads it from its start
            row = 0
            with fs.open_input(partition.path) as f:
                for b in ipc.open_stream(f):
                    yield self._row_batch(b, partition.value, row)
                    row += b.num_rows

    @staticmethod
    def _only(f, names) -> ipc.IpcReadOptions:
        """Options that read the buffers of these columns alone (of the first one for a mere row count)."""
        schema = ipc.open_file(f).schema
        return ipc.IpcReadOptions(included_fields=[schema.get_field_index(n) for n in names] or [0])

    @staticmethod
    def _rows_before(f, first: int) -> int:
        """Rows of the record batches before ``first``, from the narrowest column."""
        schema = ipc.open_file(f).schema
        widths = [t.bit_width if pa.types.is_primitive(t) else 1 << 30 for t in schema.types]
        reader = ipc.open_file(f, options=ipc.IpcReadOptions(included_fields=[widths.index(min(widths))]))
        return sum(reader.get_batch(i).num_rows for i in range(first))

    def _row_batch(self, b: pa.RecordBatch, shard: int, row: int) -> pa.RecordBatch:
        own = {"_shard": lambda: pa.array([shard] * b.num_rows, pa.int32()),
               "_row": lambda: pa.array(range(row, row + b.num_rows), pa.int64())}
        cols = [own[n]() if n in own else b.column(n) for n in self.names]
        return pa.RecordBatch.from_arrays(cols, names=self.names)


class ArrowShardSource(DataSource):
    @classmethod
    def name(cls):
        return "arrow_shards"

    def schema(self):
        return ", ".join(columns_ddl(self.options.get("path")))

    def reader(self, schema):
        return ArrowShardReader(self.options.get("path"), schema, int(self.options.get("splitBytes", SPLIT_BYTES)))


def columns_ddl(path: str, columns=None) -> list[str]:
    """``name type`` of the shards' columns and of the order columns, or of the chosen ones."""
    sch = shard_schema(find_shards(path)[0])
    types = {**{f.name: _spark_type(f.type) for f in sch}, **ORDER_COLUMNS}
    return [f"`{c}` {types[c]}" for c in (types if columns is None else columns)]


def register(spark) -> None:
    spark.dataSource.register(ArrowShardSource)


def scan_arrow_shards(spark, path: str, columns=None, split_bytes: int = SPLIT_BYTES):
    """Rows of the shards at ``path``. With ``columns`` (``_shard`` and ``_row`` among them, if wanted) only these are
    read from storage; a task reads about ``split_bytes`` of a shard in the IPC file format."""
    register(spark)
    reader = spark.read.format("arrow_shards").option("splitBytes", split_bytes)
    if columns is not None:
        reader = reader.schema(", ".join(columns_ddl(path, columns)))
    return reader.load(path)
