"""Random access to text lines by an index of byte offsets.

The index is made in one pass by ranges of bytes, each of which finds the lines that begin in it, and
kept as a table in the order of its key, so that a look-up reads a few of its row groups. Asked lines
are read by seeks: the bytes read are those of the lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..operators.sizes import small
from . import store
from .ranged import RANGE_BYTES, Range, _dealt

_STEP = 1 << 20


class LineSource(DataSource):
    """(file, offset, length, value) of the lines of all files below option path whose names end in option ending."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "file string, offset long, length long, value string"

    def reader(self, schema) -> DataSourceReader:
        return LineReader(self.options["path"], self.options.get("ending", ""), int(self.options.get("rangeBytes", RANGE_BYTES)))


class LineReader(DataSourceReader):
    def __init__(self, root: str, ending: str, each: int):
        self.root, self.ending, self.each = root, ending, each

    def partitions(self) -> list[Range]:
        shown = [x for x in store.files(self.root, self.ending) if not x[0].rpartition("/")[2].startswith(("_", "."))]
        return _dealt(shown, self.each)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for file, k, of in partition.pieces:
            with store.opened(file) as f:
                rows: list[tuple[int, bytes]] = []
                held = 0
                for offset, line in lines_of(f, f.size() * k // of, f.size() * (k + 1) // of):
                    rows.append((offset, line))
                    held += len(line)
                    if held >= 4 * _STEP:
                        yield self._batch(file, rows)
                        rows, held = [], 0
                if rows:
                    yield self._batch(file, rows)

    @staticmethod
    def _batch(file: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        text = [x.decode("utf-8", "replace") for _, x in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * len(rows)), pa.array([o for o, _ in rows], pa.int64()), pa.array([len(x) for _, x in rows], pa.int64()), pa.array(text)],
            names=["file", "offset", "length", "value"])


def lines_of(f, low: int, high: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) of the lines that begin in [low, high); a line may end behind it."""
    at = low
    rest = b""
    if low:  # the line that begins before is another range's
        f.seek(low - 1)
        at = low - 1
        while True:
            data = f.read(_STEP)
            if not data:
                return
            cut = data.find(b"\n")
            if cut >= 0:
                at, rest = at + cut + 1, data[cut + 1 :]
                break
            at += len(data)
    else:
        f.seek(0)
    while at < high:
        parts, begin = [], 0
        while (cut := rest.find(b"\n", begin)) < 0:
            parts.append(rest[begin:])
            rest, begin = f.read(_STEP), 0
            if not rest:
                break
        if not rest:
            if line := b"".join(parts):
                yield at, line
            return
        parts.append(rest[begin:cut])
        line = b"".join(parts)
        yield at, line
        at, rest = at + len(line) + 1, rest[cut + 1 :]


def scan_lines(spark: SparkSession, path: str, ending: str = "", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, offset, length, value) of all lines of files below path; a file of k ranges is read by k tasks."""
    spark.dataSource.register(LineSource)
    return spark.read.format("lines").option("path", path).option("ending", ending).option("rangeBytes", range_bytes).load()


def write_offsets(spark: SparkSession, path: str, to: str, key: Column, ending: str = "", range_bytes: int = RANGE_BYTES) -> None:
    """The index of the lines below path, as the table `to`: (key, file, offset, length), in order of key. key: of the column value."""
    rows = scan_lines(spark, path, ending, range_bytes).select(key.cast("string").alias("key"), "file", "offset", "length")
    rows.repartitionByRange("key").sortWithinPartitions("key", "file", "offset").write.mode("overwrite").parquet(to)


def _sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds value: the bytes at (file, offset, length), a file open at a time."""
    for b in batches:
        rows = list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), range(b.num_rows), strict=True))
        values, name, f = [None] * len(rows), None, None
        for file, offset, length, i in sorted(rows):
            if file != name:
                if f:
                    f.close()
                name, f = file, store.opened(file)
            f.seek(offset)
            values[i] = f.read(length).decode("utf-8", "replace")
        if f:
            f.close()
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.string())], names=[*b.schema.names, "value"])


def lines_at(spots: DataFrame) -> DataFrame:
    """spots (file, offset, length, …) with the line that stands there as value; only these bytes are read."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spots.schema.fields)
    return spots.mapInArrow(_sought, f"{kind}, value string")


def read_lines(spark: SparkSession, index: str, wanted: DataFrame) -> DataFrame:
    """wanted (key, …) with the lines (value) of its keys, by the index at path `index`; a key that stands twice gives a row each time.

    Keys without a line have no row. Few keys are broadcast and found by the index's row groups."""
    held = spark.read.parquet(index)
    asked = small(wanted)
    bounds = wanted.agg(F.min("key").alias("low"), F.max("key").alias("high")).first()
    if bounds.low is None:
        held = held.where("false")
    else:
        held = held.where(F.col("key").between(bounds.low, bounds.high))
    return lines_at(held.join(asked, "key"))
