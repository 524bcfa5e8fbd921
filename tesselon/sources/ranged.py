"""Array files that are read by ranges: data sources `npy` and `dat`, and the writer of `dat`.

A file is cut by bytes into as many ranges as its size asks for, each the partition of a task, so
that files of any size are read in parallel and only the asked rows are touched. The driver lists
names and sizes and never opens a data file. Filters on the key columns are pushed down to ranges
and seeks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage)

from . import store

SERIES = "path string, n int, c int, values array<double>, error string"
#: Bytes of a file that a task reads.
RANGE_BYTES = 64 << 20
#: Bytes that are read at once.
_CHUNK = 4 << 20


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session, with filters that they may take over."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (NpySource, DatSource):
        spark.dataSource.register(source)


class Wanted:
    """Values of key columns that filters leave: bounds and sets."""

    def __init__(self, columns: tuple[str, ...]):
        self.low, self.high, self.among, self.columns = {}, {}, {}, columns

    def take(self, f: Filter) -> bool:
        """Takes a filter over if it is a comparison of a key column with constants."""
        name = getattr(f, "attribute", ("",))[0]
        if name not in self.columns or len(f.attribute) > 1:
            return False
        if isinstance(f, (EqualTo, In)):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.among[name] = self.among.get(name, values) & values
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and isinstance(f.value, int):
            self.low[name] = max(self.low.get(name, f.value), f.value + isinstance(f, GreaterThan))
        elif isinstance(f, (LessThan, LessThanOrEqual)) and isinstance(f.value, int):
            self.high[name] = min(self.high.get(name, f.value), f.value - isinstance(f, LessThan))
        else:
            return False
        return True

    def any(self, *names: str) -> bool:
        return any(n in held for n in names for held in (self.low, self.high, self.among))

    def text(self, name: str, value: str) -> bool:
        return name not in self.among or value in self.among[name]

    def numbers(self, name: str, low: int, high: int) -> np.ndarray:
        """The wanted numbers of [low, high)."""
        low, high = max(low, self.low.get(name, low)), min(high, self.high.get(name, high) + 1)
        if name in self.among:
            return np.array(sorted(x for x in self.among[name] if x is not None and low <= x < high), np.int64)
        return np.arange(low, max(low, high))


@dataclass
class Range(InputPartition):
    """Pieces (file, number of the piece, pieces of the file) that a task reads."""

    pieces: list[tuple]

    def __init__(self, pieces: list[tuple]):
        super().__init__(None)
        self.pieces = pieces


def _dealt(files: list[tuple[str, int]], each: int) -> list[Range]:
    """Files in pieces of about `each` bytes; small files share a task."""
    out, held, waiting = [], [], 0
    for path, size in files:
        k = max(1, -(-size // each))
        if k > 1:
            out += [Range([(path, i, k)]) for i in range(k)]
            continue
        held.append((path, 0, 1))
        waiting += size + 4096
        if waiting >= each:
            out, held, waiting = [*out, Range(held)], [], 0
    return [*out, Range(held)] if held else out or [Range([])]


def _runs(rows: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, count) of neighbouring rows, at most so many together."""
    cuts = np.flatnonzero(np.diff(rows) != 1) + 1
    for part in np.split(rows, cuts):
        for at in range(0, len(part), most):
            yield int(part[at]), len(part[at : at + most])


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of numbers as one Arrow array of lists, NaN as NULL."""
    flat = np.ascontiguousarray(x).reshape(-1)
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if x.ndim > 1 else 1)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind, mask=np.isnan(flat)))


# npy -----------------------------------------------------------------------------------------


class NpySource(DataSource):
    """Series of .npy files of three dimensions below option path; option rangeBytes: bytes a task reads."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SERIES

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


class NpyReader(DataSourceReader):
    def __init__(self, root: str, each: int):
        self.root, self.each, self.wanted = root, each, Wanted(("path", "n", "c"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Range]:
        return _dealt([x for x in store.files(self.root, ".npy") if self.wanted.text("path", x[0])], self.each)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for path, k, of in partition.pieces:
            try:
                with store.opened(path) as f:
                    yield from self._piece(f, path, k, of)
            except (OSError, ValueError, EOFError) as e:
                if not k and not self.wanted.any("n", "c"):  # a file that can't be read is one row, which has no numbers
                    yield self._batch(path, np.zeros(0), np.zeros(0), None, str(e))

    @staticmethod
    def _batch(path: str, n: np.ndarray, c: np.ndarray, values: np.ndarray | None, error: str | None = None) -> pa.RecordBatch:
        size = 1 if error else len(n)
        numbers = [pa.array([None] if error else x, pa.int32()) for x in (n, c)]
        rows = pa.array([None], pa.list_(pa.float64())) if error else _lists(values.astype(np.float64), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([path] * size), *numbers, rows, pa.array([error] * size, pa.string())], names=["path", "n", "c", "values", "error"])

    def _piece(self, f, path: str, k: int, of: int) -> Iterator[pa.RecordBatch]:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, kind = read(f)
        start = f.tell()
        if len(shape) != 3:
            raise ValueError(f"{len(shape)} dimensions")
        if kind.hasobject or kind.kind not in "fiub":
            raise ValueError(f"values of type {kind}")
        if start + int(np.prod(shape, dtype=np.int64)) * kind.itemsize > f.size():
            raise ValueError("the file ends too early")
        n_all, c_all, width = shape
        if fortran:  # such files lie the other way round: one task reads them whole
            if k:
                return
            k, of = 0, 1
            f.seek(start)
            whole = np.frombuffer(f.read(), kind).reshape(shape, order="F")
        some_n, some_c = self.wanted.numbers("n", n_all * k // of, n_all * (k + 1) // of), self.wanted.numbers("c", 0, c_all)
        step = max(1, _CHUNK // max(1, c_all * width * kind.itemsize))
        for at in range(0, len(some_n), step):
            n, c = (x.reshape(-1) for x in np.meshgrid(some_n[at : at + step], some_c, indexing="ij"))
            if not len(n):
                continue
            if fortran:
                yield self._batch(path, n, c, whole[n, c])
                continue
            parts = []
            for first, count in _runs(n * c_all + c, max(1, _CHUNK // max(1, width * kind.itemsize))):
                f.seek(start + first * width * kind.itemsize)
                parts.append(np.frombuffer(f.read(count * width * kind.itemsize), kind))
            yield self._batch(path, n, c, np.concatenate(parts).reshape(len(n), width))


def scan_npy(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, n, c, values, error) of every .npy file below root, a row a series; NaN becomes NULL.

    A file of k ranges is read by k tasks; filters on path, n and c decide which files and which of their
    bytes are read. A file that can't be read, or doesn't hold numbers in three dimensions, is one row with
    an error. A folder without files gives no rows."""
    register(spark)
    return spark.read.format("npy").option("path", root).option("rangeBytes", range_bytes).load()


def write_npy(df: DataFrame, path: str) -> None:
    """Series (file, n, c, values) as path/<file>.npy, float32; what is missing or NULL is NaN, shorter series are filled up.

    A task streams a file's rows in order and moves it in place when it is whole, so a repeated task is harmless."""
    shape = df.groupBy("file").agg((F.max("n") + 1).alias("n_all"), (F.max("c") + 1).alias("c_all"), F.max(F.size("values")).alias("width"))
    rows = df.join(shape, "file").select("file", "n", "c", "values", "n_all", "c_all", "width")
    # by file and width, which dealing by file alone is not: Spark leaves that out where the join has dealt so, and then may read the join's sides by mapper
    rows = rows.repartition("file", "width").sortWithinPartitions("file", "n", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = out = None
        done, total, width = 0, 0, 0
        new = ""

        def fill(to: int) -> None:
            nonlocal done
            while done < to:
                step = min(to - done, max(1, _CHUNK // max(1, 4 * width)))
                out.write(np.full(step * width, np.nan, "<f4").tobytes())
                done += step

        def close() -> None:
            fill(total)
            out.close()
            store.move(new, f"{path}/{name}.npy")

        for b in batches:
            for file, n, c, values, n_all, c_all, w in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if file != name:
                    if out:
                        close()
                    name, done, total, width, new = file, 0, n_all * c_all, w, f"{path}/{file}.{uuid.uuid4().hex}.part"
                    out = store.created(new)
                    np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": (n_all, c_all, w)})
                fill(n * c_all + c)
                out.write(np.array([np.nan if v is None else v for v in values] + [np.nan] * (w - len(values)), "<f4").tobytes())
                done += 1
        if out:
            close()
            out = None
        yield pa.RecordBatch.from_arrays([pa.array([name] if name is not None else [], pa.string())], names=["last"])

    rows.mapInArrow(run, "last string").write.format("noop").mode("overwrite").save()


# dat -----------------------------------------------------------------------------------------


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: its place in the order, its file, rows and their width, and a checksum."""

    number: int
    name: str
    rows: int
    width: int
    crc: int


class DatSource(DataSource):
    """Raw float32 rows. Option path: a folder that the writer made, or one file, for which `width` is needed.

    Option frame ("nodes,features"): a row is a frame of a panel, and the columns are (t, node, values);
    options nodes and features: numbers, comma-separated, of those to be read."""

    @classmethod
    def name(cls) -> str:
        return "dat"

    def schema(self) -> str:
        return "t long, node int, values array<float>" if "frame" in self.options else "row long, values array<float>"

    def reader(self, schema) -> DataSourceReader:
        return DatReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return DatWriter(self.options["path"], overwrite)


class DatWriter(DataSourceArrowWriter):
    """Rows in two phases. Each task writes files of its own and says how many rows they have; the commit adds these up in
    the order of partitions, moves the files in place and writes shape.json last. What no message names, the leftovers of
    failed and repeated tasks, goes. Columns other than values are kept beside, as the table path/meta."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.token = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        number = task.partitionId() if task else 0
        name = f"part-{number:05d}-{uuid.uuid4().hex}"
        rows = crc = 0
        width, meta, out = -1, None, None
        try:
            for b in iterator:
                if not b.num_rows:
                    continue
                values = b.column("values")
                flat = values.flatten().to_numpy(zero_copy_only=False).astype("<f4")
                wide = pc.unique(pc.list_value_length(values)).to_pylist()
                width = wide[0] if width < 0 else width
                if wide != [width]:
                    raise ValueError(f"rows of {wide} numbers among rows of {width}")
                beside = pa.Table.from_batches([b]).drop_columns(["values"])
                beside = beside.append_column("part_", pa.array([number] * b.num_rows, pa.int32())).append_column("place_", pa.array(range(rows, rows + b.num_rows), pa.int64()))
                if out is None:
                    out = store.created(f"{self.path}/{self.token}/{name}.dat")
                    side = store.created(f"{self.path}/{self.token}/{name}.parquet")
                    meta = pq.ParquetWriter(side, beside.schema)
                out.write(flat.tobytes())
                meta.write_table(beside)
                crc, rows = crc32(flat.tobytes(), crc), rows + b.num_rows
        finally:
            if out:
                out.close()
                meta.close()
                side.close()
        return Part(number, name, rows, width, crc)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.number)
        if len({m.width for m in parts}) > 1:
            self.abort(messages)
            raise ValueError(f"rows of different widths: {sorted({m.width for m in parts})}")
        if store.size(f"{self.path}/shape.json") is not None:
            if not self.overwrite:
                self.abort(messages)
                raise ValueError(f"{self.path} is written already")
            for name in ("shape.json", "data", "meta"):
                store.drop(f"{self.path}/{name}")
        first, held = 0, []
        for m in parts:
            store.move(f"{self.path}/{self.token}/{m.name}.dat", f"{self.path}/data/{m.name}.dat")
            store.move(f"{self.path}/{self.token}/{m.name}.parquet", f"{self.path}/meta/{m.name}.parquet")
            held.append({"file": f"data/{m.name}.dat", "part": m.number, "first": first, "rows": m.rows, "crc32": m.crc})
            first += m.rows
        store.drop(f"{self.path}/{self.token}")
        store.put_json({"shape": [first, parts[0].width if parts else 0], "dtype": "float32", "parts": held}, f"{self.path}/shape.json")

    def abort(self, messages: list[Part | None]) -> None:
        store.drop(f"{self.path}/{self.token}")


class DatReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.frame = options["path"], [int(x) for x in options["frame"].split(",")] if "frame" in options else None
        self.each = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.width = int(options.get("width", self.frame[0] * self.frame[1] if self.frame else 0))
        self.row = "t" if self.frame else "row"
        self.wanted = Wanted((self.row, "node") if self.frame else (self.row,))
        chosen = lambda k, n: [int(x) for x in options[k].split(",")] if options.get(k) else list(range(n))
        if self.frame:
            self.nodes, self.features = chosen("nodes", self.frame[0]), chosen("features", self.frame[1])
            if not all(0 <= x < n for held, n in zip((self.nodes, self.features), self.frame, strict=True) for x in held):
                raise ValueError(f"nodes or features outside a frame of {self.frame}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Range]:
        """Ranges (file, first row, rows, row in the file, numbers in a row) of wanted rows."""
        if store.size(f"{self.path}/shape.json") is not None:
            held = store.get_json(f"{self.path}/shape.json")
            if self.frame and held["parts"] and held["shape"][1] != self.width:
                raise ValueError(f"rows of {held['shape'][1]} numbers are no frames of {self.frame}")
            self.width = held["shape"][1]
            parts = [(f"{self.path}/{p['file']}", p["first"], p["rows"]) for p in held["parts"]]
        else:
            bytes_, row = store.size(self.path), 4 * self.width
            if bytes_ is None or row <= 0 or bytes_ % row:
                raise ValueError(f"{self.path} is no file of rows of {self.width} numbers")
            parts = [(self.path, 0, bytes_ // row)]
        step, out = max(1, self.each // max(1, 4 * self.width)), []
        low, high = self.wanted.low.get(self.row, 0), self.wanted.high.get(self.row, 1 << 62)
        for file, first, rows in parts:
            a, b = max(first, low), min(first + rows, high + 1)
            out += [Range([(file, at, min(step, b - at), at - first, self.width)]) for at in range(a, b, step) if len(self.wanted.numbers(self.row, at, min(at + step, b)))]
        return out or [Range([])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for file, first, rows, place, self.width in partition.pieces:
            with store.opened(file) as f:
                read = self._frames if self.frame else self._rows
                yield from read(f, self.wanted.numbers(self.row, first, first + rows), place - first)

    def _at(self, f, start: int, count: int) -> np.ndarray:
        f.seek(4 * start)
        return np.frombuffer(f.read(4 * count), "<f4")

    def _rows(self, f, rows: np.ndarray, shift: int) -> Iterator[pa.RecordBatch]:
        for first, count in _runs(rows, max(1, _CHUNK // (4 * self.width))):
            x = self._at(f, (first + shift) * self.width, count * self.width).reshape(count, self.width)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + count)), _lists(x, pa.float32())], names=["row", "values"])

    def _frames(self, f, rows: np.ndarray, shift: int) -> Iterator[pa.RecordBatch]:
        """Of each frame the wanted nodes: small frames are read whole, of large ones only runs of wanted nodes."""
        nodes, (n_all, f_all) = [x for x in self.nodes if len(self.wanted.numbers("node", x, x + 1))], self.frame
        if not nodes:
            return
        runs = [(0, n_all)] if 4 * self.width <= 1 << 16 else list(_runs(np.unique(nodes), n_all))
        for first, count in _runs(rows, max(1, _CHUNK // (4 * self.width))):
            out = np.empty((count, len(nodes), len(self.features)), np.float32)
            for low, size in runs:
                here = [i for i, x in enumerate(nodes) if low <= x < low + size]
                if size == n_all:
                    x = self._at(f, (first + shift) * self.width, count * self.width).reshape(count, n_all, f_all)
                else:
                    x = np.stack([self._at(f, (first + shift + i) * self.width + low * f_all, size * f_all) for i in range(count)]).reshape(count, size, f_all)
                out[:, here] = x[:, [nodes[i] - low for i in here]][:, :, self.features]
            t = np.repeat(np.arange(first, first + count), len(nodes))
            columns = [pa.array(t), pa.array(np.tile(np.array(nodes, np.int32), count)), _lists(out.reshape(-1, len(self.features)), pa.float32())]
            yield pa.RecordBatch.from_arrays(columns, names=["t", "node", "values"])


def write_dat(df: DataFrame, path: str, order: list[str], overwrite: bool = True) -> None:
    """Rows (values: equally many numbers, and other columns) in the given order as raw float32 below path, with the measured shape.

    Numbers are in path/data, where each row came from is in path/meta; see DatWriter and read_dat_meta. NULL is NaN."""
    register(df.sparkSession)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.format("dat").option("path", path).mode("overwrite" if overwrite else "append").save()


def scan_dat(spark: SparkSession, path: str, width: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(row, values) of raw float32 rows: of a folder that write_dat made, or of a file of rows of `width` numbers.

    Filters on row decide which bytes are read; NaN becomes NULL."""
    register(spark)
    source = spark.read.format("dat").option("path", path).option("rangeBytes", range_bytes)
    return (source.option("width", width) if width else source).load()


def scan_panel(spark: SparkSession, path: str, nodes: int, features: int, pick: list[int] | None = None, of: list[int] | None = None,
               range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(t, node, values) of a panel [T, nodes, features] of raw float32: the nodes of pick, and of each the features of `of`, in that order.

    Frames are dealt out in ranges of t; filters on t and node decide which bytes of them are read."""
    register(spark)
    source = spark.read.format("dat").option("path", path).option("frame", f"{nodes},{features}").option("rangeBytes", range_bytes)
    for name, held in (("nodes", pick), ("features", of)):
        if held is not None:
            source = source.option(name, ",".join(map(str, held)))
    return source.load()


def read_dat_meta(spark: SparkSession, path: str) -> DataFrame:
    """(row, …): the columns that write_dat kept beside the numbers, with the row that they belong to."""
    parts = store.get_json(f"{path}/shape.json")["parts"]
    first = spark.createDataFrame([(p["part"], p["first"]) for p in parts], "part_ int, first_ long")  # a row for each part
    rows = spark.read.parquet(f"{path}/meta").join(F.broadcast(first), "part_")
    return rows.withColumn("row", F.col("first_") + F.col("place_")).drop("part_", "place_", "first_")


def join_dat(spark: SparkSession, path: str, target: str) -> tuple[int, int]:
    """One raw file at target from a folder that write_dat made, on a shared folder that can be written at any place; its shape.

    Each part is written at its offset by a task of its own, and again without harm; the file gets its name when all are there."""
    held = store.get_json(f"{path}/shape.json")
    rows, width = held["shape"]
    new = f"{target}.{uuid.uuid4().hex}"
    local = lambda uri: store.located(uri)[1]
    with open(local(new), "wb") as f:
        f.truncate(4 * rows * width)
    parts = spark.createDataFrame([(f"{path}/{p['file']}", 4 * width * p["first"], p["crc32"]) for p in held["parts"]], "file string, at long, crc long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, at, want in zip(*[c.to_pylist() for c in b.columns], strict=True):
                crc = 0
                with store.opened(file) as source, open(local(new), "r+b") as out:
                    out.seek(at)
                    while data := source.read(_CHUNK):
                        crc = crc32(data, crc)
                        out.write(data)
                if crc != want:
                    raise ValueError(f"{file} isn't what was written")
            yield b

    if held["parts"]:
        parts.repartition(len(held["parts"])).mapInArrow(run, "file string, at long, crc long").write.format("noop").mode("overwrite").save()
    store.move(new, target)
    return rows, width
