"""Matrices of vectors in `.npy` files, read by byte ranges.

A stored matrix is a folder: for each part the rows' vectors in one file (row after row, as other programs map into memory),
each scalar column in a file of its own, and `parts.json`, which names the parts that were committed with their rows and each
scalar's least and greatest value. A read opens only the columns asked for, no part whose bounds rule it out, and of the
vectors only the byte ranges of rows that pass the mask. Parts are cut into ranges of rows, a task each.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, StructType

MANIFEST = "parts.json"
#: Rows of a task, and unwanted bytes between wanted rows that are read through rather than skipped.
ROWS, GAP = 65_536, 32_768
_HEADER = 128
_SCALARS = {"bigint": "<i8", "int": "<i4", "double": "<f8", "float": "<f4", "boolean": "|b1"}
_VECTORS = {"array<float>": "<f4", "array<double>": "<f8"}


def _dtype(kind: str) -> str:
    found = _SCALARS.get(kind) or _VECTORS.get(kind)
    if found is None:
        raise ValueError(f"a matrix holds numbers and vectors of float or double, not {kind}")
    return found


def _header(shape: tuple[int, ...], dtype: str) -> bytes:
    """A header of fixed size, so that it can be written again when the number of rows is known."""
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": dtype, "fortran_order": False, "shape": shape})
    text = out.getvalue()
    if len(text) > _HEADER:
        raise ValueError("the header is longer than its place")
    # the header ends with a line feed; padding goes before it
    return text[:8] + (_HEADER - 10).to_bytes(2, "little") + text[10:-1].ljust(_HEADER - 11) + b"\n"


@dataclass
class _Written(WriterCommitMessage):
    part: dict | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.types = path, {f.name: f.dataType.simpleString() for f in schema}
        for kind in self.types.values():
            _dtype(kind)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = fs.FileSystem.from_uri(self.path)
        name, rows, width, held, bounds = uuid.uuid4().hex, 0, {}, {c: [] for c in self.types}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows += batch.num_rows
            for column, kind in self.types.items():
                values = batch.column(batch.schema.get_field_index(column))
                if values.null_count:
                    raise ValueError(f"{column}: a matrix has no place for nulls")
                if kind in _VECTORS:
                    lengths = np.diff(values.offsets.to_numpy())
                    if width.setdefault(column, int(lengths[0])) != lengths.min() or lengths.min() != lengths.max():
                        raise ValueError(f"{column}: vectors of one matrix have one length")
                    values = values.flatten()
                    if values.null_count:
                        raise ValueError(f"{column}: a matrix has no place for nulls")
                got = values.to_numpy(zero_copy_only=False).astype(_dtype(kind))
                if kind not in _VECTORS:
                    least, most = bounds.get(column, (got[0], got[0]))
                    # a bound that is not a number rules nothing out
                    bounds[column] = (np.minimum(least, got.min()), np.maximum(most, got.max()))
                held[column].append(got.tobytes())
        if not rows:
            return _Written(None)
        for column, kind in self.types.items():
            shape = (rows, width[column]) if kind in _VECTORS else (rows,)
            with store.open_output_stream(f"{root}/{name}.{column}.npy") as out:
                out.write(_header(shape, _dtype(kind)))
                for block in held[column]:
                    out.write(block)
        return _Written({"name": name, "rows": rows, "widths": width, "bounds": {c: [x.item() for x in b] for c, b in bounds.items()}})

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        parts = [m.part for m in messages if m is not None and m.part]
        with store.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps({"types": self.types, "parts": parts}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files without a manifest are not a matrix; nothing reads them."""


def manifest(path: str) -> dict:
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def runs(wanted: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """First and end of stretches that hold all wanted places; stretches at most `gap` places apart are one."""
    if not len(wanted):
        return []
    cut = np.flatnonzero(np.diff(wanted) > gap + 1) + 1
    return [(int(x[0]), int(x[-1]) + 1) for x in np.split(wanted, cut)]


@dataclass
class _Range(InputPartition):
    part: dict
    first: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, ranges: dict[str, Sequence], rows: int) -> None:
        self.path, self.ranges, self.rows = path, ranges, rows
        self.schema, self.types = schema, manifest(path)["types"]
        for c in self.ranges:
            if self.types.get(c) not in _SCALARS:
                raise ValueError(f"{c} is no scalar column of this matrix")

    def partitions(self) -> list[InputPartition]:
        out = []
        for part in manifest(self.path)["parts"]:
            open_ = all((low is None or not part["bounds"][c][1] < low) and (high is None or not part["bounds"][c][0] >= high) for c, (low, high) in self.ranges.items())
            if open_:
                out += [_Range(part, at, min(at + self.rows, part["rows"])) for at in range(0, part["rows"], self.rows)]
        return out or [_Range({}, 0, 0)]

    def _read(self, store, root: str, part: dict, column: str, rows: list[tuple[int, int]]) -> np.ndarray:
        """The column's values in some stretches of rows; only their bytes are read."""
        width, dtype = part["widths"].get(column, 1), np.dtype(_dtype(self.types[column]))
        blocks = []
        with store.open_input_file(f"{root}/{part['name']}.{column}.npy") as f:
            for first, end in rows:
                f.seek(_HEADER + first * width * dtype.itemsize)
                blocks.append(f.read((end - first) * width * dtype.itemsize))
        values = np.frombuffer(b"".join(blocks), dtype)
        return values.reshape(-1, width) if column in part["widths"] else values

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        part, count = partition.part, partition.end - partition.first
        if not count:
            return
        store, root = fs.FileSystem.from_uri(self.path)
        keep = np.ones(count, bool)
        for column, (low, high) in self.ranges.items():
            values = self._read(store, root, part, column, [(partition.first, partition.end)])
            keep &= (values >= low if low is not None else True) & (values < high if high is not None else True)
        wanted = np.flatnonzero(keep)
        if not len(wanted):
            return
        arrays = []
        for field in self.schema:
            width = part["widths"].get(field.name, 1)
            itemsize = np.dtype(_dtype(self.types[field.name])).itemsize * width
            stretches = runs(wanted, GAP // max(1, itemsize))
            # where each wanted row lies in the stretches laid end to end
            starts = np.array([a for a, _ in stretches])
            before = np.cumsum([0, *(b - a for a, b in stretches)])[:-1]
            which = np.searchsorted(starts, wanted, "right") - 1
            got = self._read(store, root, part, field.name, [(partition.first + a, partition.first + b) for a, b in stretches])
            got = got[before[which] + wanted - starts[which]]
            if isinstance(field.dataType, ArrayType):
                offsets = pa.array(np.arange(len(got) + 1, dtype=np.int32) * width)
                arrays.append(pa.ListArray.from_arrays(offsets, pa.array(got.ravel())))
            else:
                arrays.append(pa.array(got))
        yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in self.schema])


class MatrixFiles(DataSource):
    """format("matrix_files"): options path, columns (JSON list), ranges (JSON: column to [least, less than]), rows."""

    @classmethod
    def name(cls) -> str:
        return "matrix_files"

    def schema(self) -> str:
        types = manifest(self.options["path"])["types"]
        columns = json.loads(self.options.get("columns", "null")) or list(types)
        return ", ".join(f"`{c}` {types[c]}" for c in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, json.loads(self.options.get("ranges", "{}")), int(self.options.get("rows", ROWS)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema)


def write_matrix(df: DataFrame, path: str) -> None:
    """Store numbers and vectors (float, double) as a matrix in a new folder; each partition is a part, held in one task.

    Nulls, other types and vectors of different lengths within a part are errors, not drops. Repeated rows are rows; an
    empty table is a matrix without parts. The manifest is written last, so a job that fails leaves none.
    """
    df.sparkSession.dataSource.register(MatrixFiles)
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root)
    df.write.format("matrix_files").option("path", path).mode("append").save()


def read_matrix(spark: SparkSession, path: str, columns: Sequence[str] | None = None, ranges: dict[str, tuple] | None = None, rows: int = ROWS) -> DataFrame:
    """The stored rows: some columns, and those rows whose scalar columns lie in the ranges (least, less than; None: open)."""
    spark.dataSource.register(MatrixFiles)
    reader = spark.read.format("matrix_files").option("path", path).option("rows", str(rows))
    return reader.option("columns", json.dumps(columns)).option("ranges", json.dumps(ranges or {})).load()
