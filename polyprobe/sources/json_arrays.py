"""JSON arrays as an ordered, splittable source, and JSON documents as a sink.

A large array file is cut into byte ranges that know nothing of each other.  A
first pass counts, per range and for both cases (it starts inside a string or
outside), quotes, change of depth, and commas by depth.  Running sums over the
ranges of a file then say how each range starts and how many items lie before
it, so the second pass reads all ranges at once and numbers its items as the
file does.  Files of one range need no first pass.  Files whose name does not
meet the pushed filters are not planned at all.

Documents are written the other way round: tasks write sorted fragments under
names of their own, a manifest lists the fragments of the attempts that count,
and one task per document streams its fragments together and renames the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringStartsWith,
)

from polyprobe.operators.layout import materialize
from polyprobe.session import scratch_path
from polyprobe.storage import open_store

FORMAT = "json_array"
RANGE_BYTES = 64 << 20
#: Bytes held at a time by a task, and items handed over at a time.
_PIECE, _BATCH_BYTES = 4 << 20, 4 << 20
#: Items a writing task turns into Python strings at a time.
_ROWS = 512
# <task>_<lang><rows>_test.json
_FILE_NAME = re.compile(r"([A-Za-z]+)_([a-z]{2})(\d*)_test\.json$")

ITEMS = "task string, lang string, file string, item_no bigint, value string"
_COMMAS = "array<struct<depth:int,n:bigint>>"
RANGES = (f"file string, range_no bigint, start bigint, stop bigint, quotes bigint, turn_out bigint, turn_in bigint, "
          f"commas_out {_COMMAS}, commas_in {_COMMAS}")

_TURN = np.zeros(256, np.int64)
_TURN[list(b"[{")], _TURN[list(b"]}")] = 1, -1
_MARK = np.zeros(256, bool)
_MARK[list(b"[]{},")] = True
_BLANK = b" \t\r\n"


@dataclass
class ArrayFile:
    path: str
    size: int
    task: str | None
    lang: str | None


def array_files(path: str) -> list[ArrayFile]:
    """JSON files below a folder, or the file itself, in name order; hidden ones left out."""
    store, root = open_store(path)
    info = store.get_file_info(root)
    if info.type == pafs.FileType.File:
        found = [info]
    else:
        found = [f for f in store.get_file_info(pafs.FileSelector(root, recursive=True))
                 if f.type == pafs.FileType.File and f.path.endswith(".json")
                 and not any(part[:1] in "._" for part in f.path[len(root):].strip("/").split("/"))]
    out = []
    for f in sorted(found, key=lambda f: f.path):
        named = _FILE_NAME.match(f.base_name)
        out.append(ArrayFile(f.path, f.size, named and named[1], named and named[2]))
    return out


@dataclass
class ByteRange(InputPartition):
    """A range of one file and how it starts: inside a string or not, at what depth, after how many separators."""

    file: ArrayFile
    start: int
    stop: int
    in_string: bool = False
    depth: int = 0
    before: int = 0


# ---- looking at bytes -------------------------------------------------------

def _escaped_at(handle, start: int) -> bool:
    """Whether an odd number of backslashes stands right before ``start``."""
    count, at = 0, start
    while at:
        step = min(at, 4096)
        handle.seek(at - step)
        piece = handle.read(step)
        run = len(piece) - len(piece.rstrip(b"\\"))
        count, at = count + run, at - step
        if run < step:
            break
    return count % 2 == 1


def _quotes(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Places of the quotes that are not escaped, and whether the byte after the data is."""
    quote = data == 34
    slash = np.flatnonzero(data == 92)
    if not len(slash) and not escaped:
        return np.flatnonzero(quote), False
    if escaped:
        quote[0] = False
        # An escaped backslash escapes nothing.
        slash = slash[1:] if len(slash) and slash[0] == 0 else slash
    first = np.flatnonzero(np.r_[True, np.diff(slash) > 1][:len(slash)])
    length = np.diff(np.r_[first, len(slash)])
    after = (slash[first] + length)[length % 2 == 1]
    carry = bool(len(after)) and int(after[-1]) == len(data)
    quote[after[:-1] if carry else after] = False
    return np.flatnonzero(quote), carry


def _pieces(handle, start: int, stop: int) -> Iterator[tuple[int, np.ndarray]]:
    handle.seek(start)
    while start < stop:
        data = handle.read(min(_PIECE, stop - start))
        if not data:
            return
        yield start, np.frombuffer(data, np.uint8)
        start += len(data)


def summary(part: ByteRange) -> dict:
    """What the range adds to the file's state, for a start outside and inside a string."""
    store, path = open_store(part.file.path)
    quotes, turn, commas = 0, [0, 0], [{}, {}]
    with store.open_input_file(path) as handle:
        escaped = part.start > 0 and _escaped_at(handle, part.start)
        for _, data in _pieces(handle, part.start, part.stop):
            marks_at = np.flatnonzero(_MARK[data])
            quote_at, escaped = _quotes(data, escaped)
            flipped = (np.searchsorted(quote_at, marks_at) + quotes) % 2
            marks = data[marks_at]
            for inside in (0, 1):
                own = marks[flipped == inside]
                depth = turn[inside] + np.cumsum(_TURN[own])
                for d, n in zip(*(x.tolist() for x in np.unique(depth[own == 44], return_counts=True))):
                    commas[inside][d] = commas[inside].get(d, 0) + n
                turn[inside] = int(depth[-1]) if len(own) else turn[inside]
            quotes += len(quote_at)
    listed = [[{"depth": d, "n": n} for d, n in sorted(c.items())] for c in commas]
    return {"file": part.file.path, "start": part.start, "stop": part.stop, "quotes": quotes, "turn_out": turn[0],
            "turn_in": turn[1], "commas_out": listed[0], "commas_in": listed[1]}


def items(part: ByteRange) -> Iterator[tuple[int, bytes]]:
    """Number and text of the items whose bracket or comma lies in the range; the last may end beyond it."""
    store, path = open_store(part.file.path)
    parity, depth, number = int(part.in_string), part.depth, part.before
    open_item, held = False, []
    with store.open_input_file(path) as handle:
        escaped = part.start > 0 and _escaped_at(handle, part.start)
        for base, data in _pieces(handle, part.start, part.file.size):
            quote_at, escaped = _quotes(data, escaped)
            marks_at = np.flatnonzero(_MARK[data])
            outside = (np.searchsorted(quote_at, marks_at) + parity) % 2 == 0
            marks_at = marks_at[outside]
            marks, parity = data[marks_at], (parity + len(quote_at)) % 2
            after = depth + np.cumsum(_TURN[marks])
            depth = int(after[-1]) if len(marks) else depth
            # An array opens, an item ends at a comma, the array closes.
            border = ((marks == 91) & (after == 1)) | ((marks == 44) & (after == 1)) | ((marks == 93) & (after == 0))
            raw, upto = data.tobytes(), 0
            for at, mark in zip(marks_at[border].tolist(), marks[border].tolist()):
                if open_item:
                    held.append(raw[upto:at])
                    text = b"".join(held).strip(_BLANK)
                    if text:
                        yield number, text
                    held = []
                if mark == 44:
                    number += 1
                open_item, upto = mark != 93, at + 1
                if base + at >= part.stop or not open_item:
                    return
            if open_item:
                held.append(raw[upto:])
            elif base + len(data) >= part.stop:
                return


# ---- the source -------------------------------------------------------------

class JsonArraySource(DataSource):
    """Options: ``path``; ``rangeBytes``; ``index``, a table of range starts for files of several ranges;
    ``mode`` "items" (default) or "ranges", the first pass."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RANGES if self.options.get("mode") == "ranges" else ITEMS

    def reader(self, schema) -> DataSourceReader:
        return (RangeReader if self.options.get("mode") == "ranges" else ItemReader)(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.index = options.get("index")
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take the filters that a file's name decides; hand the others back."""
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            named = name in ("task", "lang", "file")
            if named and isinstance(f, (EqualTo, EqualNullSafe)):
                self.tests.append((name, "in", (f.value,)))
            elif named and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif named and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", (f.value,)))
            else:
                yield f

    def files(self) -> list[ArrayFile]:
        def keeps(f: ArrayFile) -> bool:
            for name, kind, values in self.tests:
                own = f.path if name == "file" else getattr(f, name)
                if kind == "in" and own not in values or kind == "starts" and not (own or "").startswith(values):
                    return False
            return True

        return [f for f in array_files(self.path) if keeps(f)]

    def cut(self, f: ArrayFile) -> list[tuple[int, int]]:
        return [(at, min(at + self.range_bytes, f.size)) for at in range(0, f.size, self.range_bytes)]


class RangeReader(_Reader):
    def partitions(self) -> list[ByteRange]:
        return [ByteRange(f, *r) for f in self.files() if f.size > self.range_bytes for r in self.cut(f)]

    def read(self, partition: ByteRange | None) -> Iterator[tuple]:
        if partition is None:
            return
        found = summary(partition)
        yield (found["file"], partition.start // self.range_bytes, found["start"], found["stop"], found["quotes"],
               found["turn_out"], found["turn_in"], found["commas_out"], found["commas_in"])


class ItemReader(_Reader):
    def partitions(self) -> list[ByteRange]:
        """One range per task; a row of the index each for the files that have several."""
        files = self.files()
        starts = {}
        if self.index and any(f.size > self.range_bytes for f in files):
            import pyarrow.dataset as ds
            store, path = open_store(self.index)
            names = [f.path for f in files]
            for r in ds.dataset(path, filesystem=store).to_table(filter=ds.field("file").isin(names)).to_pylist():
                starts[r["file"], r["start"]] = (r["in_string"], r["depth"], r["before"])
        out = []
        for f in files:
            for start, stop in self.cut(f):
                if start and (f.path, start) not in starts:
                    raise ValueError(f"{f.path} has several ranges; index it first (read_json_arrays does)")
                out.append(ByteRange(f, start, stop, *starts.get((f.path, start), (False, 0, 0))))
        return out

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        numbers, values, size = [], [], 0

        def batch() -> pa.RecordBatch:
            n = len(numbers)
            return pa.RecordBatch.from_arrays([
                pa.array([partition.file.task] * n, pa.string()), pa.array([partition.file.lang] * n, pa.string()),
                pa.array([partition.file.path] * n, pa.string()), pa.array(numbers, pa.int64()),
                pa.array(values, pa.binary()).cast(pa.string())], names=["task", "lang", "file", "item_no", "value"])

        for number, value in items(partition):
            numbers.append(number)
            values.append(value)
            size += len(value)
            if size >= _BATCH_BYTES:
                yield batch()
                numbers, values, size = [], [], 0
        if numbers:
            yield batch()


def range_starts(ranges: DataFrame) -> DataFrame:
    """How every range starts, from the counts of the ranges before it in the file."""
    earlier = Window.partitionBy("file").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)

    def so_far(col: Column) -> Column:
        return F.coalesce(F.sum(col).over(earlier), F.lit(0))

    inside = F.col("in_string")
    commas = F.when(inside, F.col("commas_in")).otherwise(F.col("commas_out"))
    own = F.aggregate(commas, F.lit(0).cast("bigint"), lambda n, c: n + F.when(c["depth"] + F.col("depth") == 1, c["n"]).otherwise(0))
    return (
        ranges.withColumn("in_string", so_far(F.col("quotes")) % 2 == 1)
        .withColumn("depth", so_far(F.when(inside, F.col("turn_in")).otherwise(F.col("turn_out"))))
        .withColumn("before", so_far(own))
        .select("file", "start", "in_string", F.col("depth").cast("int").alias("depth"), "before")
    )


def _filtered(df: DataFrame, tasks: list[str] | None, langs: list[str] | None) -> DataFrame:
    for name, wanted in (("task", tasks), ("lang", langs)):
        if wanted is not None:
            df = df.where(F.col(name).isin(list(wanted)))
    return df


def read_json_arrays(
    spark: SparkSession, path: str, tasks: list[str] | None = None, langs: list[str] | None = None,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Items of all array files below ``path``: task, lang, file, item_no, value (the item's JSON text).

    Filters on task, lang and file (``EqualTo``, ``In``, prefix), also later
    ones, choose files before any is opened.  The first pass runs here, over
    the wanted files larger than a range only.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JsonArraySource)
    found = array_files(path)
    wanted = [f for f in found if (tasks is None or f.task in tasks) and (langs is None or f.lang in langs)]
    source = spark.read.format(FORMAT).option("path", path).option("rangeBytes", str(range_bytes))
    if any(f.size > range_bytes for f in wanted):
        index = scratch_path(spark, "json-ranges")
        ranges = spark.read.format(FORMAT).option("path", path).option("rangeBytes", str(range_bytes)) \
            .option("mode", "ranges").load()
        if len(wanted) < len(found):
            ranges = ranges.where(F.col("file").isin([f.path for f in wanted]))
        range_starts(ranges).write.parquet(index)
        source = source.option("index", index)
    return _filtered(source.load(), tasks, langs)


# ---- the sink ---------------------------------------------------------------

def write_json_documents(
    rows: DataFrame, path: str, document: str, order: list[str], fields: list[str] | None = None
) -> DataFrame:
    """One JSON array file per value of ``document`` (a file name), its items in ``order``.

    Returns (document, n_items, n_bytes).  Items hold ``fields``, or all columns
    but the name; nulls are written as such and characters unescaped.  A file appears whole or not at all: fragments carry the number of
    their attempt, only those of finished attempts are in the manifest, and a
    document takes its name when it is complete.
    """
    spark = rows.sparkSession
    body = F.to_json(F.struct(*(fields or [c for c in rows.columns if c != document])), {"ignoreNullFields": "false"})
    keys = [F.col(c).alias(f"_order{k}") for k, c in enumerate(order)]
    listed = rows.select(F.col(document).alias("document"), *keys, body.alias("value"))
    by = ["document", *[f"_order{k}" for k in range(len(order))]]
    ordered = listed.repartitionByRange(*by).sortWithinPartitions(*by).select("document", "value")
    fragments = f"{path.rstrip('/')}/_fragments"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(fragments)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        name, handle, n, size, made = None, None, 0, 0, []
        store.create_dir(root, recursive=True)
        for batch in (b.slice(k, _ROWS) for b in batches for k in range(0, b.num_rows, _ROWS)):
            runs = groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), key=itemgetter(0))
            for document, run in runs:
                if document != name or handle is None:
                    if handle is not None:
                        handle.close()
                        made.append((name, part, target, n, size))
                    name, n, size = document, 0, 0
                    target = f"{root}/{part}-{attempt}-{len(made)}"
                    handle = store.open_output_stream(target)
                values = [value for _, value in run]
                piece = ((",\n" if n else "") + ",\n".join(values)).encode()
                handle.write(piece)
                n, size = n + len(values), size + len(piece)
        if handle is not None:
            handle.close()
            made.append((name, part, target, n, size))
        columns = list(zip(*made)) if made else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
            names=["document", "part", "fragment", "n_items", "n_bytes"])

    manifest = materialize(
        ordered.mapInArrow(write, "document string, part bigint, fragment string, n_items bigint, n_bytes bigint"), "fragments")

    def join(listed: pa.Table) -> pa.Table:
        store, root = open_store(path)
        listed = listed.sort_by([("part", "ascending"), ("fragment", "ascending")])
        name = listed.column("document")[0].as_py()
        hidden = f"{root.rstrip('/')}/.{name}.{TaskContext.get().taskAttemptId()}"
        size = 0
        with store.open_output_stream(hidden) as out:
            for k, fragment in enumerate(listed.column("fragment").to_pylist()):
                out.write(b",\n" if k else b"[\n")
                with store.open_input_stream(fragment) as piece:
                    while data := piece.read(_PIECE):
                        out.write(data)
            out.write(b"\n]\n")
            size = out.tell()
        store.move(hidden, f"{root.rstrip('/')}/{name}")
        return pa.table({"document": pa.array([name]), "n_items": pa.array([sum(listed.column("n_items").to_pylist())]),
                         "n_bytes": pa.array([size])})

    done = materialize(manifest.groupBy("document").applyInArrow(join, "document string, n_items bigint, n_bytes bigint"), "documents")
    store, root = open_store(fragments)
    if store.get_file_info(root).type == pafs.FileType.Directory:
        store.delete_dir(root)
    return done
