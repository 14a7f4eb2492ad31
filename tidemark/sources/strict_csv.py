"""Strict CSV in parallel: files of any size in many tasks, with the codes and line numbers of a sequential reader.

Whether a line begins a record depends on all quotes before it.  So lines are
read twice.  The first pass says of each split, for both cases (it begins
outside or inside quotes), how it ends, how many lines it has and where its last
record begins; running through these few rows per file in order gives every
split its true state and first line number.  The second pass parses each split
from its state.  A record that crosses splits is handed on as lines and put
together in a small shuffle of such lines alone.

Lines end in LF or CRLF, and inside quotes they are kept as they are.  Bytes must
be UTF-8; one byte order mark at the start of a file goes.  A quote that is never
closed takes in the rest of the file, but for its last line end.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SnapshotError
from ..plans.spec import SnapshotSpec
from ..staging import Staging, lasting

MARK = b"\xef\xbb\xbf"
#: Bytes of whole records that are parsed at a time.
CHUNK = 1 << 22

_CLOSED = rb'"[^"]*+(?:""[^"]*+)*+"(?:[^,\r"][^,\r]*+)?+'
_PLAIN = rb'(?:[^",\r][^,\r]*+)?+'
_OPEN = re.compile(rb'(?:(?:%b|%b)[,\r])*+"[^"]*+(?:""[^"]*+)*+\Z' % (_CLOSED, _PLAIN))
_INSIDE = re.compile(rb'[^"]*+(?:""[^"]*+)*+')
_AFTER = re.compile(rb'"(?:[^,\r"][^,\r]*+)?+')


def open_after(line: bytes, inside: bool) -> bool:
    """Whether a line without its LF ends inside quotes, given how it begins."""
    if b'"' not in line:
        return inside
    at = 0
    if inside:
        at = _INSIDE.match(line).end()
        if at == len(line):
            return True
        at = _AFTER.match(line, at).end() + 1  # the quote that closes, what stands behind it, and a separator
        if at > len(line):
            return False
    return _OPEN.match(line, at) is not None


def _lines_in(line: bytes) -> int:
    """A line, and one more for each CR that no LF follows."""
    return 1 + line.count(b"\r") - line.endswith(b"\r")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    """(file, start of the split, lines): neighbouring lines of one split."""
    for batch in batches:
        file, block = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        value = batch.column("value").to_pylist()
        at = 0
        for k in range(1, len(file) + 1):
            if k == len(file) or (file[k], block[k]) != (file[at], block[at]):
                yield file[at], block[at], value[at:k]
                at = k


@dataclass
class Split:
    """What the first pass says; pairs are for a start outside and inside quotes."""

    lines: int
    ends: tuple[bool, bool]
    last: tuple[int | None, int | None]
    text: int | None
    inside: bool = False
    first_line: int = 1
    record_line: int | None = None
    header: bool = False


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, out, state = None, [], None

    def row():
        lines, ends, last, text = state
        return (*key, lines, *ends, *last, text)

    for file, block, values in _runs(batches):
        if key != (file, block):
            if key:
                out.append(row())
            key, state = (file, block), [0, [False, True], [None, None], None]
        for line in values:
            line = line.removeprefix(MARK) if block == 0 and state[0] == 0 else line
            if state[3] is None and line.strip(b"\r"):
                state[3] = state[0]
            for k in (0, 1):
                if not state[1][k]:
                    state[2][k] = state[0]
                state[1][k] = open_after(line, state[1][k])
            state[0] += _lines_in(line)
    if key:
        out.append(row())
    if out:
        names = ["file", "block", "lines", "end0", "end1", "last0", "last1", "text"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _survey(lines: DataFrame) -> dict[tuple[str, int], Split]:
    """One row a split comes to the driver: the work of some megabytes for a petabyte."""
    rows = lines.mapInArrow(_surveyed, "file string, block long, lines long, end0 boolean, end1 boolean, last0 long, last1 long, text long").collect()
    out: dict[tuple[str, int], Split] = {}
    file, before = None, None
    for r in sorted(rows, key=lambda r: (r.file, r.block)):
        s = Split(r.lines, (r.end0, r.end1), (r.last0, r.last1), r.text)
        if r.file == file:
            s.inside, s.first_line = before.ends[before.inside], before.first_line + before.lines
            last = before.last[before.inside]
            s.record_line = before.record_line if last is None else before.first_line + last
            s.header = not seen and s.text is not None
            seen = seen or s.header
        else:
            file, s.header = r.file, s.text is not None
            seen = s.header
        out[r.file, r.block], before = s, s
    return out


def _checked(row: list[str], columns: tuple[str, ...]) -> tuple[str | None, str | None]:
    if len(row) != len(columns):
        return "ROW_WIDTH", f"{len(row)} fields, {len(columns)} expected"
    return ("SOURCE_CONTROL_CHAR", None) if any("\x1f" in v for v in row) else (None, None)


def _rows(raw: bytes, line: int, header: bool, columns: tuple[str, ...]) -> Iterator[tuple[int, str | None, str | None, list[str] | None]]:
    """(line, code, detail, values) of whole records; ``line`` is that of their first byte."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError as e:
        yield line + raw.count(b"\n", 0, e.start), "CSV_DECODE", f"byte {raw[e.start]:#04x}", None
        return
    csv.field_size_limit(1 << 31)
    reader = csv.reader(io.StringIO(text, newline=""))
    for row in reader:
        if not row:
            continue
        at = line - 1 + reader.line_num
        if header:
            header = False
            if tuple(row) != columns:
                yield at, "SCHEMA_MISMATCH", ",".join(row)[:500], None
                return
            continue
        code, detail = _checked(row, columns)
        yield at, code, detail, row if code is None else None


PARSED = "file string, line long, code string, detail string, values array<string>, key long, at long, raw binary, header boolean"
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
_NAMES = [c.split()[0] for c in PARSED.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def _parsed(splits, columns: tuple[str, ...]):
    """Lines of splits -> rows of whole records, and the lines of records that cross splits (key: the record's first line)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, key, out, size = splits.value, None, [], 0
        held: list[bytes] = []  # lines of the record that is open
        whole: list[bytes] = []  # lines of whole records before it
        inside = crossing = header = False
        start = at = first = 1

        def parse():
            nonlocal whole, header, first
            if whole:
                for line, code, detail, values in _rows(b"\n".join(whole), first, header, columns):
                    out.append((key[0], line, code, detail, values, None, None, None, None))
                header = header and not any(x.strip(b"\r") for x in whole)
                whole = []

        def left():
            """What the split leaves: whole records, and lines of one that goes on."""
            nonlocal held, header
            parse()
            n = start
            for x in held:
                out.append((key[0], None, None, None, None, start, n, x, header))
                n += _lines_in(x)
            held = []

        for file, block, values in _runs(batches):
            if key != (file, block):
                if key:
                    left()
                key, s = (file, block), known[file, block]
                inside, crossing, at, header = s.inside, s.inside, s.first_line, s.header
                start, first = at, at
                record = s.record_line
            for line in values:
                if block == 0 and at == 1:
                    line = line.removeprefix(MARK)
                size += len(line)
                inside = open_after(line, inside)
                if crossing:  # the rest of a record that began in an earlier split
                    out.append((file, None, None, None, None, record, at, line, None))
                    crossing = inside
                else:
                    if not held:
                        start = at
                    held.append(line)
                    if not inside:
                        if not whole:
                            first = start
                        whole += held
                        held = []
                at += _lines_in(line)
                if size > CHUNK:
                    parse()
                    if out:
                        yield _batch(out)
                    out, size = [], 0
        if key:
            left()
        if out:
            yield _batch(out)

    return f


def _joined(columns: tuple[str, ...]):
    """Lines of records that cross splits, sorted -> their rows."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, raw, header = None, [], False

        def rows():
            found = _rows(b"\n".join(raw), key[1], header, columns)
            return [(key[0], line, code, detail, values, None, None, None, None) for line, code, detail, values in found]

        for batch in batches:
            out = []
            for r in batch.select(["file", "key", "raw", "header"]).to_pylist():
                if key != (r["file"], r["key"]):
                    if key:
                        out += rows()
                    key, raw, header = (r["file"], r["key"]), [], False
                raw.append(r["raw"])
                header = header or bool(r["header"])
            if out:
                yield _batch(out)
        if key and (out := rows()):
            yield _batch(out)

    return f


def parse_files(spark: SparkSession, path: str | list[str], columns: tuple[str, ...], run: Staging | None = None) -> DataFrame:
    """file, line, code, detail, values: every row of the files, or what is wrong with it; nothing raises.

    line is the last line of the row, as sequential readers count.  A file without any text has a SCHEMA_MISMATCH.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    splits = _survey(lines)
    found = (run or lasting(spark)).table(lines.mapInArrow(_parsed(spark.sparkContext.broadcast(splits), tuple(columns)), PARSED), "csv")
    pieces = found.where("key is not null").repartition("file", "key").sortWithinPartitions("file", "key", "at")
    keep = ("file", "line", "code", "detail", "values")
    out = found.where("key is null").select(*keep).unionByName(pieces.mapInArrow(_joined(tuple(columns)), PARSED).select(*keep))
    # Scans leave out files without bytes, so no frame has their names; the listing does, written as in file_path but for local files.
    have = {file.replace("file:///", "file:/", 1) for (file, _), s in splits.items() if s.text is not None}
    listed = [f.replace("file:///", "file:/", 1) for f in lines.inputFiles()]
    empty = [f for f in listed if f not in have]
    if empty:
        out = out.unionByName(spark.createDataFrame([(f, 1, "SCHEMA_MISMATCH", "no header", None) for f in empty], "file string, line long, code string, detail string, values array<string>"))
    return out


#: Which defect a sequential reader meets first: bytes of the whole file, its header, then rows by line.
_FIRST = {"CSV_DECODE": 0, "SCHEMA_MISMATCH": 1}


def read_csv_strict(spark: SparkSession, path: str | list[str], spec: SnapshotSpec, run: Staging | None = None) -> DataFrame:
    """Raw rows of CSV files; the first defect raises with its code, file and line, and no rows at all are ZERO_ROWS."""
    own = run or lasting(spark)
    rows = own.table(parse_files(spark, path, spec.columns, own), "rows")
    rank = F.coalesce(*(F.when(F.col("code") == c, F.lit(k)) for c, k in _FIRST.items()), F.lit(len(_FIRST)))
    bad = rows.where("code is not null").orderBy(rank, "file", "line").limit(1).collect()
    if bad:
        r = bad[0]
        raise SnapshotError(r.code, r.detail or "", file=r.file, line=r.line)
    if rows.isEmpty():
        raise SnapshotError("ZERO_ROWS")
    return rows.select(*(F.col("values")[k].alias(c) for k, c in enumerate(spec.columns)))
