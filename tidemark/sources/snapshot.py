"""Reading a snapshot: response checks, archive, decoding, schema, rows.  The first failing layer raises."""

from __future__ import annotations

import csv
import io
import zipfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..errors import SnapshotError
from ..plans.spec import SnapshotSpec
from ..staging import Staging, lasting


@dataclass(frozen=True)
class Response:
    status: int
    content_type: str
    length: int | None
    body: bytes


def _opener(read: float):
    """An opener whose connections wait ``read`` seconds for data once they stand; what open() is given bounds connecting."""
    import http.client
    import urllib.request

    def timed(kind):
        class Timed(kind):
            def connect(self):
                super().connect()
                self.sock.settimeout(read)

        return Timed

    class Http(urllib.request.HTTPHandler):
        def http_open(self, req):
            return self.do_open(timed(http.client.HTTPConnection), req)

    class Https(urllib.request.HTTPSHandler):
        def https_open(self, req):
            return self.do_open(timed(http.client.HTTPSConnection), req, context=self._context)

    return urllib.request.build_opener(Http, Https)


def fetch(url: str, connect: float = 10, read: float = 120) -> Response:
    """One GET by the driver, with a bound for connecting and one for waiting; the landed bytes go through read_snapshot."""
    import http.client
    import urllib.error

    try:
        with _opener(read).open(url, timeout=connect) as r:
            size = r.headers.get("Content-Length")
            return Response(r.status, r.headers.get("Content-Type", ""), int(size) if size else None, r.read())
    except urllib.error.HTTPError as e:
        return Response(e.code, e.headers.get("Content-Type", ""), None, b"")
    except TimeoutError as e:
        raise SnapshotError("HTTP_TIMEOUT", str(e)) from e
    except (OSError, http.client.HTTPException) as e:
        timed_out = isinstance(getattr(e, "reason", None), TimeoutError)
        raise SnapshotError("HTTP_TIMEOUT" if timed_out else "HTTP_TRUNCATED", str(e)) from e


def validate_response(r: Response) -> None:
    if r.status != 200:
        raise SnapshotError("HTTP_STATUS", status=r.status)
    kind = r.content_type.split(";")[0].strip().lower()
    if kind != "application/zip":
        raise SnapshotError("UPSTREAM_ERROR_PAGE", content_type=r.content_type)
    if r.length is not None and r.length != len(r.body):
        raise SnapshotError("HTTP_TRUNCATED", expected=r.length, got=len(r.body))


def extract_csv(body: bytes) -> bytes:
    """All members are checked; the first CSV by name is taken."""
    try:
        with zipfile.ZipFile(io.BytesIO(body)) as z:
            if (bad := z.testzip()) is not None:
                raise SnapshotError("ZIP_CORRUPT", member=bad)
            names = sorted(n for n in z.namelist() if n.lower().endswith(".csv"))
            if not names:
                raise SnapshotError("ZIP_NO_CSV", members=z.namelist())
            return z.read(names[0])
    except (zipfile.BadZipFile, EOFError, OSError, RuntimeError, NotImplementedError) as e:
        raise SnapshotError("ZIP_CORRUPT", str(e)) from e
    except Exception as e:
        if type(e).__module__ == "zlib":
            raise SnapshotError("ZIP_CORRUPT", str(e)) from e
        raise


def decode(raw: bytes) -> str:
    """Strict UTF-8; one leading byte order mark goes."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise SnapshotError("CSV_DECODE", str(e)) from e
    return text[1:] if text.startswith("﻿") else text


def parse_csv(text: str, spec: SnapshotSpec) -> list[tuple[str, ...]]:
    """Rows in file order; line ends inside quotes are kept as they are."""
    reader = csv.reader(io.StringIO(text, newline=""))
    header = next((r for r in reader if r), [])
    if tuple(header) != spec.columns:
        missing, extra = [c for c in spec.columns if c not in header], [c for c in header if c not in spec.columns]
        raise SnapshotError("SCHEMA_MISMATCH", missing=missing, extra=extra, order=not missing and not extra)
    rows = []
    for row in reader:
        if not row:
            continue
        if len(row) != len(header):
            raise SnapshotError("ROW_WIDTH", line=reader.line_num, got=len(row), expected=len(header))
        if any("\x1f" in v for v in row):
            raise SnapshotError("SOURCE_CONTROL_CHAR", line=reader.line_num)
        rows.append(tuple(row))
    return rows


#: Bytes that go to a shared file at a time.
PIECE = 1 << 23


def read_snapshot(spark: SparkSession, body: bytes, spec: SnapshotSpec, zipped: bool = True, partitions: int | None = None, run: Staging | None = None) -> DataFrame:
    """One landed snapshot -> raw rows.  The driver inflates it into a shared file; decoding and parsing are tasks' work."""
    from .strict_csv import read_csv_strict

    raw = extract_csv(body) if zipped else body
    own = run or lasting(spark)
    where = spark._jvm.org.apache.hadoop.fs.Path(own.path("snapshot") + ".csv")
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, False)
    try:
        for at in range(0, len(raw), PIECE):
            stream.write(bytearray(raw[at : at + PIECE]))
    finally:
        stream.close()
    df = read_csv_strict(spark, where.toString(), spec, own)
    return df.repartition(partitions) if partitions else df


def read_csv_files(spark: SparkSession, path: str, spec: SnapshotSpec) -> DataFrame:
    """CSV files of any size, read in parallel and as strictly as read_snapshot reads one."""
    from .strict_csv import read_csv_strict

    return read_csv_strict(spark, path, spec)


def read_zip_files(spark: SparkSession, path: str, spec: SnapshotSpec) -> DataFrame:
    """Many zipped snapshots, one task each: their rows with the path they came from."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField("path", StringType()), *spec.schema.fields])

    def unpack(frames):
        import pandas as pd

        for frame in frames:
            for where, content in zip(frame["path"], frame["content"], strict=True):
                rows = parse_csv(decode(extract_csv(content)), spec)
                for a in range(0, len(rows), 10_000):
                    out = pd.DataFrame(rows[a : a + 10_000], columns=list(spec.columns))
                    out.insert(0, "path", where)
                    yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, schema)


def source_digest(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.sql import functions as F

    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
