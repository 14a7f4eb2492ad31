"""Search indexes that a session builds once for a source and keeps in the shared folder."""

from __future__ import annotations

import threading

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_normalize
from ..operators.trigrams import Index, build_index
from ..staging import lasting

_built: dict[tuple, Index] = {}
_lock = threading.Lock()


def _stamp(spark: SparkSession, path: str) -> tuple:
    """What tells a changed source: names, sizes and times of its files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(where)
    files = fs.listStatus(where) if status.isDirectory() else [status]
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def document_index(spark: SparkSession, d: str) -> Index:
    """Documents by id: text, source and lang, folded as searches fold."""
    path, fields = f"{d}/documents.parquet", ("text", "source", "lang")
    known = (spark.sparkContext.applicationId, path, _stamp(spark, path))
    with _lock:
        if known not in _built:
            folded = spark.read.parquet(path).select("doc_id", *(search_normalize(F.col(c)).alias(c) for c in fields))
            _built[known] = build_index(folded, "doc_id", fields, lasting(spark).path("index"))
        return _built[known]
