"""Substring search over stored folded texts with trigram postings.

At build time texts are folded once.  Each task then turns its records round: a
row of the postings is a trigram with the keys of the records of one piece that
hold it, so what is sorted and written are a few rows a record, not one for each
of its trigrams, and nothing is shuffled.  Files are sorted by trigram and cut
into small row groups, so that a look-up reads a few of them.  A query takes the
rarest trigram of each of its terms, intersects their records, and verifies the
terms on the folded texts of those alone.  Where no term is rare, or all are
shorter than a trigram, the folded texts are scanned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search

#: Characters of one piece, whose records share rows of the postings; about 50 bytes of a worker's memory each.
PIECE = 1 << 21
#: Row groups of the postings, in bytes: what a look-up reads of a file.
ROW_GROUP = 1 << 22
#: Share of the records up to which a trigram narrows a search.
SELECTIVE = 0.25
#: Records up to this count are named in the condition that the scan gets (16 bytes each); beyond it they are joined.
NAMED = 2_000


@dataclass(frozen=True)
class Index:
    """Where the tables of an index are: folded (the record's key and fields) and postings (gram, records, keys)."""

    root: str
    key: str
    fields: tuple[str, ...]
    records: int


def grams_of(text: str) -> set[str]:
    return {text[k : k + 3] for k in range(len(text) - 2)}


def _pieces(columns: list[list[str | None]]) -> Iterator[tuple[list[int], list[str]]]:
    """(record of each text, texts) of PIECE characters or a little more; longer texts are cut with an overlap that loses no trigram."""
    of, texts, held = [], [], 0
    for k, fields in enumerate(zip(*columns, strict=True)):
        for text in fields:
            for at in range(0, len(text or "") - 2, PIECE):
                of.append(k)
                texts.append(text[at : at + PIECE + 2])
                held += len(texts[-1])
                if held >= PIECE:
                    yield of, texts
                    of, texts, held = [], [], 0
    if texts:
        yield of, texts


def _first(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    return np.concatenate(([True], x[1:] != x[:-1]))


def _turned(of: list[int], texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Trigrams of some texts of three characters or more in order of code, where the records of each begin (and the last end), and the records."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    seen = np.zeros(0x110000, bool)
    seen[chars] = True
    letters = np.flatnonzero(seen)
    code = (np.cumsum(seen) - 1)[chars]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size)
    inside = np.ones(chars.size, bool)  # positions at which a trigram of one text begins
    inside[end - 1] = inside[end - 2] = False
    inside = inside[:-2]
    record, place = np.unique(np.array(of), return_inverse=True)
    gram = ((code[:-2] * letters.size + code[1:-1]) * letters.size + code[2:])[inside]
    holder = np.repeat(place, size)[:-2][inside]
    if letters.size**3 * record.size < 1 << 63:
        both = gram * record.size + holder
        both.sort()
        gram, holder = np.divmod(both[_first(both)], record.size)
    else:
        order = np.lexsort((holder, gram))
        gram, holder = gram[order], holder[order]
        new = _first(gram) | _first(holder)
        gram, holder = gram[new], holder[new]
    start = np.flatnonzero(_first(gram))
    own = gram[start]
    spelt = np.stack((own // letters.size**2, own // letters.size % letters.size, own % letters.size), axis=1)
    text = letters[spelt].astype("<u4").tobytes().decode("utf-32-le")
    return [text[k : k + 3] for k in range(0, len(text), 3)], np.append(start, gram.size), record[holder]


def _postings(key: str, fields: tuple[str, ...]):
    """Records -> for each piece its trigrams, how many of its records hold each (one cut apart counts again), and their keys."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, texts in _pieces([batch.column(c).to_pylist() for c in fields]):
                grams, start, records = _turned(of, texts)
                keys = pa.ListArray.from_arrays(pa.array(start, pa.int32()), batch.column(key).take(pa.array(records)))
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(np.diff(start)), keys], ["gram", "records", "keys"])

    return f


def build_index(folded: DataFrame, key: str, fields: tuple[str, ...], root: str) -> Index:
    """Write the index of records (key, fields already folded) under root."""
    spark = folded.sparkSession
    folded.select(key, *fields).write.mode("overwrite").parquet(f"{root}/folded")
    stored = spark.read.parquet(f"{root}/folded")
    kind = stored.schema[key].dataType.simpleString()
    postings = stored.mapInArrow(_postings(key, fields), f"gram string, records long, keys array<{kind}>").sortWithinPartitions("gram")
    postings.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(f"{root}/postings")
    return Index(root, key, fields, stored.count())


def rarest(spark: SparkSession, index: Index, terms: list[str]) -> list[str] | None:
    """One trigram of each term that narrows the search, rarest first; None if a term's trigram is in no record at all."""
    asked = sorted(set().union(*(grams_of(t) for t in terms)))
    if not asked:
        return []
    grams = spark.read.parquet(f"{index.root}/postings").where(F.col("gram").isin(asked)).groupBy("gram").agg(F.sum("records").alias("records"))
    count = {r.gram: r.records for r in grams.collect()}  # as many rows as the query has trigrams
    if any(g not in count for g in asked):
        return None
    own = {min(grams_of(t), key=lambda g: (count[g], g)) for t in terms if len(t) > 2}
    return sorted((g for g in own if count[g] <= SELECTIVE * index.records), key=lambda g: (count[g], g))


def candidates(spark: SparkSession, index: Index, grams: list[str]) -> DataFrame:
    """Keys of the records that hold every one of the trigrams."""
    found = spark.read.parquet(f"{index.root}/postings").where(F.col("gram").isin(grams)).select("gram", F.explode("keys").alias(index.key))
    return found.groupBy(index.key).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select(index.key)


def find(spark: SparkSession, index: Index, terms: list[str]) -> DataFrame:
    """Folded records that hold every term in any field."""
    stored = spark.read.parquet(f"{index.root}/folded")
    if not terms:
        return stored.where("false")
    grams = rarest(spark, index, terms)
    if grams is None:
        return stored.where("false")
    if grams:
        keys = candidates(spark, index, grams)
        few = [r[0] for r in keys.limit(NAMED + 1).collect()]
        own = F.col(index.key)
        named = own.isin([k for k in few if k is not None])
        if len(few) <= NAMED:
            stored = stored.where(named | own.isNull() if None in few else named)
        else:
            keys = keys.withColumnRenamed(index.key, "_held")
            stored = stored.join(keys, own.eqNullSafe(F.col("_held")), "left_semi")
    return stored.where(search.matches([F.col(c) for c in index.fields], terms))


def search_index(spark: SparkSession, index: Index, terms: list[str]) -> DataFrame:
    """entity, record, day, hit_fields, as search_records() gives them."""
    fields = {c: F.col(c) for c in index.fields}
    hit = find(spark, index, terms)
    return hit.select(F.col(index.key).alias("entity"), F.col(index.key).alias("record"), F.lit(None).cast("date").alias("day"), search.hit_fields(fields, terms).alias("hit_fields"))
