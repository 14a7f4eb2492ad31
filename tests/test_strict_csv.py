"""The parallel reader against a sequential one."""

import csv
import io
import random

import pytest

from tidemark.errors import SnapshotError
from tidemark.plans.spec import SnapshotSpec
from tidemark.sources import strict_csv
from tidemark.sources.snapshot import decode, parse_csv

SPEC = SnapshotSpec(columns=("a", "b", "c"), identity="a", updated="c")


@pytest.fixture
def small_splits(spark):
    """Splits of a few bytes, so that records cross them."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def to(n):
        for k in old:
            spark.conf.set(k, str(n))

    yield to
    for k, v in old.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def plain(raw):
    """(line, values) of a sequential reader, or the code and line of what it raises."""
    try:
        text = decode(raw)
        reader = csv.reader(io.StringIO(text, newline=""))
        parse_csv(text, SPEC)
        rows = [(reader.line_num, r) for r in reader if r]
        return rows[1:]
    except SnapshotError as e:
        return e.code.value, e.detail.get("line")


def found(spark, path):
    rows = strict_csv.parse_files(spark, path, SPEC.columns).collect()
    return sorted((r.line, r["values"]) for r in rows if r.code is None), [(r.code, r.line) for r in rows if r.code]


def test_state_of_lines_equals_a_character_machine():
    def machine(line, inside):
        state = "quoted" if inside else "start"
        for c in line:
            if state == "quoted":
                state = "quote" if c == '"' else "quoted"
            elif state == "quote" and c == '"':
                state = "quoted"
            elif c in ",\r":
                state = "start"
            elif state == "start":
                state = "quoted" if c == '"' else "field"
            else:
                state = "field"
        return state == "quoted"

    rng = random.Random(1)
    for _ in range(20_000):
        line = "".join(rng.choice('"",\rx') for _ in range(rng.randint(0, 12)))
        for inside in (False, True):
            assert strict_csv.open_after(line.encode(), inside) == machine(line, inside), (line, inside)


@pytest.mark.parametrize("split", [60, 1 << 20])
def test_rows_equal_a_sequential_reader(spark, small_splits, tmp_path, split):
    rng = random.Random(split)
    small_splits(split)
    files = {}
    for k in range(4):
        end = rng.choice(["\n", "\r\n"])
        out = io.StringIO()
        w = csv.writer(out, lineterminator=end)
        w.writerow(SPEC.columns)
        for _ in range(rng.randint(1, 12)):
            w.writerow("".join(rng.choice(['"', ",", "\n", "\r\n", "x", "é", "字", " "]) for _ in range(rng.randint(0, 9))) for _ in range(3))
            if rng.random() < 0.1:
                out.write(end)
        text = rng.choice(["", "﻿"]) + rng.choice(["", end]) + out.getvalue()
        text = text[: -len(end)] if rng.random() < 0.3 and text.endswith(end) else text
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
        files[k] = text.encode()
    rows = strict_csv.parse_files(spark, str(tmp_path), SPEC.columns).collect()
    for k, raw in files.items():
        own = [r for r in rows if r.file.endswith(f"/{k}.csv")]
        assert sorted((r.line, r["values"]) for r in own) == sorted(plain(raw)) and not any(r.code for r in own), k
    whole = strict_csv.read_csv_strict(spark, str(tmp_path), SPEC)
    assert whole.count() == sum(len(plain(raw)) for raw in files.values())


BAD = {
    "bad byte": b"a,b,c\r\n1,2,3\r\n4,\xff,6\r\n", "ragged": b'a,b,c\n1,"2\n2",3\n4,5\n6,7,8\n', "wide": b"a,b,c\n1,2,3,4\n", "control": b"a,b,c\n1,2\x1f,3\n",
    "order": b"b,a,c\n1,2,3\n", "missing": b"a,b\n1,2\n", "cut character": b"a,b,c\n1,2,\xe5\xad\n", "open quote": b'a,b,c\n1,2,"3\n4,5,6', "both": b"a,b,c\n1,2\n3,4,\xff\n", "no text": b"\n\r\n\n",
}


@pytest.mark.parametrize("name", sorted(BAD))
def test_defects_have_code_and_line(spark, small_splits, tmp_path, name):
    small_splits(8)
    (tmp_path / "x.csv").write_bytes(BAD[name])
    want = plain(BAD[name])
    if isinstance(want, list):
        assert found(spark, str(tmp_path / "x.csv")) == (want, [])
        return
    with pytest.raises(SnapshotError) as e:
        strict_csv.read_csv_strict(spark, str(tmp_path / "x.csv"), SPEC)
    code, line = want
    assert e.value.code.value == code and (line is None or e.value.detail["line"] == line)
    assert name != "bad byte" or e.value.detail["line"] == 3


def test_no_rows_and_no_bytes(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"a,b,c\n")
    with pytest.raises(SnapshotError) as e:
        strict_csv.read_csv_strict(spark, str(tmp_path), SPEC)
    assert e.value.code.value == "ZERO_ROWS"
    (tmp_path / "y.csv").write_bytes(b"")
    with pytest.raises(SnapshotError) as e:
        strict_csv.read_csv_strict(spark, str(tmp_path), SPEC)
    assert e.value.code.value == "SCHEMA_MISMATCH"


def test_file_without_bytes_among_odd_names(spark, tmp_path):
    for name in ("x y.csv", "50%.csv", "é.csv"):
        (tmp_path / name).write_bytes(b"a,b,c\n1,2,3\n")
    assert found(spark, str(tmp_path)) == ([(2, ["1", "2", "3"])] * 3, [])
    (tmp_path / "no bytes.csv").write_bytes(b"")
    (tmp_path / "line ends.csv").write_bytes(b"\n\r\n")
    rows = strict_csv.parse_files(spark, [str(tmp_path / f.name) for f in tmp_path.iterdir()], SPEC.columns).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.code) for r in rows if r.code) == [("line%20ends.csv", "SCHEMA_MISMATCH"), ("no%20bytes.csv", "SCHEMA_MISMATCH")]
    assert sum(r.code is None for r in rows) == 3


def test_one_large_file_is_many_tasks(spark, small_splits, tmp_path):
    small_splits(200_000)
    rows = [(str(k), f'said "{k}"\nand more', "x" * (k % 50)) for k in range(40_000)]
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\r\n")
    w.writerows([SPEC.columns, *rows])
    (tmp_path / "x.csv").write_bytes(out.getvalue().encode())
    read = spark.read.option("lineSep", "\n").text(str(tmp_path / "x.csv"))
    assert read.rdd.getNumPartitions() > 5
    got = strict_csv.read_csv_strict(spark, str(tmp_path / "x.csv"), SPEC)
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows)
