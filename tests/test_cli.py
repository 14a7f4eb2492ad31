"""The command line: reports and exit codes."""

import json

import pytest
from test_engine import ROWS, TRIALS, as_csv, row, zipped

from tidemark import cli
from tidemark.errors import CODES, SnapshotError


def call(tmp_path, *args):
    out = tmp_path / "report.json"
    out.unlink(missing_ok=True)
    code = cli.main([*args, "--report", str(out)])
    return code, json.loads(out.read_text()) if out.exists() else None


def test_check_build_verify(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes(as_csv(ROWS).encode())
    (tmp_path / "a.zip").write_bytes(zipped(as_csv(ROWS).encode()))
    root = f"file://{tmp_path}/site"
    code, got = call(tmp_path, "check", "--zip", str(tmp_path / "a.zip"), "--prev-rows", "10")
    assert code == 0 and got["rowCount"] == 10 and got["columns"] == list(TRIALS.columns) and got["verdict"] == "ok" and got["sourceKind"] == "zip"
    code, _ = call(tmp_path, "check", "--csv", str(tmp_path / "in"), "--prev-rows", "13")
    assert code == SnapshotError("ROWCOUNT_DROP").exit_code and "[ROWCOUNT_DROP] layer=content" in capsys.readouterr().err
    code, got = call(tmp_path, "build", "--csv", str(tmp_path / "in"), "--root", root, "--date", "2024-06-01", "--lists", f"file://{tmp_path}/lists")
    assert code == 0 and got["changed"] and got["schema"]["verdict"] == "bootstrap" and got["quality"]["warnings"] == [{"code": "BOOTSTRAP"}]
    assert got["quality"]["near_duplicates"]["count"] == 2 and got["quality"]["test_rows"]["count"] == 1
    near = [json.loads(x) for f in (tmp_path / "lists" / "near_duplicates").glob("part-*") for x in f.read_text().splitlines()]
    assert {(r["loose"], r["members"]) for r in near} == {("ABC1", 2)} and {r["identity"] for r in near} == {"ABC-1", "ABC 1"}
    assert [c["count"] for c in got["quality"]["conflicts"]] == sorted((c["count"] for c in got["quality"]["conflicts"]), reverse=True)
    version = got["datasetVersion"]
    code, got = call(tmp_path, "build", "--csv", str(tmp_path / "in"), "--root", root, "--date", "2024-06-01", "--start-bytes", "10")
    assert code == SnapshotError("INTEGRITY_DIGEST").exit_code
    code, got = call(tmp_path, "verify", "--root", root)
    assert code == 0 and got == {"violated": [], "unevaluable": ["I8.brotliBytes"], "changed": []}
    file = next((tmp_path / "site" / f"version={version}").glob("stats.*.json"))
    file.write_bytes(file.read_bytes().replace(b"1", b"2"))
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    code, got = call(tmp_path, "verify", "--root", root)
    assert code == SnapshotError("INTEGRITY_DIGEST").exit_code and got["changed"] == ["stats"]


def test_collisions_are_reported_before_the_exit(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(as_csv([row(protocol="abc-1"), row(protocol="ABC-1"), row(protocol=" ABC-1"), row(protocol="Z")]).encode())
    code, got = call(tmp_path, "build", "--csv", str(tmp_path / "x.csv"), "--root", f"file://{tmp_path}/site")
    assert code == SnapshotError("IDENTITY_COLLISION").exit_code
    (group,) = got["collisions"]["groups"]
    assert group["identityNormalized"] == "ABC-1" and [m["strippedRaw"] for m in group["members"]] == ["ABC-1", "abc-1"] and group["members"][0]["raws"] == [" ABC-1", "ABC-1"]
    assert not (tmp_path / "site").exists()


def test_faults_of_the_program_are_not_swallowed(capsys):
    def broken():
        raise KeyError("x")

    with pytest.raises(KeyError):
        cli.run(broken)
    codes = set()
    for c in CODES:
        def fail(c=c):
            raise SnapshotError(c, "m", a=1)

        codes.add(cli.run(fail))
    said = capsys.readouterr().err
    assert len(codes) == len(CODES) and 0 not in codes and all(f"[{c}] layer=" in said for c in CODES)
    cli.emit({"a": "é"}, None)
    assert capsys.readouterr().out == '{\n "a": "é"\n}\n'
