"""Ingesting what has changed: after every change the working folder is what a fresh ingest makes."""

import os
import time

import pytest

from corrobora import cli, config
from corrobora.sources import manifest
from corrobora.store import Store

LONG = "We review how backups are taken and restoration is tested. Every week there is a report. " * 40


def run_in(spark, docs, out, **more):
    made, _ = config.load(None, {"docsPath": str(docs), "workDir": str(out), "fixedNow": "2020-01-01T00:00:00Z", **more})
    return cli.Run(spark, made)


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    # A time of its own, whatever the file system's resolution.
    put.clock += 10
    os.utime(path, (put.clock, put.clock))


put.clock = time.time() - 10_000


def state(run):
    chunks = sorted((r.pos, r.id, r.path, r.page, r.char_start, r.char_end, r.text, tuple(r.vector)) for r in run._chunks().collect())
    files = sorted((r.path, r.sha, r.status, str(r.reason)) for r in run._read("manifest").where("gone_at IS NULL").collect())
    return run._read("index").first().index_id, chunks, files


def fresh(spark, docs, tmp_path, name, **more):
    other = run_in(spark, docs, tmp_path / name, **more)
    other.ingest()
    return state(other)


def test_every_change_ends_in_what_a_fresh_ingest_makes(spark, tmp_path, monkeypatch):
    docs = tmp_path / "docs"
    put(docs / "a.txt", LONG)
    put(docs / "b.md", "# Title\n\nShort text of b.")
    put(docs / "sub/c.txt", LONG.replace("week", "month"))
    put(docs / "bad.pdf", b"no pdf")
    run = run_in(spark, docs, tmp_path / "out")
    assert run.ingest() == {"parsed": 3, "failed": 1}
    assert state(run) == fresh(spark, docs, tmp_path, "f0")

    seen = []
    parse = cli.documents.parse
    monkeypatch.setattr(cli.documents, "parse", lambda files, *a: (seen.extend(r.path.rsplit("/", 1)[1] for r in files.select("path").collect()), parse(files, *a))[1])
    before = {n for names in run._store("chunks").snapshot().files.values() for n in names}
    steps = [
        (lambda: None, {"new": 0, "changed": 0, "gone": 0, "same": 4}, []),
        (lambda: put(docs / "d.txt", LONG + "More of it."), {"new": 1, "changed": 0, "gone": 0, "same": 4}, ["d.txt"]),
        (lambda: put(docs / "a.txt", "Now a is quite another text."), {"new": 0, "changed": 1, "gone": 0, "same": 4}, ["a.txt"]),
        (lambda: put(docs / "b.md", "# Title\n\nShort text of b."), {"new": 0, "changed": 0, "gone": 0, "same": 5}, []),
        (lambda: (docs / "sub/c.txt").unlink(), {"new": 0, "changed": 0, "gone": 1, "same": 4}, []),
        (lambda: put(docs / "d.txt", " \n"), {"new": 0, "changed": 1, "gone": 0, "same": 3}, ["d.txt"]),
        (lambda: put(docs / "sub/c.txt", "c is back."), {"new": 1, "changed": 0, "gone": 0, "same": 4}, ["c.txt"]),
    ]
    for k, (step, kinds, read) in enumerate(steps):
        step()
        seen.clear()
        told = run.ingest()
        assert {x: told[x] for x in kinds} == kinds and sorted(seen) == read, k
        assert state(run) == fresh(spark, docs, tmp_path, f"f{k + 1}"), k
        if k == 1:
            # The chunks of other documents are where they were.
            now = {n for names in run._store("chunks").snapshot().files.values() for n in names}
            assert len(before & now) >= len(before) - 1
    gone = run._read("manifest").where("gone_at IS NOT NULL").count()
    assert gone == 0 and run._read("manifest").count() == 5


def test_gone_files_leave_a_tombstone(spark, tmp_path):
    docs = tmp_path / "docs"
    put(docs / "a.txt", "text of a")
    put(docs / "b.txt", "text of b")
    run = run_in(spark, docs, tmp_path / "out")
    run.ingest()
    (docs / "b.txt").unlink()
    assert run.ingest()["gone"] == 1 and run.ingest()["gone"] == 0
    row = run._read("manifest").where("gone_at IS NOT NULL").first()
    assert row.path.endswith("b.txt") and row.gone_at == "2020-01-01T00:00:00Z" and row.sha
    (docs / "a.txt").unlink()
    with pytest.raises(ValueError, match="no document"):
        run.ingest()


def test_times_are_trusted_unless_told_otherwise(spark, tmp_path):
    docs = tmp_path / "docs"
    put(docs / "a.txt", "text of a")
    run = run_in(spark, docs, tmp_path / "out")
    run.ingest()
    stamp = os.stat(docs / "a.txt")
    (docs / "a.txt").write_text("text of b")
    os.utime(docs / "a.txt", ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    assert run.ingest()["same"] == 1
    run.config["trustTimes"] = False
    assert run.ingest()["changed"] == 1 and run._chunks().first().text == "text of b"


def test_other_settings_read_all_anew(spark, tmp_path):
    docs = tmp_path / "docs"
    put(docs / "a.txt", LONG)
    run = run_in(spark, docs, tmp_path / "out")
    run.ingest()
    other = run_in(spark, docs, tmp_path / "out", chunk={"size": 300, "overlap": 20})
    assert other.ingest() == {"parsed": 1}
    assert state(other) == fresh(spark, docs, tmp_path, "f", chunk={"size": 300, "overlap": 20})
    other.config["force"] = True
    assert other.ingest() == {"parsed": 1}


@pytest.mark.parametrize("table", ["chunks", "manifest", "index"])
def test_a_run_that_breaks_off_is_taken_up_again(spark, tmp_path, monkeypatch, table):
    docs = tmp_path / "docs"
    put(docs / "a.txt", "text of a")
    put(docs / "b.txt", "text of b")
    run = run_in(spark, docs, tmp_path / "out")
    run.ingest()
    put(docs / "a.txt", "other text of a")
    put(docs / "c.txt", "text of c")
    (docs / "b.txt").unlink()
    commit = Store._commit

    def broken(self, base, schema, files, note):
        if self.path.endswith(table) and (table != "chunks" or note == "upsert"):
            raise OSError("the driver is gone")
        return commit(self, base, schema, files, note)

    monkeypatch.setattr(Store, "_commit", broken)
    with pytest.raises(OSError):
        run.ingest()
    monkeypatch.undo()
    again = run_in(spark, docs, tmp_path / "out")
    again.ingest()
    assert state(again) == fresh(spark, docs, tmp_path, "f")


def test_diff_of_empty_sides(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    put(tmp_path / "docs/a.txt", "a")
    none = spark.createDataFrame([], manifest.MANIFEST)
    found = manifest.files(spark, str(tmp_path / "docs"))
    assert [r.change for r in manifest.diff(found, none).collect()] == ["new"]
    assert manifest.diff(found.limit(0), none).count() == 0
