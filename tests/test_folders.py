import os

from pyspark.sql import functions as F

from lumenshelf.sources import folders
from lumenshelf.sources.folders import Below, FolderReader, walk_folders

FILES = {"a/one.png": 3, "a/deep/er/two.WAV": 5, "a/deep/three.txt": 1, "b/four.png": 2, "root.md": 4, "b/.hidden": 1, "c d/ü.png": 6, "b/none": 0}


def tree(base):
    for path, size in FILES.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_bytes(b"x" * size)
    (base / "empty").mkdir()
    os.symlink(base / "a", base / "b" / "link")
    return str(base)


def found(frame):
    return {r["path"]: r["size"] for r in frame.collect()}


def test_a_walk_is_spread_over_tasks(spark, tmp_path):
    root = tree(tmp_path)
    rows = walk_folders(spark, root)
    assert found(rows) == FILES and rows.where("error IS NOT NULL").count() == 0
    assert rows.rdd.getNumPartitions() >= 6
    when = int(os.stat(tmp_path / "root.md").st_mtime_ns // 1_000_000)
    assert rows.where("path = 'root.md'").first()["mtime"] == when


def test_filters_reach_the_listing(spark, tmp_path, monkeypatch):
    root = tree(tmp_path)
    rows = walk_folders(spark, root)
    assert found(rows.where("extension IN ('png', 'wav')")) == {p: n for p, n in FILES.items() if p.lower().endswith(("png", "wav"))}
    assert found(rows.where(F.col("path").startswith("a/deep") & (F.col("size") > 1))) == {"a/deep/er/two.WAV": 5}
    assert found(rows.where("extension = 'png' AND extension = 'wav'")) == {}
    reader = FolderReader(root, [""])
    assert list(reader.pushFilters([folders.StringStartsWith(("path",), "a/deep"), folders.EqualTo(("size",), 3)])) == [folders.EqualTo(("size",), 3)]
    assert {p.folder for p in reader.partitions()} == {"", "a", "a/deep", "a/deep/er"}  # others are not opened


def test_scopes_and_what_cannot_be_read(spark, tmp_path, monkeypatch):
    root = tree(tmp_path)
    rows = walk_folders(spark, root, ["a/deep", "nowhere", "root.md"])
    assert {(r["path"], r["size"]) for r in rows.where("error IS NULL").collect()} == {("a/deep/three.txt", 1), ("a/deep/er/two.WAV", 5)}
    assert {r["path"]: r["error"] for r in rows.where("error IS NOT NULL").collect()} == {"nowhere": "No such file or directory", "root.md": "Not a directory"}
    real = os.scandir

    def closed(path):
        if str(path).endswith("/b"):
            raise PermissionError(13, "Permission denied")
        return real(path)

    monkeypatch.setattr(folders.os, "scandir", closed)
    got = {r[0]: (r[2], r[4]) for part in FolderReader(root, [""]).partitions() for r in FolderReader(root, [""]).walk(part)}
    assert got.pop("b") == (None, "Permission denied")
    assert {p: s for p, (s, _) in got.items()} == {p: n for p, n in FILES.items() if not p.startswith("b/")}
    assert list(FolderReader(root, [""]).walk(Below("empty", True))) == []
