"""Names, formats and written exports."""

import gzip
import json
from hashlib import sha256
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenshelf.functions import digests
from lumenshelf.operators import exchange


def names_of(spark, names, taken=(), tail=".json"):
    rows = spark.createDataFrame(list(enumerate(names)), "id long, filename string")
    held = spark.createDataFrame([(t,) for t in taken], "name string") if taken else None
    out = exchange.numbered(rows, F.col("filename"), F.lit(tail), F.col("id"), held).collect()
    assert len(out) == len(names)
    return [r["target"] for r in sorted(out, key=lambda r: r["id"])]


def slow_names(names, taken=(), tail=".json"):
    asked, given, out = {n + tail for n in names} | set(taken), set(taken), []
    for n in names:
        k, name = 0, n + tail
        while name in given or (k and name in asked):
            k += 1
            name = f"{n}-{k}{tail}"
        given.add(name)
        out.append(name)
    return out


@pytest.mark.parametrize(
    ("names", "taken"),
    [(["x", "x", "x-1"], ()), (["x-1", "x", "x"], ()), (["x"] * 5 + ["x-2", "x-4", "x-2", "x-2-1"], ()), (["a", "b"], ()), (["a", "a"], ("a.json", "a-1.json", "a-3.json")), (["x-01", "x", "x"], ())],
)
def test_numbered_names_never_collide(spark, names, taken):
    got = names_of(spark, names, taken)
    assert got == slow_names(names, taken)
    assert len(set(got)) == len(got) and not set(got) & set(taken)


def test_sidecar_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b.png"), (2, "a_b.png"), (3, "a_b.png-1"), (4, ""), (None, "ü.wav")], "id long, filename string").repartition(3)
    out = tmp_path / "out"
    for _ in range(2):  # an attempt that is repeated leaves the same files
        assert exchange.write_sidecars(rows, str(out)) == 5
    planned = {r["file"]: r["id"] for r in exchange.sidecars(rows).collect()}
    assert {p.name for p in out.iterdir()} == {*planned, "_SUCCESS"}
    assert all(json.loads((out / name).read_text()).get("id") == i for name, i in planned.items())
    assert exchange.write_sidecars(rows.limit(0), str(tmp_path / "none")) == 0


def manifest_of(folder):
    return json.loads("".join(p.read_text() for p in sorted(Path(folder).glob("part-*"))))["assets"]


def test_a_json_manifest_is_one_document(spark, tmp_path):
    rows = spark.range(50).select("id", F.concat(F.lit("n"), "id").alias("filename")).repartition(7).orderBy("id")
    exchange.write_manifest(rows, str(tmp_path / "out"), "json")
    assert [a["id"] for a in manifest_of(tmp_path / "out")] == list(range(50))
    exchange.write_manifest(rows.limit(0), str(tmp_path / "none"), "json")
    assert manifest_of(tmp_path / "none") == []


def test_a_manifest_keeps_order_and_repeats(spark, tmp_path):
    ids = [7, 3, 3, None, 3, 9, 1, None, 1]
    rows = spark.createDataFrame([(k, i, f"n{i}") for k, i in enumerate(ids)], "k int, id long, filename string").repartition(4).orderBy("k").drop("k")
    exchange.write_manifest(rows, str(tmp_path / "out"), "json")
    assert [a.get("id") for a in manifest_of(tmp_path / "out")] == ids


@pytest.mark.parametrize(
    ("path", "found", "taken"),
    [("a/LICENSE", "document:txt", True), ("node_modules/x/LICENSE", "document:txt", True), ("node_modules/x/readme.md", "document:md", False), ("Library/t.png", "image:png", True), ("x/readme", None, False), ("Saved/notice.txt", "document:txt", True), ("temp/a.txt", "document:txt", False)],
)
def test_formats_and_admission(spark, path, found, taken):
    r = spark.range(1).select(exchange.detected_media(F.lit(path)).alias("m"), exchange.detected_format(F.lit(path)).alias("f"), exchange.admitted(F.lit(path)).alias("a")).first()
    assert (f"{r['m']}:{r['f']}" if r["m"] else None) == found and bool(r["a"]) == taken


@pytest.mark.parametrize(
    ("source", "allowed", "own", "asked"),
    [
        (None, None, True, ["p1", "p2"]),
        (None, ["s1", "p2"], True, ["p2"]),
        (None, [], True, []),
        ("p1", None, False, ["p1"]),
        ("p1", ["p1"], False, ["p1"]),
        ("p1", ["s1", "p2"], True, []),
        ("s1", None, True, []),
        ("gone", None, True, []),
    ],
)
def test_routes(source, allowed, own, asked):
    assert exchange.routed(["p2", "p1"], source, allowed) == (own, asked)


def test_federated_pages(spark):
    rows = "id long, filename string, size long, source_id string"
    local = spark.createDataFrame([(1, "b", 1, "s1"), (2, "a", None, "s2"), (3, None, 3, None)], rows)
    theirs = {"p1": spark.createDataFrame([(1, "A", 5, "s1"), (9, "c", 6, None)], rows), "p2": spark.createDataFrame([], rows)}

    def page(**how):
        found = exchange.federated(local, theirs, "name", False, how.pop("limit", 10), [F.col("id")], **how).collect()
        return [(r["id"], r["source_id"]) for r in found], {(r["partial"], *r["missing"]) for r in found}

    # Another library's source of the same name is no own source, and names compare without case first.
    assert page() == ([(3, None), (1, "p1"), (2, "s2"), (1, "s1"), (9, "p1")], {(False,)})
    assert page(source="s1") == ([(1, "s1")], {(False,)})
    assert page(source="p1", limit=1) == ([(1, "p1")], {(False,)})
    assert page(source="p1", allowed=["s1"]) == ([], set())
    assert page(allowed=["s1"], silent=["p1"]) == ([(1, "s1")], {(False,)})
    assert page(silent=["p1"]) == ([(3, None), (2, "s2"), (1, "s1")], {(True, "p1")})
    assert page(source="p1", silent=["p1"]) == ([], set())
    assert page(allowed=[]) == ([], set())


def test_digests_of_large_files_are_made_in_parts(spark, tmp_path):
    rng = np.random.default_rng(3)
    files = {
        "a.bin": rng.integers(0, 256, 130_001, np.uint8).tobytes(), "sub/b [x] %20ä.parquet": rng.integers(9, 14, 30_000, np.uint8).tobytes(), "ends.txt": b"one\r\ntwo\n" * 3_000, "lines.txt": b"\n" * 20_000,
        "mark.csv": b"\xef\xbb\xbf" + b"a,b\n" * 9_000, "mark_open.csv": b"\xef\xbb\xbf" + b"a,b\n" * 9_000 + b"c", "none.bin": b"\0" * 61_000, "packed.gz": gzip.compress(rng.bytes(50_000)), "small": b"x\n",
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert digests.resumable()
    # Splits shorter than a file, and whole rows refused above the size of the packed one.
    conf = {"spark.sql.files.maxPartitionBytes": "9973", "spark.sql.files.openCostInBytes": "1", "spark.sql.sources.binaryFile.maxLength": "60000"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        found = exchange.fetched(spark, str(tmp_path), whole_file=1_000, round_bytes=45_000)
        got = {r["path"]: (r["size"], r["sha"]) for r in found.collect()}
        # No part, which is what a task reads of a file, is longer than a split and the line that leaves it.
        lines = exchange.files_of(spark, str(tmp_path / "a.bin"), None, None, "text", lineSep="\n").selectExpr("_metadata.file_path AS key", "_metadata.file_block_start AS start", "CAST(value AS BINARY) AS value")
        parts = digests.line_parts(lines, 45_000).groupBy("start").agg(F.sum("n").alias("n")).collect()
    finally:
        for key in conf:
            spark.conf.unset(key)
    assert got == {name: (len(data), sha256(data).hexdigest()) for name, data in files.items()}
    assert len(parts) > 10 and max(r["n"] for r in parts) < 9973 + 4000
