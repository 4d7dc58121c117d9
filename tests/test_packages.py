"""Runtime packages written, written again, half written and read; the lookup of cached ones."""

import os

from strophe.operators import cache
from strophe.sources import manifests

PACKAGE = "runtime_key string, quanta array<struct<which:long,start:double,duration:double>>, edges array<struct<src:long,dst:long,distance:double,deleted:boolean>>"


def package(key, n, *edges):
    return key, [(k, float(k), 1.0) for k in range(n)], list(edges)


def test_manifests(spark, tmp_path):
    path = str(tmp_path / "packages")
    frame = lambda *rows: spark.createDataFrame(list(rows), PACKAGE)
    manifests.write_manifests(frame(package("a", 3, (0, 1, 1.0, False)), package("b", 3, (2, 0, 2.0, None), (1, 1, 1.0, False), (0, 9, 1.0, False), (1, 0, float("nan"), False), (1, 2, 1.0, True)), package("empty", 0)), path)
    # only the keys that are written again are replaced
    manifests.write_manifests(frame(package("a", 4, (3, 0, 5.0, False))), path)
    manifests.write_manifests(frame(package("new", 2)), path, version=2)
    # what a killed write leaves behind: staged files, and a partition without a finished file
    os.makedirs(f"{path}/.spark-staging-1/runtime_key=a")
    with open(f"{path}/.spark-staging-1/runtime_key=a/part-0.parquet", "wb") as half:
        half.write(b"PAR1 half a file")
    os.makedirs(f"{path}/_temporary/0")
    found, errors = manifests.read_manifests(spark, path)
    got = {r.runtime_key: (len(r.quanta), [(e.src, e.dst) for e in r.edges], r.n_ignored) for r in found.collect()}
    assert got == {"a": (4, [(3, 0)], 0), "b": (3, [(2, 0)], 4)}
    assert {(r.runtime_key, r.code) for r in errors.collect()} == {("empty", manifests.NO_QUANTA), ("new", manifests.WRONG_VERSION)}


def test_lookup_cases(spark):
    index = [("f", 1, "B", "R1", "old", 1, True), ("f", 1, "b", "r1", "newest", 9, False), ("f", 1, "b", "r2", "near", 5, True), ("f", 2, "b", "r3", "other file", 8, True), ("f", 1, "c", "r4", "exact", 1, True), ("f", 1, "c", "r5", "gone", 2, False)]
    items = spark.createDataFrame(index, "file string, size int, branch_key string, runtime_key string, item string, created int, available boolean")
    inputs = [
        (1, "f", 1, "b", "r1"),  # the newest exact one is gone: the compatible one, though an older exact one is there
        (2, "f", 1, "C", "R4"), (3, "f", 1, "c", "r9"), (4, "f", 2, "c", "r4"), (5, "f", 1, "x", "r1"), (6, None, None, None, None),
    ]
    got = cache.lookup(spark.createDataFrame(inputs, "id int, file string, size int, branch_key string, runtime_key string"), items, "id", ["file", "size"], "created").collect()
    assert {r.id: (r.outcome, r["item"]) for r in got} == {1: ("compatible", "near"), 2: ("exact", "exact"), 3: ("miss", None), 4: ("miss", None), 5: ("miss", None), 6: ("miss", None)}


def test_runtime_options(spark):
    kinds = "similarity double, look_ahead int, min_jump int, max_branches int, jump_probability double, jump_cooldown int, first_pass double, preset string, quantum string"
    row = cache.runtime_options(spark.createDataFrame([(0.1, 9, 1, 0, 1.5, -3, -0.1, " ", "tatums")], kinds)).first()
    assert row[:9] == (0.65, 5, 4, 1, 1.0, 0, 0.0, "Balanced", "tatums") and row.max_threshold == 100.0
