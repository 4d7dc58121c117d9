"""Inputs checked against a listing of files, their identity, and diagnostics of branches of a tiny track."""

import hashlib

from pyspark.sql import functions as F

from strophe.operators import graph
from strophe.sources import audio


def test_checked_inputs(spark, tmp_path):
    for name, content in {"a.wav": b"x", "b.MP3": b"yy", "empty.m4a": b"", "c.flac": b"z", "no": b"z"}.items():
        (tmp_path / name).write_bytes(content)
    want = {"a.wav": None, "b.MP3": None, "empty.m4a": "input_empty_file", "c.flac": "unsupported_audio_format", "no": "unsupported_audio_format", "gone.wav": "input_not_found", "gone.txt": "unsupported_audio_format", "x.wav/no": "unsupported_audio_format", "folder.wav": "input_not_found"}
    (tmp_path / "folder.wav").mkdir()
    paths = [str(tmp_path / name) for name in want]
    inputs = spark.createDataFrame([(k, p) for k, p in enumerate([*paths, None, " ", paths[0], "not/absolute.wav", "/nul\0.wav"])], "id int, path string")
    listed = audio.probed(inputs)
    assert {r.path.rsplit("/", 1)[1]: r.size for r in listed.collect() if r.failure is None} == {"a.wav": 1, "b.MP3": 2, "empty.m4a": 0, "c.flac": 1, "no": 1}
    got = {r.id: (r.code, r.message) for r in audio.checked_inputs(inputs, listed.unionByName(listed)).collect()}
    codes = [*want.values(), "input_invalid", "input_invalid", None, "input_invalid"]
    assert {k: x for k, x in got.items() if k < len(codes)} == {k: (code, audio.INPUT_ERRORS.get(code)) for k, code in enumerate(codes)}
    assert got[len(codes)][0] is not None
    marked = listed.withColumn("failure", F.lit(audio.UNREADABLE))
    assert [r.code for r in audio.checked_inputs(inputs.where("id = 0"), marked).collect()] == ["input_locked_or_unreadable"]
    found = {r.path: (r.size, r.sha256, r.modified.timestamp() > 0) for r in audio.identities(spark, str(tmp_path)).collect()}
    assert found[paths[1]] == (2, hashlib.sha256(b"yy").hexdigest(), True) and len(found) == 4


def test_short_pairs(spark):
    rows = [(1, k, k % 4, [float(k * k % 7), 1.0]) for k in range(40)] + [(2, 0, 0, [0.0, 0.0])]
    quanta = spark.createDataFrame(rows, "t int, which long, index_in_parent int, v array<double>")
    got = {(r.t, r.src, r.dst): r.distance for r in graph.short_pairs(quanta, "t", "v", 2.0, 5).collect()}
    want = {(1, a, b): 2.0 * abs(x[0] - y[0]) + (0 if i == j else 100) for _, a, i, x in rows[:40] for _, b, j, y in rows[:40] if 0 < abs(a - b) < 5}
    assert got == want


def test_branch_diagnostics(spark):
    short = spark.createDataFrame([(1, "rejected"), (1, "accepted"), (2, "rejected"), (2, "rejected")], "t int, decision string")
    near = spark.createDataFrame([(1,), (1,)], "t int")
    pruned = spark.createDataFrame([(1, True, True), (1, False, True), (1, False, False)], "t int, deleted boolean, local_loop boolean")
    sizes = spark.createDataFrame([(1, 5), (2, 5), (3, 1)], "t int, n int")
    rows = {tuple(r) for r in graph.branch_diagnostics(short, near, pruned, sizes, "t").select("t", "n_candidates", "n_active", "n_removed", "n_risk", "n_rejected").collect()}
    assert rows == {(1, 2, 2, 1, 1, 1), (2, 0, 0, 0, 0, 2), (3, 0, 0, 0, 0, 0)}
