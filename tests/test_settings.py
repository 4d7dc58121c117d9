"""Settings documents of every schema version, corrupt ones, and options out of range, against plain rules."""

import json
import math

from strophe.operators import settings

BALANCED = {"preset": "Balanced", "similarity": 0.86, "look_ahead": 1, "min_jump": 4, "max_branches": 6, "jump_probability": 0.85, "jump_cooldown": 4, "first_pass": 0.1, "quantum": "beats", "max_threshold": 80, "musical_quality": True, "provider": "Enhanced"}
OLD_BALANCED = {"Preset": "balanced", "SimilarityThreshold": 0.86, "LookaheadDepth": 4, "MinJumpDistance": 20, "MaxBranchesPerBeat": 4, "BranchMaxThreshold": 80, "AnalysisBeatProvider": "classic"}
OLD_WILD = {"Preset": "WILD", "SimilarityThreshold": 0.78005, "LookaheadDepth": 1, "MinJumpDistance": 4, "MaxBranchesPerBeat": 6, "JumpProbability": 0.42, "JumpCooldown": 6, "FirstPassLinearPlaybackRatio": 0.7}
WILD = {"preset": "Wild", "similarity": 0.78, "max_branches": 8, "jump_probability": 1.0, "jump_cooldown": 0, "first_pass": 0.0, "max_threshold": 95}


def migrate(spark, documents):
    rows = spark.createDataFrame(list(enumerate(documents)), "id int, text string")
    found = settings.migrated(settings.read_settings(rows, "text")).orderBy("id").collect()
    return [(r.corrupt, r.schema_version, r.theme, {x: r[x] for x in settings.COLUMNS}) for r in found]


def document(version=None, tuning=None, **more):
    return json.dumps(({} if version is None else {"SettingsSchemaVersion": version}) | ({} if tuning is None else {"Tuning": tuning}) | more)


def test_versions(spark):
    versions = [1, 3, 4, 5, 6, 9, None]
    got = migrate(spark, [document(v, OLD_BALANCED) for v in versions])
    kept = BALANCED | {"look_ahead": 4, "min_jump": 20, "max_branches": 4, "provider": "Classic"}
    for version, (corrupt, now, theme, tuning) in zip(versions, got, strict=True):
        assert (corrupt, now, theme) == (None, max(6, version or 6), "Dark")
        assert tuning == (BALANCED if version in (1, 3) else kept)
    got = migrate(spark, [document(v, OLD_WILD) for v in versions])
    for version, (_, _, _, tuning) in zip(versions, got, strict=True):
        own = {"preset": "Wild", "similarity": 0.78005, "jump_probability": 0.42, "jump_cooldown": 6, "first_pass": 0.7, "max_threshold": 95}
        assert tuning == BALANCED | (WILD if version in (1, 3, 4) else own)
    # every older version of an unchanged document ends as one row
    assert len({repr(x[3]) for x in migrate(spark, [document(v, OLD_WILD) for v in range(5)])}) == 1
    changed = migrate(spark, [document(1, OLD_WILD | {"JumpCooldown": 7})])[0][3]
    assert changed["jump_cooldown"] == 7 and changed["first_pass"] == 0.7


def test_clamps(spark):
    low = document(6, {"Preset": "none such", "SimilarityThreshold": -1, "LookaheadDepth": 0, "MinJumpDistance": -5, "MaxBranchesPerBeat": 0, "JumpProbability": -0.5, "JumpCooldown": -1, "FirstPassLinearPlaybackRatio": -2, "BranchQuantumType": " ", "BranchMaxThreshold": 7, "AnalysisMusicalQuality": False, "AnalysisBeatProvider": None}, Theme=" ")
    high = document(6, {"Preset": None, "SimilarityThreshold": 2e9, "LookaheadDepth": 99, "MinJumpDistance": 99, "MaxBranchesPerBeat": 99, "JumpProbability": 9, "JumpCooldown": 99, "FirstPassLinearPlaybackRatio": 1, "BranchQuantumType": "tatums", "AnalysisBeatProvider": "CLASSIC"}, Theme="Light", More=[1])
    (_, _, theme, a), (_, _, light, b) = migrate(spark, [low, high])
    assert (theme, light) == ("Dark", "Light")
    assert a == BALANCED | {"similarity": 0.65, "min_jump": 4, "max_branches": 1, "jump_probability": 0.0, "jump_cooldown": 0, "first_pass": 0.0, "max_threshold": 100, "musical_quality": False}
    assert b == {"preset": "Balanced", "similarity": 0.95, "look_ahead": 5, "min_jump": 64, "max_branches": 12, "jump_probability": 1.0, "jump_cooldown": 64, "first_pass": 0.95, "quantum": "tatums", "max_threshold": 65, "musical_quality": True, "provider": "Classic"}


def test_corrupt_and_absent(spark):
    corrupt = ["", "{", "[]", "3", '"x"', document(6, 4), document("6"), document(6, {"LookaheadDepth": 1.5}), document(6, {"LookaheadDepth": None}), document(6, {"JumpCooldown": 3_000_000_000}), document(6, {"JumpProbability": "1"}), document(6, {"AnalysisMusicalQuality": None}), document(6, {"Preset": 4}), document(6, Theme=4)]
    absent = [None, "null", "{}", '{"Tuning": null}', '{"tuning": {"LookaheadDepth": 3}}']
    for text, found in zip(corrupt, migrate(spark, corrupt), strict=True):
        assert found == (text, 6, "Dark", BALANCED)
    for found in migrate(spark, absent):
        assert found == (None, 6, "Dark", BALANCED)
    assert migrate(spark, []) == []


def test_options(spark):
    names = "min_chance double, max_chance double, jump_probability double, first_pass double, chance_step double, cooldown int, repeat_penalty double"
    nan, inf = math.nan, math.inf
    rows = [(0.9, 0.2, 2.0, -1.0, -0.1, -1, 1.5), (nan, inf, nan, -inf, inf, None, nan), (0.7, nan, 0.5, 0.5, 0.0, 0, 0.0)]
    got = [tuple(r) for r in settings.decision_options(spark.createDataFrame(rows, names).coalesce(1)).collect()]
    assert got == [(0.2, 0.9, 1.0, 0.0, 0.018, 12, 1.0), (0.18, 0.5, 0.22, 0.78, 0.018, 12, 1.0), (0.5, 0.7, 0.5, 0.5, 0.0, 0, 0.0)]
    rows = [(nan, 0, -1, None), (0.1, 1, 2, 9), (1.0, 5, 5, 5)]
    got = [tuple(r) for r in settings.guard_options(spark.createDataFrame(rows, "guard_start double, beats_before_end int, look_ahead int, search_depth int").coalesce(1)).collect()]
    assert got == [(0.85, 16, 24, 3), (0.5, 1, 2, 9), (0.98, 5, 5, 5)]
