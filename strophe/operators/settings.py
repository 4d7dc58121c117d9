"""Settings kept as JSON documents of several schema versions, brought to the present one.

A document is parsed once to a variant; each field is a column with its type checked, and each
schema version is a rewrite of those columns that is applied to the older documents only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.functions.columns import clamp, similarity_threshold

#: The present schema version, and what a document without theme stands for.
VERSION, THEME = 6, "Dark"
#: Fields of a document under ``Tuning``, as column and type.
FIELDS = {
    "Preset": ("preset", "string"), "SimilarityThreshold": ("similarity", "double"), "LookaheadDepth": ("look_ahead", "int"), "MinJumpDistance": ("min_jump", "int"),
    "MaxBranchesPerBeat": ("max_branches", "int"), "JumpProbability": ("jump_probability", "double"), "JumpCooldown": ("jump_cooldown", "int"),
    "FirstPassLinearPlaybackRatio": ("first_pass", "double"), "BranchQuantumType": ("quantum", "string"), "BranchMaxThreshold": ("max_threshold", "int"),
    "AnalysisMusicalQuality": ("musical_quality", "boolean"), "AnalysisBeatProvider": ("provider", "string"),
}
#: The presets; a field that a document leaves out is that of Balanced.
COMMON = {"quantum": "beats", "musical_quality": True, "provider": "Enhanced"}
PRESETS = {
    "Conservative": {"similarity": 0.92, "look_ahead": 2, "min_jump": 16, "max_branches": 2, "jump_probability": 0.35, "jump_cooldown": 12, "first_pass": 0.50, "max_threshold": 70},
    "Balanced": {"similarity": 0.86, "look_ahead": 1, "min_jump": 4, "max_branches": 6, "jump_probability": 0.85, "jump_cooldown": 4, "first_pass": 0.10, "max_threshold": 80},
    "Wild": {"similarity": 0.78, "look_ahead": 1, "min_jump": 4, "max_branches": 8, "jump_probability": 1.00, "jump_cooldown": 0, "first_pass": 0.00, "max_threshold": 95},
}
DEFAULT = "Balanced"
PROVIDERS = ["Enhanced", "Classic"]
#: The presets as older schema versions had them, by the first version that no longer has them. A
#: document that holds one unchanged takes the present preset of that name.
FORMER = [
    (4, "Balanced", {"similarity": 0.86, "look_ahead": 4, "min_jump": 20, "max_branches": 4, "max_threshold": 80}),
    (5, "Conservative", {"similarity": 0.92, "look_ahead": 2, "min_jump": 16, "max_branches": 2, "jump_probability": 0.14, "jump_cooldown": 16, "first_pass": 0.82}),
    (5, "Balanced", {"similarity": 0.86, "look_ahead": 1, "min_jump": 4, "max_branches": 4, "jump_probability": 0.22, "jump_cooldown": 12, "first_pass": 0.78}),
    (5, "Wild", {"similarity": 0.78, "look_ahead": 1, "min_jump": 4, "max_branches": 6, "jump_probability": 0.42, "jump_cooldown": 6, "first_pass": 0.70}),
]
#: Bounds of the fields, and how near a number must be to a former preset's.
BOUNDS = {"similarity": (0.65, 0.95), "look_ahead": (1, 5), "min_jump": (4, 64), "max_branches": (1, 12), "jump_probability": (0.0, 1.0), "jump_cooldown": (0, 64), "first_pass": (0.0, 0.95)}
NEAR = 0.0001
COLUMNS = [column for column, _ in FIELDS.values()]


def preset(name: str) -> Column:
    """The preset ``name`` as a struct of COLUMNS."""
    values = {"preset": name, **COMMON, **PRESETS[name]}
    return F.struct(*[F.lit(values[column]).cast(kind).alias(column) for column, kind in FIELDS.values()])


def _named(x: Column, names: list[str], default: str) -> Column:
    """The one of ``names`` that is x but for case, else ``default``."""
    found = [F.when(F.lower(x) == name.lower(), F.lit(name)) for name in names]
    return F.coalesce(*found, F.lit(default))


def _blank(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit(""))) == ""


def _field(document: Column, path: str, kind: str) -> tuple[Column, Column, Column]:
    """Whether the document has the field, whether it is of the type, and its value. A string may be null."""
    held = F.try_variant_get(document, path, "variant")
    found = F.schema_of_variant(held)
    value = F.try_variant_get(document, path, kind)
    if kind == "string":
        fits = found.isin("STRING", "VOID")
    elif kind == "boolean":
        fits = found == "BOOLEAN"
    else:
        fits = (found.isin("BIGINT") if kind == "int" else found.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")) & value.isNotNull()
    return held.isNotNull(), fits, value


def read_settings(rows: DataFrame, text: str) -> DataFrame:
    """Adds schema_version, theme, tuning and corrupt, read from the document in the column ``text``.

    A field that is left out has the default of today's documents, the schema version too. A document that is
    no JSON object, or has a field of another type, is kept in ``corrupt`` and has all defaults; null, as
    text or in JSON, stands for no settings and has them too. Names of fields match with their case. Whole
    numbers are those written without a point.
    """
    document = F.try_parse_json(text)
    rows = rows.withColumn("_document", document)
    document = F.col("_document")
    kind, tuning = F.schema_of_variant(document), F.schema_of_variant(F.try_variant_get(document, "$.Tuning", "variant"))
    values, fits = {}, []
    for name, (column, of) in FIELDS.items():
        there, fine, value = _field(document, f"$.Tuning.{name}", of)
        default = {"preset": DEFAULT, **COMMON, **PRESETS[DEFAULT]}[column]
        values[column] = F.when(there, value).otherwise(F.lit(default).cast(of)).alias(column)
        fits.append(~there | fine)
    versioned, whole, version = _field(document, "$.SettingsSchemaVersion", "int")
    themed, worded, theme = _field(document, "$.Theme", "string")
    fits += [~versioned | whole, ~themed | worded]
    bad = [~x for x in fits] + [tuning.isNotNull() & ~tuning.startswith("OBJECT") & (tuning != "VOID"), document.isNull(), ~kind.startswith("OBJECT") & (kind != "VOID")]
    corrupt = F.col(text).isNotNull() & F.array_contains(F.array(*[F.coalesce(x, F.lit(False)) for x in bad]), True)
    rows = rows.withColumn("corrupt", F.when(corrupt, F.col(text)))
    sound = F.col("corrupt").isNull()
    return rows.withColumns({
        "schema_version": F.when(sound & versioned, version).otherwise(F.lit(VERSION)), "theme": F.when(sound & themed, theme).otherwise(F.lit(THEME)),
        "tuning": F.when(sound & tuning.startswith("OBJECT"), F.struct(*values.values())).otherwise(preset(DEFAULT)),
    }).drop("_document")


def migrated(rows: DataFrame) -> DataFrame:
    """``read_settings`` brought to VERSION: schema_version, theme and a column for each field of the tuning.

    Every schema version since is a rewrite of the older documents, in order. Then numbers are held to
    their bounds, unknown names become the default and max_threshold is that of the similarity.
    """
    tuning = F.col("tuning")
    for version in sorted({before for before, _, _ in FORMER}):
        cases = None
        for _, name, values in (x for x in FORMER if x[0] == version):
            same = F.lower(tuning["preset"]) == name.lower()
            for column, value in values.items():
                same = same & (F.abs(tuning[column] - value) < NEAR if isinstance(value, float) else tuning[column] == value)
            same = (F.col("schema_version") < version) & same
            cases = F.when(same, preset(name)) if cases is None else cases.when(same, preset(name))
        rows = rows.withColumn("tuning", cases.otherwise(tuning))
    held = {x: F.coalesce(clamp(tuning[x], low, high), F.lit(low)) for x, (low, high) in BOUNDS.items()}
    named = {"preset": _named(tuning["preset"], list(PRESETS), DEFAULT), "provider": _named(tuning["provider"], PROVIDERS, PROVIDERS[0])}
    quantum = F.when(_blank(tuning["quantum"]), COMMON["quantum"]).otherwise(tuning["quantum"])
    whole = {"schema_version": F.greatest("schema_version", F.lit(VERSION)), "theme": F.when(_blank(F.col("theme")), THEME).otherwise(F.col("theme"))}
    out = {**held, **named, "quantum": quantum, "musical_quality": tuning["musical_quality"], "max_threshold": similarity_threshold(held["similarity"]).cast("int"), **whole}
    return rows.withColumns(out).drop("tuning")


#: What a chance or length out of its range stands for, and the bounds of the rest.
CHANCES = {"min_chance": 0.18, "max_chance": 0.50, "jump_probability": 0.22, "first_pass": 0.78}
CHANCE_STEP, COOLDOWN, PENALTY = 0.018, 12, 1.0
GUARD_START, GUARD_BOUNDS = 0.85, (0.50, 0.98)
GUARD_BEATS = {"beats_before_end": 16, "look_ahead": 24, "search_depth": 3}


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def decision_options(rows: DataFrame) -> DataFrame:
    """The columns of CHANCES, chance_step, cooldown and repeat_penalty as a decision takes them.

    Chances are held to 0..1, one that is no finite number takes its default, as do a step, a cooldown or a
    penalty out of range; the least chance and the greatest change places if they are the wrong way round.
    """
    fixed = {x: F.when(_finite(F.col(x)), clamp(F.col(x), 0.0, 1.0)).otherwise(F.lit(default)) for x, default in CHANCES.items()}
    step, penalty = F.col("chance_step"), F.col("repeat_penalty")
    fixed |= {
        "chance_step": F.when(_finite(step) & (step >= 0), step).otherwise(F.lit(CHANCE_STEP)), "cooldown": F.when(F.col("cooldown") >= 0, F.col("cooldown")).otherwise(F.lit(COOLDOWN)),
        "repeat_penalty": F.when(_finite(penalty) & penalty.between(0, 1), penalty).otherwise(F.lit(PENALTY)),
    }
    low, high = fixed["min_chance"], fixed["max_chance"]
    return rows.withColumns(fixed | {"min_chance": F.least(low, high), "max_chance": F.greatest(low, high)})


def guard_options(rows: DataFrame) -> DataFrame:
    """guard_start and the columns of GUARD_BEATS as the escape guard takes them."""
    start = F.col("guard_start")
    beats = {x: F.when(F.col(x) >= 1, F.col(x)).otherwise(F.lit(default)) for x, default in GUARD_BEATS.items()}
    return rows.withColumns(beats | {"guard_start": F.when(_finite(start), clamp(start, *GUARD_BOUNDS)).otherwise(F.lit(GUARD_START))})
