"""Contracts of JSON documents, compiled to one column expression.

A contract is plain data: NUMBER is a finite number, {name: contract} an object with these fields
(others are free), [contract] an array whose elements all keep one. ``violations`` turns it into an expression on
a parsed document, so a check is one pass over the rows without a parser of its own, and gives
every violation of a document with its path, not only the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = "number"
#: The contract of an analysis (fixed values).
QUANTUM = {"start": NUMBER, "duration": NUMBER, "confidence": NUMBER}
SEGMENT = {**QUANTUM, "loudness_start": NUMBER, "loudness_max": NUMBER, "loudness_max_time": NUMBER, "pitches": [NUMBER], "timbre": [NUMBER]}
ANALYSIS = {"info": {}, "audio_summary": {"duration": NUMBER}, "analysis": {"sections": [QUANTUM], "bars": [QUANTUM], "beats": [QUANTUM], "tatums": [QUANTUM], "segments": [SEGMENT]}}
ROOT = "Analysis root"
EXPECTED = {"object": "must be an object.", "array": "must be an array.", "number": "must be a finite number."}
VIOLATION = "array<struct<path:string,place:int,message:string>>"


def _broken(path: Column, place: Column, kind: str) -> Column:
    return F.array(F.struct(path.alias("path"), place.cast("int").alias("place"), F.concat(path, F.lit(" " + EXPECTED[kind])).alias("message"))).cast(VIOLATION)


def _none() -> Column:
    return F.array().cast(VIOLATION)


def compiled(contract, node: Column, path: Column, place: Column, root: bool = False) -> Column:
    """The violations of ``contract`` in ``node`` (a variant, null where it is missing) as an array of
    path, place (of the nearest array element above, else null) and message."""
    if contract == NUMBER:
        number = F.try_variant_get(node, "$", "double")
        kind = F.schema_of_variant(node)
        fine = ((kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL")) & (F.abs(number) < float("inf"))
        return F.when(F.coalesce(fine, F.lit(False)), _none()).otherwise(_broken(path, place, "number"))
    if isinstance(contract, list):
        held = F.try_variant_get(node, "$", "array<variant>")
        inner = F.flatten(F.transform(held, lambda x, i: compiled(contract[0], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), i)))
        return F.when(held.isNull(), _broken(path, place, "array")).otherwise(inner)
    own = F.try_variant_get(node, "$", "map<string,variant>")
    below = lambda name: F.lit(name) if root else F.concat(path, F.lit("." + name))
    fields = [compiled(c, F.try_element_at(own, F.lit(name)), below(name), place) for name, c in contract.items()]
    return F.when(own.isNull(), _broken(path, place, "object")).otherwise(F.concat(*fields) if fields else _none())


def violations(df: DataFrame, document: str, contract=ANALYSIS, out: str = "violations") -> DataFrame:
    """Adds the array ``out`` of all violations in the JSON text ``document``.

    A null or unreadable document breaks the contract at its root; an empty array has no bad elements.
    """
    parsed = F.try_parse_json(F.col(document))
    return df.withColumn(out, compiled(contract, parsed, F.lit(ROOT), F.lit(None), True))


def violation_rows(df: DataFrame, key: str, document: str, contract=ANALYSIS) -> DataFrame:
    """key, path, place, message: a row per violation."""
    return violations(df.select(key, document), document, contract).select(key, F.inline("violations"))
