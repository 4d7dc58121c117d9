"""Audio files as rows: what a file is, and the samples of WAV files in blocks."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.operators.resample import resampled

EXTENSIONS = ["wav", "mp3", "m4a", "aac", "mp4"]
MOST_SECONDS = 1_800
BLOCK = 65_536
#: What an input may be, and why it isn't one, in the order in which it is asked.
INPUTS = ["mp3", "wav", "m4a", "aac"]
INVALID, DENIED, UNREADABLE = "input_invalid", "input_access_denied", "input_locked_or_unreadable"
INPUT_ERRORS = {
    INVALID: "Choose an audio file before starting analysis.",
    "unsupported_audio_format": "Choose an MP3, WAV, M4A or AAC file.",
    "input_not_found": "Track file was not found.",
    "input_empty_file": "The selected file is empty.",
    DENIED: "This file could not be accessed.",
    UNREADABLE: "This file could not be read.",
}


def format_of(content: Column, extension: Column) -> Column:
    """wav, mp3, m4a, mp4 or aac by the first bytes, else by the extension, else null."""
    head = F.hex(F.substring(content, 1, 12))
    at = lambda start, n: F.substring(head, 2 * start + 1, 2 * n)
    text = lambda x: x.encode().hex().upper()
    found = F.when((at(0, 4) == text("RIFF")) & (at(8, 4) == text("WAVE")), "wav").when(at(0, 3) == text("ID3"), "mp3")
    found = found.when((at(4, 4) == text("ftyp")) & at(8, 3).isin(text("M4A"), text("M4B")), "m4a").when(at(4, 4) == text("ftyp"), "mp4")
    found = found.when(head.rlike("^FFF[0189]"), "aac").when(head.rlike("^FF[EF]"), "mp3")
    return F.coalesce(found, F.when(extension.isin(EXTENSIONS), extension))


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, format, supported, sha256 and content of the files under ``path``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    kind = format_of(F.col("content"), extension)
    return rows.select("path", kind.alias("format"), (kind.isNotNull() & extension.isin(EXTENSIONS)).alias("supported"), F.sha2("content", 256).alias("sha256"), "content")


def probed(inputs: DataFrame) -> DataFrame:
    """path, size, modified and failure of the distinct paths of ``inputs``; a path where no file is has no row.

    Each path is asked for in a task, on any file system that Arrow opens, and one byte is read; ``failure`` is the
    code of why it can't be. A listing of Spark's file source wouldn't do: it leaves out empty files.
    """

    def probe(path: str):
        try:
            system, place = fs.FileSystem.from_uri(path)
            found = system.get_file_info(place)
            if found.type != fs.FileType.File:
                return None
            with system.open_input_file(place) as file:
                file.read(1)
        except PermissionError:
            return path, None, None, DENIED
        except OSError:
            return path, None, None, UNREADABLE
        except (ValueError, pa.ArrowException):
            return path, None, None, INVALID
        return path, found.size, found.mtime, None

    def run(batches):
        for batch in batches:
            rows = [row for row in map(probe, batch["path"]) if row]
            out = pd.DataFrame(rows, columns=["path", "size", "modified", "failure"])
            yield out.astype({"size": "Int64"}).assign(modified=pd.to_datetime(out["modified"], utc=True))

    paths = inputs.where("path IS NOT NULL AND trim(path) <> ''").select("path").distinct()
    return paths.mapInPandas(run, "path string, size long, modified timestamp, failure string")


def identities(spark: SparkSession, path: str) -> DataFrame:
    """path, size, modified and sha256 (of the content) of the files under ``path``: what tells one
    input from another. Spark leaves out empty files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def checked_inputs(inputs: DataFrame, found: DataFrame) -> DataFrame:
    """``inputs``, which have path, with code and message of the first check that fails, else null.

    A blank or null path, another extension (in any case), a path that isn't in ``found``, an empty file, one that can't
    be opened. ``found`` has path, size and failure, as ``probed`` gives. Equal paths may come more than once on
    both sides; of those found twice the larger size counts.
    """
    extension = F.lower(F.regexp_extract("path", r"\.([^./\\]*)$", 1))
    sizes = found.groupBy(F.col("path").alias("_path")).agg(F.max("size").alias("_size"), F.max("failure").alias("_failure"))
    _, unsupported, missing, empty, *_ = INPUT_ERRORS
    code = F.when(F.trim(F.coalesce("path", F.lit(""))) == "", INVALID).when(~extension.isin(INPUTS), unsupported).when(F.col("_path").isNull(), missing)
    rows = inputs.join(sizes, F.col("path") == F.col("_path"), "left").withColumn("code", code.when(F.col("_size") == 0, empty).otherwise(F.col("_failure")))
    message = [F.when(F.col("code") == name, F.lit(text)) for name, text in INPUT_ERRORS.items()]
    return rows.withColumn("message", F.coalesce(*message)).drop("_path", "_size", "_failure")


def wav_blocks(rows: DataFrame) -> DataFrame:
    """path, rate, first, samples, error of ``files`` of 16-bit WAV: channels averaged to -1..1, a
    row for each block of samples from ``first`` on. A file that can't be read, or of over
    30 minutes, is one row with ``error``. The rate stays the file's own; ``samples`` changes it."""

    def decode(path: str, content: bytes):
        try:
            with wave.open(io.BytesIO(content)) as w:
                rate, n, channels = w.getframerate(), w.getnframes(), w.getnchannels()
                if w.getsampwidth() != 2 or n > MOST_SECONDS * rate:
                    raise ValueError("not 16-bit" if w.getsampwidth() != 2 else "over 30 minutes")
                for first in range(0, n, BLOCK):
                    data = np.frombuffer(w.readframes(BLOCK), "<i2").reshape(-1, channels)
                    yield path, rate, first, (data.mean(axis=1) / 32_768).tolist(), None
        except (wave.Error, EOFError, ValueError) as e:
            yield path, None, None, None, str(e) or type(e).__name__

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for row in decode(path, content):
                    yield pd.DataFrame([row], columns=["path", "rate", "first", "samples", "error"])

    return rows.select("path", "content").mapInPandas(run, "path string, rate int, first long, samples array<double>, error string")


def samples(blocks: DataFrame, target: int | None = None) -> DataFrame:
    """(path, which, x): the rows that frames are cut from, at ``target`` samples a second if given."""
    rows = blocks.where("error IS NULL").select("path", "rate", "first", F.posexplode("samples").alias("_i", "x")).select("path", "rate", (F.col("first") + F.col("_i")).alias("which"), "x")
    return rows.drop("rate") if target is None else resampled(rows, "path", "which", "x", "rate", target)
