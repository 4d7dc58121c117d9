"""Quality rules judged by host.

Each document is measured and fails or passes the base rules. Failures are summed by domain
(``source``), and each domain's failure rate is shrunk towards what all domains show: a beta
prior is fitted to the domains' rates by their mean and variance, and a domain of n documents
and f failures gets (f + a) / (n + a + b). A domain is bad if that is over what the prior lets
expect of a domain, mean + DEVIATIONS of its standard deviations, or over MAX_RATE where that
is less. A bad domain takes its passing documents with it, for what passes there by luck is
of the same make. Where domains differ by no more than chance, none is bad.

Defined results: a null or empty text has no words and fails; a null domain is a domain of
its own; repeated rows count each. With one domain, or rates that don't vary, the prior is
mean * PRIOR_ROWS failures of PRIOR_ROWS. An empty table gives an empty result.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_RATE = 0.8
#: How far above the prior's mean, in its standard deviations, a domain is an outlier.
DEVIATIONS = 3.0
#: Weight of the prior in documents: fitted, but between these.
PRIOR_ROWS, MAX_PRIOR_ROWS = 2.0, 1000.0
SPACES = "\t\n\v\f\r "
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three consecutive words that occurs twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, at, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    often = counts[at] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(often) + k] |= often
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return (0, 0, 0, 0, 0)
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source and the five measures of every whole text."""

    def run(batches):
        for batch in batches:
            found = np.array([measure(x) for x in batch.column(2).to_pylist()], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, found.T)], names=["doc_id", "source", *MEASURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "source", "text").mapInArrow(run, f"doc_id {kind}, source string, " + ", ".join(f"{m} long" for m in MEASURES))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(rows: DataFrame, max_rate: float = MAX_RATE, deviations: float = DEVIATIONS) -> DataFrame:
    """source, host_docs, host_failed, host_rate, host_limit, host_bad of ``rows`` (source, base_failed)."""
    hosts = written(rows.groupBy("source").agg(F.count("*").alias("host_docs"), F.count_if("base_failed").alias("host_failed")), "host-sums")
    rate = F.col("host_failed") / F.col("host_docs")
    m, v, inverse = hosts.agg(F.avg(rate), F.coalesce(F.var_samp(rate), F.lit(0.0)), F.avg(1 / F.col("host_docs"))).first()
    a, weight = beta_prior(m or 0.0, v, inverse or 0.0)
    shrunk = F.round((F.col("host_failed") + a) / (F.col("host_docs") + weight), 9)
    limit = round(min(max_rate, (m or 0.0) + deviations * beta_deviation(a, weight)), 9)
    return hosts.select("source", "host_docs", "host_failed", shrunk.alias("host_rate"), F.lit(limit).alias("host_limit"), (shrunk > limit).alias("host_bad"))


def beta_prior(mean: float, variance: float, inverse: float) -> tuple[float, float]:
    """(a, a + b) of the beta prior of domains whose rates have this mean and variance.

    The variance of drawing n documents, mean (1 - mean) / n, is taken off first;
    ``inverse`` is the mean of 1 / n.
    """
    own = mean * (1 - mean)
    between = variance - own * inverse
    weight = own / between - 1 if between > 0 else MAX_PRIOR_ROWS
    weight = PRIOR_ROWS if variance <= 0 else min(max(weight, PRIOR_ROWS), MAX_PRIOR_ROWS)
    return mean * weight, weight


def beta_deviation(a: float, weight: float) -> float:
    """The standard deviation of the beta distribution of a and a + b = weight."""
    mean = a / weight
    return sqrt(mean * (1 - mean) / (weight + 1))


def judged(docs: DataFrame, max_rate: float = MAX_RATE, deviations: float = DEVIATIONS) -> DataFrame:
    """One row per document: doc_id, source, the measures, base_failed, host_rate, host_limit, kept."""
    rows = written(measured(docs).withColumn("base_failed", base_failed()), "measured")
    hosts = written(host_verdicts(rows, max_rate, deviations), "hosts").withColumnRenamed("source", "_source")
    joined = rows.join(hosts, rows["source"].eqNullSafe(hosts["_source"]))
    return joined.select("doc_id", "source", *MEASURES, "base_failed", "host_rate", "host_limit", (~F.col("base_failed") & ~F.col("host_bad")).alias("kept"))
