"""Quality classifier with hierarchical empirical Bayes over hosts and their paths.

A document's own evidence is a logistic model over style features, fitted here on a bounded sample of labelled rows.
Hosts and paths get posterior means by grouped aggregation: a host is shrunk towards the corpus's mean and a path
towards its host, each by a strength that the spread between groups gives (method of moments), so sparse sites keep
close to their prior.  The verdict adds the path's log-odds, relative to the corpus's, to the document's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

UPPER, DIGITS, SYMBOLS, MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>", "!?"


def features(text: Column) -> dict[str, Column]:
    """Style features of a whole text, each about 0 to 3; those of an empty text are all 0."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words, lines = F.split(text, "[ \\n\\t\\r]+"), F.split(text, "\\n")
    share = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / n
    count = F.size(words).cast("double")
    return {
        "upper": share(UPPER) * 3,
        "digits": share(DIGITS) * 10,
        "symbols": share(SYMBOLS) * 10,
        "marks": share(MARKS) * 10,
        "repeats": 1 - F.size(F.array_distinct(words)) / count,
        "same_lines": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
        "word_length": F.least(n / count / 10, F.lit(3.0)),
        "size": F.log1p(count) / 5,
    }


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def logit(self, text: Column) -> Column:
        out = F.lit(float(self.bias))
        for name, col in features(text).items():
            out = out + col * float(self.weights[name])
        return F.greatest(F.least(out, F.lit(12.0)), F.lit(-12.0))


def fit(docs: DataFrame, labels: DataFrame, documents: int = 20_000, ridge: float = 1.0) -> Model | None:
    """A logistic model by Newton's method from at most ``documents`` labelled documents, lowest doc_id hashes first.

    Both labels are weighted alike.  None where the sample lacks one of them.  Equal doc_ids with different labels and
    null labels are left out.
    """
    ids = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    ids = ids.where("low = high").select("doc_id", F.col("low").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    names = list(features(F.lit("")))
    rows = rows.select("doc_id", "label", *[c.alias(k) for k, c in features(F.col("text")).items()]).orderBy("doc_id", *names).toPandas()
    y = (rows["label"].to_numpy(float) > 0).astype(float)
    if not 0 < y.sum() < len(y):
        return None
    x = np.column_stack([rows[names].to_numpy(float), np.ones(len(y))])
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    keep = np.diag([ridge] * len(names) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, x.T @ (weight * (y - p)) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(dict(zip(names, w[:-1])), w[-1])


def _strength(groups: DataFrame, mean: str, prior: Column) -> float:
    """Pseudo-counts of the prior over ``groups(n, mean, var)``: what the spread of means beyond chance leaves.

    Between 2 (groups differ as much as they can) and 1000 (no more than chance, or a single group).
    """
    row = groups.agg(F.sum(F.col("n") * F.pow(F.col(mean) - prior, 2)).alias("seen"), F.sum("var").alias("chance"), F.sum("n").alias("n"), F.sum(F.col("n") * prior * (1 - prior)).alias("most")).first()
    if not row["n"]:
        return 1000.0
    between = max(row["seen"] - row["chance"], 0.0) / row["n"]
    return float(min(1000.0, max(2.0, (row["most"] / row["n"]) / between - 1 if between > 0 else 1000.0)))


def posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """``(host, path, prior)`` of every path, prior its posterior mean; and the corpus's mean.

    ``scored(host, path, p)`` has a row per document.  Sums are combined before the shuffle, so a host with a large share
    of the rows costs no more than another.
    """
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.coalesce(F.var_pop("p"), F.lit(0.0)).alias("var")), "paths")
    row = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = (row["s"] or 0.0) / row["n"] if row["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.avg("var").alias("var")).withColumn("m", F.col("s") / F.col("n"))
    k = _strength(hosts, "m", F.lit(float(mean)))
    hosts = written(hosts.select("host", ((F.col("s") + k * mean) / (F.col("n") + k)).alias("host_mean")), "hosts")
    both = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.*", "host_mean").withColumn("m", F.col("s") / F.col("n"))
    k = _strength(both, "m", F.col("host_mean"))
    return both.select("host", "path", ((F.col("s") + k * F.col("host_mean")) / (F.col("n") + k)).alias("prior")), mean


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, documents: int = 20_000, threshold: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct ``tidemark_quality(evidence, prior, posterior, kept)`` for every row.

    Host is ``source``, path is ``source`` with ``lang``; null ones are groups of their own.  Without labels of both
    kinds there is no evidence: posteriors are 0.5 and all rows are kept.  A null or empty text has only its length's
    evidence.  Repeated rows count as often as they occur and get equal verdicts.  ``columns`` names those of ``docs``
    that are wanted (all by default); texts are read once, and the wanted columns are written with their evidence.
    """
    model = fit(docs, labels, documents)
    evidence = model.logit(F.col("text")) if model else F.lit(0.0)
    columns = docs.columns if columns is None else columns
    inner = {"tidemark_host": F.col("source").cast("string"), "tidemark_path": F.col("lang").cast("string"), "tidemark_evidence": evidence}
    rows = written(docs.select(*[F.col(f"`{c}`") for c in columns], *[c.alias(k) for k, c in inner.items()]), "evidence")
    scored = rows.select(F.col("tidemark_host").alias("host"), F.col("tidemark_path").alias("path"), (1 / (1 + F.exp(-F.col("tidemark_evidence")))).alias("p"))
    priors, mean = posteriors(scored)
    priors = written(priors, "priors").alias("q")
    match = F.col("d.tidemark_host").eqNullSafe(F.col("q.host")) & F.col("d.tidemark_path").eqNullSafe(F.col("q.path"))
    total = F.col("d.tidemark_evidence") + _logit(F.col("q.prior")) - _logit(F.lit(float(mean)))
    posterior = 1 / (1 + F.exp(-total))
    verdict = F.struct(F.col("d.tidemark_evidence").alias("evidence"), F.col("q.prior").alias("prior"), posterior.alias("posterior"), (posterior >= threshold).alias("kept"))
    return rows.alias("d").join(priors, match, "left").select(*[F.col(f"d.`{c}`") for c in columns], verdict.alias("tidemark_quality"))
