"""Quality classifier by hierarchical empirical Bayes (operator 4).

A logistic model of a text's style and of its words and word pairs, hashed to `GRAMS` signed buckets, gives each document its
own evidence. Grouped aggregation then gives each host, and each
path within a host, a posterior mean of that evidence: a host is shrunk toward the global mean and a path toward its host,
each by a prior strength that the method of moments takes from the spread between groups, so sparse sites stay near their
prior. A document's own evidence is left out of its path's sums and of its host's, which are its path's prior. The final log-odds are the document's own plus the log-odds
of its path's posterior against the global mean.

The logistic model is fitted on about `fit_rows` labelled rows (a hash of the id decides which), or all if fewer; without
labels of both kinds every document's own evidence is the prior 0.5. A null or empty text is of no quality evidence: its own
probability is 0 and it has no share in its site; a path of such texts only has no means. A null host or path is "(none)". Rows that repeat a label count each time, and
so do repeated documents. A probability equal to the threshold is kept. Texts of any length are read whole. An empty table gives
an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii, map_rows, uniform
from .words import mix, word_hashes

_SYMBOLS = re.compile(r"[#$%&*|<>{}\\^~=_+@\[\]]").findall
_UPPER = re.compile(r"\b[^\W\d_a-z]{2,}\b").findall
_STOPS = re.compile(r"[.!?]").findall


GRAMS = 256


def grams(text: str) -> list[float]:
    """Words and pairs of words of a text in signed buckets, over four times the root of their number."""
    w = word_hashes(lower_ascii(text))[1]
    if not len(w):
        return [0.0] * GRAMS
    h = np.concatenate([w, mix(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:], 0xD6E8FEB86659FD93)])
    sign = np.where((h >> np.uint64(55)) & np.uint64(1), 0.25, -0.25)
    return (np.bincount((h >> np.uint64(56)).astype(np.int64), weights=sign, minlength=GRAMS) / np.sqrt(len(h))).tolist()


def features(text: str | None) -> list[float]:
    """A text's style (shares of symbols, capitals, digits, marks, repeats, and lengths on a log scale) and its words."""
    t = text or ""
    n = max(1, len(t))
    words = t.split()
    w = max(1, len(words))
    lines = [x for x in t.split("\n") if x.strip()]
    stops = len(_STOPS(t))
    return [
        min(1.0, 20 * len(_SYMBOLS(t)) / n),
        min(1.0, 20 * t.count("|") / n),
        len(_UPPER(t)) / w,
        min(1.0, 10 * sum(t.count(d) for d in "0123456789") / n),
        min(1.0, 20 * t.count("!") / n),
        min(1.0, 10 * t.count(".") / w),
        min(1.0, 10 * t.count(",") / w),
        np.log1p(len(words)) / 10,
        np.log1p(n / w) / 4,
        np.log1p(w / max(1, stops)) / 6,
        1 - len(set(words)) / w,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, 10 * len(lines) / w),
        *grams(t),
    ]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic weights, the intercept last, by Newton steps with a ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _features(docs: DataFrame) -> DataFrame:
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([features(x.as_py()) for x in b.column(1)], pa.list_(pa.float64()))], ["id", "x"])

    return map_rows(docs.select("id", "text"), run, "id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 4000, seed: int = 3) -> np.ndarray | None:
    """Logistic weights from about `fit_rows` labelled rows; docs (id, text), labels (id, label 0 or 1)."""
    known = labels.where("id is not null and label in (0, 1)")
    n = known.count()
    picked = known.where(uniform(F.col("id"), seed) < fit_rows / max(1, n))
    picked = picked.groupBy("id", "label").agg(F.count("*").alias("times"))
    rows = _features(docs.where("text is not null").join(F.broadcast(picked.select("id").distinct()), "id").select("id", "text"))  # about fit_rows ids
    rows = rows.join(picked, "id").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("times")))).select("x", "label").collect()
    if len({r.label for r in rows}) < 2:
        return None
    return fit(np.array([r.x for r in rows]), np.array([r.label for r in rows], dtype=np.float64))


def evidence(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """docs (id, host, path, text) to (id, host, path, p): each text's own probability of quality, null for an empty text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[float | None] = []
        for x in b.column(3):
            text = x.as_py()
            if not text or not text.strip():
                out.append(None)
            elif weights is None:
                out.append(0.5)
            else:
                z = float(np.dot(weights[:-1], features(text)) + weights[-1])
                out.append(float(1 / (1 + np.exp(-np.clip(z, -12, 12)))))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.float64())], ["id", "host", "path", "p"])

    return map_rows(docs.select("id", "host", "path", "text"), run, "id long, host string, path string, p double")


def _strength(groups: DataFrame, least: float = 1.0, most: float = 1000.0) -> Column:
    """Prior strength from groups (n, s, q, mean above as `mu`): mu(1-mu) over the between-group variance, less 1."""
    between = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("mu"), 2)) / F.sum("n")
    within = F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.sum("n")
    signal = between - within * F.count("*") / F.sum("n")
    spread = F.sum(F.col("n") * F.col("mu") * (1 - F.col("mu"))) / F.sum("n")
    return F.when(signal > 0, F.greatest(F.lit(least), F.least(F.lit(most), spread / signal - 1))).otherwise(F.lit(most))


def posteriors(own: DataFrame) -> DataFrame:
    """own (id, host, path, p) to (host, path, n, s, host_n, host_s, mu, host_mean, k_host, k_path): what a document's site needs to leave it out of all its sums."""
    sums = [F.count("p").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")]
    paths = cut(own.where("p is not null").groupBy("host", "path").agg(*sums))
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in "nsq"])
    total = hosts.agg((F.sum("s") / F.sum("n")).alias("mu"))
    hosts = cut(hosts.crossJoin(total))
    host_strength = hosts.agg(_strength(hosts).alias("k_host"))
    shrunk = hosts.crossJoin(host_strength).select("host", "mu", "k_host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), ((F.col("s") + F.col("k_host") * F.col("mu")) / (F.col("n") + F.col("k_host"))).alias("host_mean"))
    paths = cut(paths.join(shrunk, "host"))
    path_strength = paths.select("n", "s", "q", F.col("host_mean").alias("mu")).agg(_strength(paths).alias("k_path"))
    return paths.crossJoin(path_strength).select("host", "path", "n", "s", "host_n", "host_s", "mu", "host_mean", "k_host", "k_path")


def score(docs: DataFrame, labels: DataFrame, *, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, fit_rows: int = 4000) -> DataFrame:
    """One row a document: id, host, path, p_doc, host_mean, path_mean, p_quality, keep (p_quality at or over the threshold)."""
    plain = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[host_col], F.lit("(none)")).alias("host"), F.coalesce(docs[path_col], F.lit("(none)")).alias("path"), docs[text_col].cast("string").alias("text"))
    weights = train(plain, labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("label")), fit_rows=fit_rows)
    own = cut(evidence(plain, weights))
    odds = lambda c: F.log(c / (1 - c))
    clip = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(1e-5), F.least(F.lit(1 - 1e-5), c)))
    joined = own.join(posteriors(own), ["host", "path"], "left")
    mine, one = F.coalesce("p", F.lit(0.0)), F.col("p").isNotNull().cast("int")
    others = lambda total, n, k, prior: (F.col(total) - mine + F.col(k) * prior) / (F.col(n) - one + F.col(k))
    joined = joined.withColumn("host_mean", others("host_s", "host_n", "k_host", F.col("mu")))
    out = joined.withColumn("path_mean", clip(others("s", "n", "k_path", F.col("host_mean"))))
    z = odds(clip(F.col("p"))) + odds(F.col("path_mean")) - odds(clip(F.col("mu")))
    return out.withColumn("p_quality", F.when(F.col("p").isNull(), 0.0).otherwise(1 / (1 + F.exp(-z)))).select(F.col("id").alias(id_col), "host", "path", F.coalesce("p", F.lit(0.0)).alias("p_doc"), "host_mean", "path_mean", "p_quality", (F.col("p_quality") >= threshold).alias("keep"))
