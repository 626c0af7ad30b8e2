"""Language identification by multilingual mixture inference (operator 8).

Training counts hashed letter trigrams per language. A document's trigrams are taken as drawn from a mixture of languages:
expectation-maximisation estimates the proportions, and the set of languages is chosen by penalised likelihood, from the
largest proportion on. The prediction is the language of the largest proportion in that set, and the score is that proportion.

Training reads only text and language of the rows given, about `per_lang` rows of each language (a hash of the id decides
which), or all if fewer. A null text or one without letters is `und` with score 0, as is every text if nothing was learned.
Ties go to the language that sorts first. Repeated rows get equal results, an empty table an empty one; other columns are
ignored by the operator, whatever their names. Texts of any length are read whole. Every language that occurs is learned; a model
takes BUCKETS numbers a language (128 kB), on the driver and on each executor, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, uniform

BUCKETS = 1 << 14
#: What an added language must gain, in log-likelihood per log of the number of trigrams.
PENALTY = 6.0
#: Which of all code points are letters; surrogates are none.
_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(text: str) -> np.ndarray:
    """Buckets of a text's trigrams, over lower-cased letters with every other stretch as one space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _LETTER[c]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate(([32], np.where(letter, c, 32)[keep], [32])).astype(np.uint32)
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(18)).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    probs: np.ndarray  # bucket by language

    def mixture(self, text: str | None, rounds: int = 12) -> tuple[str, float, dict[str, float]]:
        """The language, its proportion, and the proportions of the chosen set."""
        grams = trigrams(text) if text else np.zeros(0, dtype=np.int64)
        if not len(grams) or not self.langs:
            return "und", 0.0, {}
        seen, counts = np.unique(grams, return_counts=True)
        p, counts, n = self.probs[seen], counts.astype(np.float64), len(grams)

        def fit(p: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
            for _ in range(rounds):
                share = share * ((counts / (p @ share)) @ p) / n
            return share, float(counts @ np.log(p @ share))

        k = len(self.langs)
        share, _ = fit(p, np.full(k, 1.0 / k))
        order = np.argsort(-share, kind="stable")
        best = None
        for size in range(1, k + 1):
            at = order[:size]
            own, like = fit(p[:, at], share[at] / share[at].sum()) if size > 1 else (np.ones(1), float(counts @ np.log(p[:, at[0]])))
            like -= PENALTY * (size - 1) * np.log(n + 1.0)
            if best is not None and like <= best[0]:
                break
            best = (like, at, own)
        _, at, own = best
        top = int(at[np.argmax(own)])
        return self.langs[top], float(min(1.0, own.max())), {self.langs[i]: float(x) for i, x in zip(at, own)}


def train(rows: DataFrame, *, per_lang: int = 2000, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts trigrams of about `per_lang` rows of each language; what comes to the driver is at most BUCKETS numbers a language."""
    known = rows.select(rows[id_col].alias("id"), rows[text_col].cast("string").alias("text"), rows[lang_col].cast("string").alias("lang")).where("text is not null and lang is not null")
    # a row a language, so that no text is shuffled by its language
    per = F.broadcast(known.groupBy("lang").agg((F.lit(float(per_lang)) / F.count("*")).alias("share")))
    picked = known.join(per, "lang").where(uniform(F.col("id"), seed) < F.col("share")).select("lang", "text")

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        total: dict[str, np.ndarray] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            total[lang] = total.get(lang, 0) + np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        langs = [lang for lang, x in total.items() for _ in range(np.count_nonzero(x))]
        at = [np.flatnonzero(x) for x in total.values()]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(at) if at else np.zeros(0, np.int64)), pa.array(np.concatenate([x[i] for x, i in zip(total.values(), at)]) if at else np.zeros(0, np.int64))], ["lang", "bucket", "n"])

    counts = map_rows(picked, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in counts})
    table = np.full((BUCKETS, len(langs)), 0.5)
    place = {lang: i for i, lang in enumerate(langs)}
    for r in counts:
        table[r.bucket, place[r.lang]] += r.n
    return Model(langs, table / table.sum(axis=0, keepdims=True) if langs else table)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, langs (the chosen set with proportions)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language, whatever the input

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [shared.value.mixture(x.as_py()) for x in b.column(1)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([sorted(r[2].items()) for r in rows], pa.map_(pa.string(), pa.float64()))], ["id", "lang_pred", "score", "langs"])

    return map_rows(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")), run, "id long, lang_pred string, score double, langs map<string,double>").withColumnRenamed("id", id_col)


def filter_documents(docs: DataFrame, model: Model, *, text_col: str = "text", lang_col: str = "lang", least: float = 0.0) -> DataFrame:
    """The documents, all columns, that have a language of at least that score; `lang` becomes the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [shared.value.mixture(x.as_py()) for x in b.column(place)]
        keep = pa.array([r[0] != "und" and r[1] >= least for r in got], pa.bool_())
        cols = list(b.columns)
        cols[lang_at] = pa.array([r[0] for r in got], pa.string())
        return pa.RecordBatch.from_arrays(cols, b.schema.names).filter(keep)

    return map_rows(docs.withColumn(lang_col, F.col(lang_col).cast("string")).select(*docs.columns), run, docs.withColumn(lang_col, F.col(lang_col).cast("string")).select(*docs.columns).schema)


def held_out(id_col):
    """Rows kept from training: those whose crc32 of the id as text is a multiple of 5."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0
