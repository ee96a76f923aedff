"""Quality of documents: classifier evidence shrunk through hierarchical empirical Bayes of sites.

Evidence is the log odds of a logistic regression on shape features of the whole
text, fitted to a bounded sample of labelled rows. Sites have two levels, host
and path. Each level's posterior is a beta mean over all of its documents'
probabilities; its strength comes from the spread between sites by the method of
moments, so sparse paths shrink to their host and sparse hosts to the corpus.
The verdict adds the log odds of the path's other documents, relative to the corpus, to the document's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .passages import word_tokens
from .shared import Scratch, texts_of, unused

#: At most so many labelled rows are fitted; the only sample here.
FIT_ROWS = 20_000
#: A document is kept if its posterior is at least this.
THRESHOLD = 0.5
PIECE = 1 << 20

_KIND = np.zeros(256, np.uint8)
for _i, _set in enumerate((b"#$%&*@^~`_=+", b"|<>[]{}/\\", b"!?", b".,;:", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)) + bytes(range(128, 256)), b"\n"), 1):
    _KIND[list(_set)] = _i
FEATURES = ["symbols", "bars", "shouts", "stops", "digits", "capitals", "small", "lines", "log_words", "word_bytes", "same_as_last", "same_as_last_but_one", "long_words"]


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of features for each text."""
    n = len(at) - 1
    size = np.maximum(np.diff(at), 1)[:, None]
    out = np.zeros((n, len(FEATURES)))
    kind = _KIND[raw]
    for k in range(1, 9):
        total = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        out[:, k - 1] = total[at[1:]] - total[at[:-1]]
    out[:, :8] /= size
    word, first, last, bounds = word_tokens(raw.tobytes(), at)
    words = np.diff(bounds)
    every = np.maximum(words, 1)
    doc = np.repeat(np.arange(n), words)
    out[:, 8] = np.log1p(words)
    length = (last - first).astype(float)
    out[:, 9] = np.bincount(doc, length, n) / every
    for column, lag in ((10, 1), (11, 2)):
        same = np.zeros(len(word))
        same[lag:] = (word[lag:] == word[:-lag]) & (doc[lag:] == doc[:-lag])
        out[:, column] = np.bincount(doc, same, n) / every
    out[:, 12] = np.bincount(doc, length > 14, n) / every
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(_wide((x - self.mean) / self.scale) @ self.weights + self.bias, -30, 30) if len(x) else np.zeros(0)


def _wide(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.concatenate([z, np.abs(z)], axis=1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Model:
    """Logistic regression by Newton's method. Without both classes the evidence is 0."""
    k = len(FEATURES)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(k), np.ones(k), np.zeros(2 * k), 0.0)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.concatenate([_wide((x - mean) / scale), np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w[:-1], float(w[-1]))


def _sliced(batch: pa.RecordBatch, column: int):
    """(first row, raw, offsets) in pieces of bounded bytes; a longer text is a piece of its own."""
    raw, at = texts_of(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = min(max(int(np.searchsorted(at, at[a] + PIECE)), a + 1), batch.num_rows)
        yield raw[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b


def _site(column: str | None) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) if column else F.lit("")


def _measured(docs: DataFrame, host: str | None, path: str | None) -> DataFrame:
    def run(it):
        for batch in it:
            if batch.num_rows:
                x = np.concatenate([features(*piece) for piece in _sliced(batch, 3)])
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["doc_id", "host", "path", "x"])

    picked = docs.select(F.col("doc_id").cast("long"), _site(host).alias("host"), _site(path).alias("path"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, host string, path string, x array<double>")


def _strength(mean: Column, between: Column) -> Column:
    """Pseudo-count of a beta prior with this mean and variance."""
    return F.when(between > 1e-9, F.greatest(mean * (1 - mean) / between - 1, F.lit(1.0))).otherwise(F.lit(1e6))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, host_posterior, path_posterior, prior, path_weight) from all rows of (host, path, p).

    path_weight: the documents of the path and the pseudo-count of its prior, of which path_posterior is the mean.
    """
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    whole = hosts.agg(
        (F.sum("hs") / F.sum("hn")).alias("prior"),
        F.sum("hn").alias("docs"),
        F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("squares"),
        F.count("*").alias("sites"),
    )
    # method of moments: between-site variance above what the sites' sizes explain
    between = (F.col("squares") - F.col("docs") * F.col("prior") * F.col("prior") - (F.col("sites") - 1) * F.col("prior") * (1 - F.col("prior"))) / F.col("docs")
    whole = whole.select("prior", _strength(F.col("prior"), between).alias("host_strength"))
    hosts = hosts.crossJoin(F.broadcast(whole)).withColumn("host_posterior", (F.col("hs") + F.col("host_strength") * F.col("prior")) / (F.col("hn") + F.col("host_strength")))
    nested = paths.join(hosts, "host")
    within = nested.agg(
        F.sum("n").alias("docs"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("hs") / F.col("hn"), 2) - F.col("hs") / F.col("hn") * (1 - F.col("hs") / F.col("hn"))).alias("excess"),
        F.first("prior").alias("p0"),
    ).select(_strength(F.col("p0"), F.col("excess") / F.col("docs")).alias("path_strength"))
    return nested.crossJoin(F.broadcast(within)).select(
        "host",
        "path",
        "host_posterior",
        ((F.col("s") + F.col("path_strength") * F.col("host_posterior")) / (F.col("n") + F.col("path_strength"))).alias("path_posterior"),
        "prior",
        (F.col("n") + F.col("path_strength")).alias("path_weight"),
    )


def _log_odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(q / (1 - q))


def _sample(measured: DataFrame, known: DataFrame, fit_rows: int) -> list:
    """At most about fit_rows labelled rows: those whose id's hash is under a bound worked out from the number of labels.

    The bound holds before the join, so a task sends what falls under it and no more, whatever the size of the table.
    """
    n = known.count()
    share = min(1.0, fit_rows / max(n, 1))
    under = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40))
    picked = measured.where(under).select("doc_id", "x").join(known.where(under), "doc_id")
    # rows that share an id count once, so that repeated ids cannot swell the sample
    found = picked.groupBy("doc_id").agg(F.min("x").alias("x"), F.first("quality").alias("quality")).collect()
    return sorted(found, key=lambda r: r.doc_id)


def classify(docs: DataFrame, labels: DataFrame, host: str | None = "source", path: str | None = "lang", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, host, path, evidence, host_posterior, path_posterior, posterior, keep) for each row of docs.

    labels: (doc_id, quality 0/1); null labels and ids are ignored, the mean counts where a
    document has several. Null host, path or text: the empty string. Without
    labels of both classes the evidence is 0, and every document is kept. An
    empty table gives no row.
    """
    scratch = Scratch(docs.sparkSession)
    measured = scratch.table(_measured(docs, host, path), "measured")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("quality"))
    sample = _sample(measured, known, fit_rows)
    model = fit(np.array([r.x for r in sample], float).reshape(len(sample), len(FEATURES)), np.array([float(r.quality >= 0.5) for r in sample]))

    def score(it):
        for batch in it:
            if batch.num_rows:
                x = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
                z = model.log_odds(x)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(z), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "host", "path", "evidence", "p"])

    scored = scratch.table(measured.mapInArrow(score, "doc_id long, host string, path string, evidence double, p double"), "scored")
    scratch.keep_only("scored")
    sites = site_posteriors(scored)
    # a document's own probability is in its evidence, so its path counts without it
    others = (F.col("path_posterior") * F.col("path_weight") - F.col("p")) / (F.col("path_weight") - 1)
    total = F.col("evidence") + _log_odds(others) - _log_odds(F.col("prior"))
    posterior = 1 / (1 + F.exp(-total))
    return scored.join(sites, ["host", "path"]).select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", posterior.alias("posterior"), (posterior >= threshold).alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, host: str | None = "source", path: str | None = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that the classifier keeps. Rows that share an id are kept if one is kept; rows with a null id are kept."""
    verdict = classify(docs, labels, host, path, threshold)
    own = unused(docs, "rejected")
    rejected = verdict.groupBy("doc_id").agg(F.max("keep").alias("kept")).where("not kept").select(F.col("doc_id").alias(own))
    return docs.join(rejected, docs["doc_id"] == rejected[own], "left_anti")
