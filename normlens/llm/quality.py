"""Quality classifier: document evidence combined with host and path posteriors.

Evidence: a logistic regression on surface statistics of the whole text
(character classes, word lengths, repetition), fitted by Newton steps on at
most ``max_train`` labelled rows, the ones of smallest id hash (the only
bounded sample; everything else covers all rows).

Sites: the evidence of all documents is averaged per host and per path of a
host by grouped sums.  A host's mean is shrunk toward the global mean and a
path's toward its host's, each by a strength estimated from how far the means
spread beyond chance (method of moments), so sparse sites fall back on what
lies above them.  A document is left out of its own sites' sums.  The result
adds the path posterior's log odds, relative to the global ones, to the
document's; ``site_weight`` scales that part.  Documents at ``threshold`` or
more are kept.

Defined cases: null and empty texts have the statistics of an empty text; null
hosts or paths form groups of their own; without labels, or with one class
only, every document has the prior and is kept; unlabelled rows are scored;
repeated rows score alike up to their sites; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.llm.common import byte_blocks, materialize
from normlens.llm.minhash_dedup import word_hashes, SPACE

FEATURES = ("upper", "digit", "symbol", "stop", "bar", "newline", "accent", "word_len", "long_word", "distinct",
            "echo", "echo_far", "log_words", "symbol_end")


def _class_mask(values) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(values)] = True
    return m


UPPER = _class_mask(range(0x41, 0x5B))
LOWER_ = _class_mask(range(0x61, 0x7B))
DIGIT = _class_mask(range(0x30, 0x3A))
STOP = _class_mask(b".,!?;:")
BAR = _class_mask(b"|")
HIGH = _class_mask(range(0x80, 0x100))
SYMBOL = ~(UPPER | LOWER_ | DIGIT | STOP | HIGH | SPACE) & _class_mask(range(0x21, 0x7F))


def _sums(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(mask)))
    return (c[off[1:]] - c[off[:-1]]).astype(np.float64)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Surface statistics of every text of a block: shape (texts, len(FEATURES))."""
    size = np.maximum(1.0, np.diff(off))
    words, count = word_hashes(data, off)
    n = np.maximum(1.0, count)
    end = np.concatenate(([0], np.cumsum(count)))
    space = SPACE[data]
    solid = np.maximum(1.0, _sums(~space, off))
    after = np.concatenate((space[1:], [True]))
    inside = off[1:][off[1:] > 0] - 1
    after[inside] = True
    echo = np.concatenate((words[1:] == words[:-1], [False])) if len(words) else np.zeros(0, bool)
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(end[:-1], end[1:])], dtype=np.float64)
    letters = np.maximum(1.0, _sums((UPPER | LOWER_)[data], off))
    share = lambda m, by: _sums(m[data], off) / by
    mean_len = solid / n
    return np.stack([
        share(UPPER, letters), share(DIGIT, solid), share(SYMBOL, solid), share(STOP, solid), share(BAR, n),
        _sums(data == 0x0A, off) / size * 100, share(HIGH, solid), np.minimum(mean_len, 40.0) / 10, (mean_len > 15) * 1.0,
        distinct / n, _sums(echo, end) / n, np.log1p(n) - np.log1p(distinct), np.log1p(count) / 10,
        _sums(SYMBOL[data] & after, off) / n], axis=1)


def _feature_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, data, off in byte_blocks(b, "text"):
            x = features(data, off)
            bounds = pa.array(np.arange(j - i + 1, dtype=np.int32) * x.shape[1])
            yield pa.record_batch([b.column("id").slice(i, j - i), b.column("host").slice(i, j - i),
                                   b.column("path").slice(i, j - i),
                                   pa.ListArray.from_arrays(bounds, pa.array(x.ravel()))], names=["id", "host", "path", "x"])


def expand(x: np.ndarray) -> np.ndarray:
    """Statistics and their squares."""
    return np.concatenate((x, x * x), axis=1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression on raw expanded statistics; the last one is the constant."""
    z = expand(x)
    mean, sd = z.mean(axis=0), z.std(axis=0)
    sd[sd < 1e-9] = 1.0
    z = np.concatenate(((z - mean) / sd, np.ones((len(z), 1))), axis=1)
    w = np.zeros(z.shape[1])
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    pull = np.full(len(w), ridge)
    pull[-1] = 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (y - p) - pull * w
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(pull)
        step = np.linalg.solve(h, g)
        w += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    raw = w[:-1] / sd
    return np.concatenate((raw, [w[-1] - (raw * mean).sum()]))


def _score_task(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("x").values).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, len(FEATURES)))
            logit = np.clip(expand(x) @ w[:-1] + w[-1], -12, 12)
            yield pa.record_batch([b.column("id"), b.column("host"), b.column("path"), pa.array(1 / (1 + np.exp(-logit)))],
                                  names=["id", "host", "path", "p"])
    return run


def _strength(groups: DataFrame) -> float:
    """Prior strength in documents, from (n, s, q): count, sum and sum of squares of each group.

    Between-group variance is what the spread of means exceeds their sampling
    variance by; strength is within-group variance over it.
    """
    r = groups.where("n > 1").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum(F.col("n") * F.col("n")).alias("n2")).first()
    if not r["k"] or r["k"] < 2:
        return 1e6
    within = max(1e-9, (r["q"] - r["b"]) / max(1, r["n"] - r["k"]))
    spread = (r["b"] - r["s"] ** 2 / r["n"] - (r["k"] - 1) * within) / (r["n"] - r["n2"] / r["n"])
    return float(min(1e6, within / spread)) if spread > 1e-12 else 1e6


def quality_scores(df: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str, labels: DataFrame,
                   label_id: str, label_col: str, max_train: int = 20_000, site_weight: float = 0.5,
                   threshold: float = 0.5) -> DataFrame:
    """(id, p_doc, host_posterior, path_posterior, p_quality, keep) for every row of ``df``."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                     F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"))
    stats = materialize(rows.mapInArrow(_feature_task, "id long, host string, path string, x array<double>"), "ql-stats")
    known = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where("y IS NOT NULL")
    train = (stats.select("id", "x").join(known, "id").orderBy(F.xxhash64("id"), "id", "y").limit(max_train)
             .select("x", "y").toPandas())
    if train["y"].nunique() < 2:
        w = np.zeros(2 * len(FEATURES) + 1)
        w[-1] = 1.0
    else:
        w = fit(np.stack(train["x"].to_numpy()), (train["y"].to_numpy() > 0.5).astype(np.float64))
    scored = materialize(stats.mapInArrow(_score_task(w), "id long, host string, path string, p double"), "ql-scored")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")]
    paths = materialize(scored.groupBy("host", "path").agg(*sums), "ql-paths")
    hosts = materialize(paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]), "ql-hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not total["n"]:
        return scored.select("id", F.col("p").alias("p_doc"), F.col("p").alias("host_posterior"),
                             F.col("p").alias("path_posterior"), F.col("p").alias("p_quality"), F.lit(True).alias("keep"))
    mean = min(1 - 1e-6, max(1e-6, total["s"] / total["n"]))
    k_host, k_path = _strength(hosts), _strength(paths)
    site = (scored.join(paths.select("host", "path", F.col("n").alias("pn"), F.col("s").alias("ps")),
                        scored["host"].eqNullSafe(paths["host"]) & scored["path"].eqNullSafe(paths["path"]))
            .select(scored["id"], scored["host"].alias("host"), scored["p"], "pn", "ps"))
    site = (site.join(hosts.select(F.col("host").alias("h"), F.col("n").alias("hn"), F.col("s").alias("hs")),
                      F.col("host").eqNullSafe(F.col("h"))))
    host_post = (F.col("hs") - F.col("p") + F.lit(k_host * mean)) / (F.col("hn") - 1 + F.lit(k_host))
    path_post = (F.col("ps") - F.col("p") + F.lit(k_path) * F.col("host_posterior")) / (F.col("pn") - 1 + F.lit(k_path))
    odds = lambda c: F.log(c / (1 - c))
    held = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    out = (site.withColumn("host_posterior", held(host_post)).withColumn("path_posterior", held(path_post))
           .withColumn("logit", odds(F.col("p")) + site_weight * (odds(F.col("path_posterior")) - float(np.log(mean / (1 - mean))))))
    p = 1 / (1 + F.exp(-F.col("logit")))
    return out.select("id", F.col("p").alias("p_doc"), "host_posterior", "path_posterior", p.alias("p_quality"),
                      (p >= threshold).alias("keep"))
