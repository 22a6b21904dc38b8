"""Quality classifier with hierarchical empirical Bayes.

Evidence of a document is the log-likelihood ratio that a logistic regression on its features gives,
learnt from labelled documents: words and bins of a few shape counts. The sites of the documents then give it a prior: the host's
mean is shrunk towards the global mean and the path's towards the host's, by the strengths that the
spread of the means over sites supports, so sparse sites stay near what is above them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import chunks_by_bytes, cut

#: Labelled documents that are learnt from, by the hash of their id, and features that are kept.
MAX_TRAINING, MAX_FEATURES = 20_000, 1024
#: A feature is kept if it is in so many training documents and its classes differ by so many standard errors.
MIN_DOCUMENTS, MIN_Z = 5, 5.0
#: Penalty of the squared weights, and steps of the fit.
RIDGE, STEPS = 1.0, 300
#: Evidence is trusted up to this many nats either way.
MAX_EVIDENCE = 12.0
#: A document is kept if it is good and not toxic with these posteriors.
MIN_QUALITY, MAX_TOXIC = 0.5, 0.2
BLOCK_BYTES = 4 << 20
REMEMBERED = 1_000_000

#: ASCII bytes other than letters and digits become spaces, capitals small letters.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class _Hashes(dict):
    def __missing__(self, word):
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Hashes()


def _shape(data: bytes, n_words: int) -> list[bytes]:
    """Bins of shares that tell junk from prose, as features."""
    n = len(data) or 1
    a = np.frombuffer(data, dtype=np.uint8)
    kinds = np.bincount(a, minlength=256)
    shares = {"upper": kinds[65:91].sum() / n, "symbol": kinds[list(b"#*$%&|<>@=+/\\^~_{}[]!")].sum() / n, "digit": kinds[48:58].sum() / n, "space": kinds[list(b" \t\n\r\x0b\x0c")].sum() / n}
    out = [f"\0{k}{min(9, int(v * 25))}".encode() for k, v in shares.items()]
    lines = data.split(b"\n")
    out.append(f"\0line{int(10 * (1 - len(set(lines)) / len(lines)))}".encode())
    out.append(f"\0words{min(6, int(math.log2(n_words + 1)))}".encode())
    words = data.split()
    pairs = len(words) - 7
    if pairs > 0:
        out.append(f"\0repeat{int(10 * (1 - len(set(zip(words, words[1:], words[2:], words[3:]))) / (len(words) - 3)))}".encode())
    return out


def features(text: str | bytes | None) -> np.ndarray:
    """Distinct 64-bit features of a text; a null text has those of an empty one."""
    data = (text.encode() if isinstance(text, str) else text) or b""
    if len(_words) > REMEMBERED:
        _words.clear()
    words = set(data.translate(FOLD).split())
    found = list(words) + _shape(data, len(data.split()))
    return np.fromiter(map(_words.__getitem__, found), dtype=np.uint64, count=len(found)).view(np.int64)


def _blocks(batch, column):
    for lo, hi in chunks_by_bytes([len(x.as_py() or "") for x in batch.column(column)], BLOCK_BYTES):
        yield batch.slice(lo, hi - lo)


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING) -> dict:
    """For ``quality`` and ``toxic``: weights of features, intercept, log-odds in the sample.

    Labels without a document, and rows with a null label, don't count. Without labels of both
    kinds there are no weights and all documents are alike.
    """
    sample = labels.where("doc_id is not null and quality is not null and toxic is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    sample = cut(sample.select(F.col("doc_id").alias("labelled"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")), "labelled")
    # at most ``limit`` rows of 16 bytes
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("labelled")).select("text", "quality", "toxic")

    def run(batches):
        for batch in batches:
            for part in _blocks(batch, 0):
                found = [features(t) for t in part.column(0).cast(pa.binary()).to_pylist()]
                rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
                y, t = (np.array(part.column(i).to_pylist(), dtype=np.int64) for i in (1, 2))
                keys, which = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_inverse=True)
                counts = [np.bincount(which, minlength=len(keys)), np.bincount(which, y[rows], len(keys)), np.bincount(which, t[rows], len(keys))]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(c.astype(np.int64)) for c in counts)], names=["feature", "n", "quality", "toxic"])

    joined = cut(joined, "training")
    totals = joined.agg(F.count("*").alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic")).first()
    n = totals["n"]
    counts = cut(joined.repartition(max(1, n // 2000)).mapInArrow(run, "feature long, n long, quality long, toxic long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", "quality", "toxic")]).where(F.col("n") >= MIN_DOCUMENTS), "feature-counts")
    model = {}
    for name in ("quality", "toxic"):
        ones = totals[name] or 0
        zeros = n - ones
        if not ones or not zeros:
            model[name] = ({}, 0.0, 0.0)
            continue
        p1, p0, pooled = F.col(name) / ones, (F.col("n") - F.col(name)) / zeros, F.col("n") / n
        z = F.abs(p1 - p0) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1.0 / ones + 1.0 / zeros))
        best = counts.withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES)
        keys = np.array(sorted(r["feature"] for r in best.select("feature").collect()), dtype=np.int64)
        model[name] = _fitted(joined, name, keys, math.log(ones / zeros))
    return model


def _fitted(joined: DataFrame, name: str, keys: np.ndarray, prior: float) -> tuple[dict[int, float], float, float]:
    """(weights, intercept, log-odds of the sample) of a ridge logistic regression on the features in
    ``keys``. What comes to the driver is the sample, at most MAX_TRAINING rows of these features."""
    shared = joined.sparkSession.sparkContext.broadcast(keys)

    def run(batches):
        for batch in batches:
            for part in _blocks(batch, 0):
                found = []
                for t in part.column(0).cast(pa.binary()).to_pylist():
                    at = np.searchsorted(shared.value, x := features(t))
                    at = at[shared.value[np.minimum(at, len(shared.value) - 1)] == x] if len(shared.value) else at[:0]
                    found.append(np.sort(at).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.binary()), part.column(1)], names=["held", "label"])

    rows = sorted((bytes(r["held"]), r["label"]) for r in joined.select("text", name).mapInArrow(run, "held binary, label int").collect())
    at = np.concatenate([np.frombuffer(h, dtype=np.int32) for h, _ in rows])
    row = np.repeat(np.arange(len(rows)), [len(h) // 4 for h, _ in rows])
    y, w, b = np.array([v for _, v in rows], dtype=float), np.zeros(len(keys)), prior
    first, second, rate = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1), 0.05
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at], len(rows)) + b, -30, 30)))
        g = np.append((np.bincount(at, (p - y)[row], len(keys)) + RIDGE * w) / len(rows), (p - y).mean())
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return dict(zip(keys.tolist(), w.tolist())), float(b), prior


def evidence(docs: DataFrame, model: dict, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """(doc_id, host, path, e_quality, e_toxic) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tables = []
        for name in ("quality", "toxic"):
            weights, intercept, prior = shared.value[name]
            keys = np.array(sorted(weights), dtype=np.int64)
            tables.append((keys, np.array([weights[k] for k in keys.tolist()]), intercept - prior))
        for batch in batches:
            for part in _blocks(batch, 3):
                found = [features(t) for t in part.column(3).cast(pa.binary()).to_pylist()]
                sums = []
                for keys, weights, shift in tables:
                    out = np.full(len(found), shift)
                    if len(keys):
                        for i, x in enumerate(found):
                            at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                            out[i] += np.sort(weights[at[keys[at] == x]]).sum()
                    sums.append(pa.array(np.clip(out, -MAX_EVIDENCE, MAX_EVIDENCE)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *sums], names=["doc_id", "host", "path", "e_quality", "e_toxic"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, host string, path string, e_quality double, e_toxic double")


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(means: DataFrame, mean: float) -> float:
    """Prior strength of sites by moments: the spread of their means beyond what their sizes explain.

    Of ``means`` (n, mean); a small strength where sites differ, a large one where they don't.
    """
    got = means.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("mean") - mean) ** 2).alias("ss"), F.sum(F.col("n") ** 2).alias("n2")).first()
    if not got["n"] or got["k"] < 2:
        return 1000.0
    within = mean * (1 - mean)
    scale = got["n"] - got["n2"] / got["n"]
    between = (got["ss"] - (got["k"] - 1) * within) / scale if scale > 0 else 0.0
    return 1000.0 if between <= 0 else min(1000.0, max(1.0, within / between - 1))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", limit: int = MAX_TRAINING) -> DataFrame:
    """(doc_id, p_quality, p_toxic, host_quality, path_quality, host_toxic, path_toxic, kept) of every
    row of ``docs``.

    A null host or path is a site of its own; null and empty texts have the features of an empty
    text; repeated rows get the same answer; an empty table gives an empty result; very long texts are read
    whole; columns of ``docs`` beside the four named ones aren't read, whatever their names. A document's own
    share is taken out of its path before the path speaks for it. At most ``limit`` labelled rows
    are learnt from; every document counts in its site.
    """
    model = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, limit)
    rows = evidence(docs, model, id_col, text_col, host_col, path_col)
    own = {k: _expit(F.col(f"e_{k}") + model[k][2]) for k in model}
    rows = cut(rows.withColumns({f"o_{k}": F.round(c, 9) for k, c in own.items()} | {"host": F.coalesce("host", F.lit("\0")), "path": F.coalesce("path", F.lit("\0"))}), "evidence")
    whole = {k: F.sum(F.col(f"o_{k}").cast("decimal(20,9)")).cast("double") for k in model}  # exact, in any order
    paths = cut(rows.groupBy("host", "path").agg(F.count("*").alias("n"), *[c.alias(f"s_{k}") for k, c in whole.items()]), "paths")
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("n_host"), *[F.sum(F.col(f"s_{k}").cast("decimal(28,9)")).cast("double").alias(f"h_{k}") for k in model]), "hosts")
    totals = hosts.agg(F.sum("n_host").alias("n"), *[F.sum(F.col(f"h_{k}").cast("decimal(28,9)")).cast("double").alias(k) for k in model]).first()
    n = totals["n"] or 1
    sites = paths.join(hosts, "host")
    out = rows
    for k in model:
        mean = (totals[k] or 0.0) / n
        over_hosts = _strength(hosts.select(F.col("n_host").alias("n"), (F.col(f"h_{k}") / F.col("n_host")).alias("mean")), mean)
        over_paths = _strength(paths.select("n", (F.col(f"s_{k}") / F.col("n")).alias("mean")), mean)
        sites = sites.withColumn(f"host_{k}", (F.col(f"h_{k}") + over_hosts * mean) / (F.col("n_host") + over_hosts))
        sites = sites.withColumn(f"path_{k}", (F.col(f"s_{k}") + over_paths * F.col(f"host_{k}")) / (F.col("n") + over_paths)).withColumn(f"a_{k}", F.lit(over_paths))
    out = rows.join(cut(sites, "sites"), ["host", "path"])
    for k in model:
        prior = (F.col(f"s_{k}") - F.col(f"o_{k}") + F.col(f"a_{k}") * F.col(f"host_{k}")) / (F.col("n") - 1 + F.col(f"a_{k}"))
        out = out.withColumn(f"p_{k}", F.round(_expit(F.col(f"e_{k}") + _logit(prior)), 6))
    posteriors = [F.round(f"{level}_{k}", 6).alias(f"{level}_{k}") for k in model for level in ("host", "path")]
    return out.select("doc_id", "p_quality", "p_toxic", *posteriors, ((F.col("p_quality") >= MIN_QUALITY) & (F.col("p_toxic") < MAX_TOXIC)).alias("kept"))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality and toxicity of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
