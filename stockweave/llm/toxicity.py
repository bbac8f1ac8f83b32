"""Toxicity by weak supervision: a generative label model over many voters, and a linear classifier on its posteriors.

Voters are words of a seed lexicon, and words and word beginnings (patterns) that labelled rows show to go with label 1;
copies of a text count once for that. Each votes if a text has it. The label model has a latent class, and EM estimates
how often each voter fires in either class (its accuracy) from what the other evidence of a row says, without the voter's
own vote: so no voter confirms itself. Voters that correlate within the classes share their weight in the rows where
they fire together. The given labels orient the classes at the start, and are one more, fallible voter, whose two error
rates are estimated in the same way; where enough independent voters disagree with a label, the posterior does too. The
posteriors of the training rows train a ridge logistic regression on the votes, which then scores every whole text.
labels, lang, source and doc_id are no inputs of a score.

Only rows whose crc32(doc_id as text) mod 4 is not 2 are trained on, TRAIN_ROWS of them at most (those of the least
hashes). Without labels of both classes the seed lexicon alone scores.

Nulls: a null text is an empty one, which gets the score of no votes; a null doc_id is never trained on nor held out.
Labels that are null are ignored; of repeated labels the largest counts. Repeated rows and ties get equal scores. Very
long texts are scored whole; a row's votes are a set, so their number is bounded by the voters. An empty table gives an
empty one. Input columns of the result's names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.llm.common import returning_memory, slices

THRESHOLD = 0.3
#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 20_000
#: Mined voters, those of the greatest evidence (G squared, of EVIDENCE at least): each fires in LEAST rows of label 1 at
#: least, and LIFT times as often as with label 0.
VOTERS, EVIDENCE, LIFT, LEAST = 600, 12.0, 60.0, 3
#: Rounds of EM, the change of a posterior that ends it, and the correlation from which voters share their weight.
ROUNDS, SETTLED, CORRELATED = 30, 1e-3, 0.05
PREFIXES = (4, 5, 6)
# fixed values: insults in several languages, the seed lexicon
SEED = (
    "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile bastard dumb jerk retard "
    "idiota imbecil estupido basura asqueroso idiote stupide ordure minable dummkopf trottel abschaum wertlos"
).split()

_words = re.compile(r"[^\W\d_]+").findall


def tokens(text: str) -> set[str]:
    """Lower-cased words, and their beginnings with an asterisk."""
    words = set(_words(text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) > n}


def evidence(n1, n0, total1, total0, log):
    """G squared of a token with these counts, of so many rows; of numbers or columns."""
    n, every = n1 + n0, total1 + total0
    return 2 * (n1 * log((n1 + 1e-9) * every / (n * total1)) + n0 * log((n0 + 1e-9) * every / (n * total0)))


def _mine(rows: list[tuple[int, str]]) -> list[str]:
    """Voters from labelled (toxic, text) rows."""
    rows = list(dict.fromkeys(rows))
    counts: dict[str, list[int]] = {}
    for toxic, text in rows:
        for t in tokens(text):
            counts.setdefault(t, [0, 0])[toxic] += 1
    total1 = sum(t for t, _ in rows)
    total0 = len(rows) - total1
    found = []
    for t, (n0, n1) in counts.items():
        if n1 >= LEAST and n1 * (total0 + 1) >= LIFT * (n0 + 0.5) * (total1 + 1) and (g := evidence(n1, n0, total1, total0, np.log)) >= EVIDENCE:
            found.append((-g, t))
    return list(dict.fromkeys([*SEED, *(t for _, t in sorted(found)[:VOTERS])]))


def _votes(rows: list[set[int]], n: int) -> np.ndarray:
    out = np.zeros((len(rows), n), np.float32)
    for i, r in enumerate(rows):
        out[i, list(r)] = 1
    return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_model(votes: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row, from the votes and the labels as one more voter; the rates at which each voter
    (the labels last) fires in class 1 and in class 0."""
    n, m = votes.shape
    row, voter = np.nonzero(votes)
    silent = np.bincount(row, minlength=n) == 0
    shared = np.flatnonzero(np.bincount(row, minlength=n) > 1)
    fired = np.bincount(voter, minlength=m).astype(float)
    together = np.zeros((m, m))
    for lo in range(0, len(shared), 2048):
        v = votes[shared[lo : lo + 2048]]
        together += v.T @ v
    np.fill_diagonal(together, fired)
    # the labels orient the classes: a vote counts by the rates at which its voter fires with either label
    y = gold.astype(float)
    at1 = (np.bincount(voter, y[row], minlength=m) + 0.5) / (y.sum() + 1)
    at0 = (np.bincount(voter, 1 - y[row], minlength=m) + 0.5) / (n - y.sum() + 1)
    own = np.log(at1 / at0)[voter]
    z, said = np.log(1 / 9) + np.bincount(row, own, minlength=n), np.zeros(n)
    p = _sigmoid(z)
    for _ in range(ROUNDS):
        n1 = p.sum()
        n0 = n - n1
        # what the rest of its row says of a vote, and what the votes say of a label
        rest = _sigmoid(z[row] - own)
        hits = np.bincount(voter, rest, minlength=m)
        on1, on0 = (hits + 0.5 * n1 / n) / (n1 + 0.5), (fired - hits + 0.5 * n0 / n) / (n0 + 0.5)
        heard = _sigmoid(z - said)
        label1, label0 = (heard @ y + 0.5) / (heard.sum() + 1), ((1 - heard) @ y + 0.5) / (n - heard.sum() + 1)
        # correlations that the classes leave; a vote's weight is shared with the correlated ones of its row
        cov = together / n - np.outer(on1, on1) * (n1 / n) - np.outer(on0, on0) * (n0 / n)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        corr = np.minimum(cov / np.outer(sd, sd), 1)
        corr[corr < CORRELATED] = 0
        np.fill_diagonal(corr, 0)
        load = np.zeros(len(row))
        corr = corr.astype(np.float32)
        for lo in range(0, len(shared), 2048):
            some = shared[lo : lo + 2048]
            a, b = np.searchsorted(row, [some[0], some[-1] + 1])
            mine = np.flatnonzero(np.isin(row[a:b], some)) + a
            load[mine] = (votes[some] @ corr)[np.searchsorted(some, row[mine]), voter[mine]]
        own = np.log(on1 / on0)[voter] / (1 + load)
        none = np.log((heard[silent].sum() + 0.5) / (heard.sum() + 1)) - np.log(((1 - heard)[silent].sum() + 0.5) / (n - heard.sum() + 1))
        said = np.where(y > 0, np.log(label1 / label0), np.log((1 - label1) / (1 - label0)))
        prior = np.clip(n1 / n, 1e-3, 0.5)
        z = np.log(prior / (1 - prior)) + np.bincount(row, own, minlength=n) + silent * none + said
        before, p = p, _sigmoid(z)
        if np.abs(p - before).max() < SETTLED:
            break
    return p, np.append(on1, label1), np.append(on0, label0)


def fit_linear(votes: np.ndarray, target: np.ndarray, ridge: float = 0.3, rounds: int = 12) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on soft targets, by Newton's method."""
    w = np.zeros(votes.shape[1] + 1)
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        h, slope = np.diag(keep), keep * w
        for lo in range(0, len(votes), 2048):
            x = np.concatenate([votes[lo : lo + 2048], np.ones((len(votes[lo : lo + 2048]), 1), np.float32)], axis=1).astype(np.float64)
            p = _sigmoid(x @ w)
            h += (x * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ x
            slope += x.T @ (p - target[lo : lo + 2048])
        step = np.linalg.solve(h, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _model(found: list[str], rows: list[set[int]], gold: np.ndarray) -> dict:
    votes = _votes(rows, len(found))
    w = fit_linear(votes, label_model(votes, gold)[0])
    return {"weights": dict(zip(found, w[:-1].tolist(), strict=True)), "bias": float(w[-1])}


def fit_rows(rows: list[tuple[int, str]]) -> dict:
    """The model of labelled (toxic, text) rows."""
    if not any(t for t, _ in rows) or all(t for t, _ in rows):
        return {"weights": dict.fromkeys(SEED, 3.0), "bias": -3.0}
    found = _mine(rows)
    at = {t: i for i, t in enumerate(found)}
    return _model(found, [{at[t] for t in tokens(x) if t in at} for _, x in rows], np.array([t for t, _ in rows]))


def remainder(doc_id):
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """The model of docs with labels. Texts of the sample stay on the executors as token sets; the driver gets the
    counts of tokens that pass the first test, and each sampled row's votes."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    known = known.where(remainder(F.col("doc_id")) != 2).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # TRAIN_ROWS bounds the broadcast, so no text is shuffled
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.col("_toxic").cast("int").alias("toxic"), "text").where("toxic IN (0, 1)").persist()
    try:
        total = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if not total.get(1) or not total.get(0):
            return fit_rows([])
        texts = sample.dropDuplicates(["toxic", "text"])  # copies show nothing more
        one = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        seen = texts.mapInArrow(returning_memory(_token_rows), "token string, toxic int").groupBy("token").agg(F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") == 0).alias("n0"))
        strong = (F.col("n1") >= LEAST) & (F.col("n1") * (one[0] + 1) >= (F.col("n0") + 0.5) * LIFT * (one[1] + 1))
        found = seen.where(strong).withColumn("g", evidence(F.col("n1"), F.col("n0"), float(one[1]), float(one[0]), F.log)).where(F.col("g") >= EVIDENCE)
        mined = found.orderBy(F.col("g").desc(), "token").limit(VOTERS).collect()
        found = list(dict.fromkeys([*SEED, *(r.token for r in mined)]))
        got = sample.mapInArrow(returning_memory(_voting(found)), "toxic int, votes array<int>").collect()
        return _model(found, [set(r.votes) for r in got], np.array([r.toxic for r in got]))
    finally:
        sample.unpersist()


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        out, toxic = [], []
        for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got = tokens(text or "")
            out += got
            toxic += [y] * len(got)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(toxic, pa.int32())], names=["token", "toxic"])


def _voting(found: list[str]):
    at = {t: i for i, t in enumerate(found)}

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            votes = [sorted(at[t] for t in tokens(x or "") if t in at) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(votes, pa.list_(pa.int32()))], names=["toxic", "votes"])

    return vote


def score_text(model: dict, text: str) -> float:
    weights = model["weights"]
    z = model["bias"] + sum(weights[t] for t in sorted(tokens(text) & weights.keys()))
    return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def _scorer(model: dict):
    weights = model["weights"]
    starts = {t[:-1] for t in weights if t.endswith("*")}
    lengths = sorted({len(s) for s in starts})
    whole = weights.keys()

    def one(text: str) -> float:
        words = set(_words(text.lower()))
        hit = words & whole
        for n in lengths:
            hit |= {f"{s}*" for s in {w[:n] for w in words if len(w) > n} & starts}
        z = model["bias"] + sum(weights[t] for t in sorted(hit))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            scores = [one(t or "") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, "score"])

    return run


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score and predicted."""
    base = docs.drop("held_out", "score", "predicted")
    scored = base.mapInArrow(returning_memory(_scorer(model)), T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumn("held_out", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")
