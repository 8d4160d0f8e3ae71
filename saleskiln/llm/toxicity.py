"""Toxic passages by maximal scoring segments.

Tokens, and the stems of longer ones, get the log-odds of toxic against other texts under Dirichlet priors in proportion to the corpus, less a
multiple of their standard deviation; all that is not surely toxic costs a small drift. One linear scan finds every
maximal scoring segment of a text. Karlin-Altschul statistics (the chance of a segment under the tokens of texts that
are not toxic is an extreme value of their scores) make scores of texts of any length comparable; a logistic curve of
that on labelled texts gives the probability.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from saleskiln.llm.common import Memo, Scratch, batch_udf, hash_sample, with_struct

#: Labelled rows to learn from, drawn by a hash of the id; token buckets, which bound the model.
LABELLED_ROWS, BUCKETS = 20_000, 1 << 18
#: Prior mass as a share of the corpus; standard deviations a token's log-odds must exceed zero by; cost of any other token.
PRIOR, SURE, DRIFT = 1.0, 3.0, 0.05
#: A segment is significant if as good a one is expected in fewer than this many texts that are not toxic.
SIGNIFICANT = 0.05
TOKEN = "\\p{L}+"
#: A longer token also counts as the stems of these lengths; its score is that of the most toxic of them.
STEMS = (4, 5, 6)
MEMO = 200_000


def bucket_of(token: str) -> int:
    return zlib.crc32(token.encode()) & (BUCKETS - 1)


def forms(token: str) -> list[str]:
    """The token and its stems, which end in a star."""
    return [token, *(f"{token[:n]}*" for n in STEMS if len(token) > n)]


def log_odds(toxic: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Score per bucket from how many toxic and other texts have a token."""
    both, n1, n0 = toxic + other, toxic.sum(), other.sum()
    share = n1 / max(n1 + n0, 1)
    prior = PRIOR * (both + 0.5)
    a, b = toxic + prior * share, other + prior * (1 - share)
    total_a, total_b = a.sum(), b.sum()
    odds = np.log(a / (total_a - a)) - np.log(b / (total_b - b))
    least = odds - SURE * np.sqrt(1 / a + 1 / b)
    return np.where(least > 0, least, -DRIFT)


def gumbel_rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(p * exp(rate * score)) = 1, for scores whose mean is below zero."""
    p = weights / weights.sum()
    high = 1.0
    while (p * np.exp(np.minimum(high * scores, 500))).sum() < 1 and high < 1e3:
        high *= 2
    low = 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * scores, 500))).sum() < 1 else (low, mid)
    return high


def maximal_segments(values: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, behind last, score), in one pass (Ruzzo and Tompa).

    Each segment knows the nearest earlier one that starts lower. A new one follows that chain, past segments that no
    later one will have to look at again, so the time is linear.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, behind last, sum in front, sum at its end, lower one
    total = 0.0
    for k, value in enumerate(values):
        before, total = total, total + value
        if value <= 0:
            continue
        first, left, lower = k, before, len(found) - 1
        while lower >= 0 and found[lower][2] >= left:
            lower = found[lower][4]
        # what starts lower and ends lower grows over all that lies between
        while lower >= 0 and found[lower][3] < total:
            first, _, left, _, below = found[lower]
            del found[lower:]
            lower = below
        found.append((first, k + 1, left, total, lower))
    return [(first, last, right - left) for first, last, left, right, _ in found]


@dataclass
class ToxicityModel:
    table: np.ndarray
    rate: float
    log_k: float
    weights: tuple[float, float, float] = (-2.0, 1.0, 0.0)

    def scorer(self):
        split = regex.compile(TOKEN)
        table = self.table.tolist()
        memo = Memo(lambda tokens: [max(table[bucket_of(f)] for f in forms(t)) for t in tokens], MEMO)

        def score(text: str) -> tuple[float, float, list[tuple[int, int, float]]]:
            """Surplus of the best segment, that of all significant ones together, and their character spans."""
            lowered = text.lower()
            tokens = split.findall(lowered)
            if not tokens:
                return 0.0, 0.0, []
            values = memo.values_of(tokens)
            if max(values) <= 0:
                return 0.0, 0.0, []
            segments = maximal_segments(values)
            # minus the log of the number of such segments expected in a text of this length
            worth = [(first, last, self.rate * s - self.log_k - np.log(len(tokens))) for first, last, s in segments]
            sure = [w for w in worth if w[2] > -np.log(SIGNIFICANT)]
            spans = []
            if sure:
                places = [m.span() for m in split.finditer(lowered)]
                spans = [(places[a][0], places[b - 1][1], float(w)) for a, b, w in sure]
            return float(max(w[2] for w in worth)), float(sum(w[2] for w in sure)), spans

        return score

    def probability(self, best: np.ndarray, total: np.ndarray) -> np.ndarray:
        c, a, b = self.weights
        return 1 / (1 + np.exp(-np.clip(c + a * evidence(best) + b * np.log1p(np.maximum(total, 0)), -50, 50)))


def evidence(best: np.ndarray) -> np.ndarray:
    """Minus the log of the chance of a segment this good or better (Gumbel), bounded above."""
    return np.minimum(-np.log(-np.expm1(-np.exp(-np.clip(best, -30, 30))) + 1e-12), 12)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, ...]:
    """Weights of a logistic curve by Newton's method, slightly pulled to zero."""
    x = np.column_stack([np.ones(len(x)), x])
    w, pull = np.zeros(x.shape[1]), np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull @ w
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + pull, grad)
    return tuple(float(v) for v in w)


def segments_of(docs: DataFrame, model: ToxicityModel, text_column: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value
        score = model.scorer()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("surplus", pa.float64())]))

        def work(texts: list) -> pa.Array:
            rows = [score(t or "") for t in texts]
            best, total = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            empty = np.array([not r[2] and r[0] == 0.0 for r in rows], bool)
            best = np.where(empty, -30.0, best)
            spans = [[{"start": a, "stop": b, "surplus": w} for a, b, w in r[2]] for r in rows]
            columns = [pa.array(best, pa.float64()), pa.array(total, pa.float64()), pa.array(model.probability(best, total) if rows else [], pa.float64()), pa.array(spans, kind)]
            return pa.StructArray.from_arrays(columns, ["best", "total", "score", "passages"])

        return work

    schema = "best double, total double, score double, passages array<struct<start:bigint,stop:bigint,surplus:double>>"
    return with_struct(docs, batch_udf(schema, start)(F.col(text_column)), ["best", "total", "score", "passages"])


def train_toxicity(docs: DataFrame, labels: DataFrame, text_column: str = "text", id_column: str = "doc_id", label_column: str = "toxic", rows: int = LABELLED_ROWS) -> ToxicityModel | None:
    """Model from at most ``rows`` labelled documents (the smallest hashes of their ids), or None if there are none of
    one kind. A document with several labels is toxic if one says so; null labels and ids say nothing. The sample is
    bounded, and so is what is collected: counts of BUCKETS buckets, and two numbers per sampled row."""
    scratch = Scratch(docs.sparkSession)
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label_column).cast("int")).alias("label"))
    known = hash_sample(known, "id", rows)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text is not null")
    sample = scratch.write(texts.join(F.broadcast(known), "id"))
    def all_forms(t):
        return F.array_compact(F.array(t, *[F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("*"))) for n in STEMS]))

    # a text counts a form once, so that one that repeats a word doesn't make it look toxic
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"({TOKEN})"), F.lit(1)))
    tokens = sample.select("label", F.explode(F.array_distinct(F.flatten(F.transform(found, all_forms)))).alias("token"))
    counts = tokens.groupBy(F.crc32(F.col("token").cast("binary")).bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(
        F.sum(F.col("label")).alias("toxic"), F.sum(1 - F.col("label")).alias("other")
    )
    found = counts.toPandas()
    toxic, other = np.zeros(BUCKETS), np.zeros(BUCKETS)
    toxic[found.bucket], other[found.bucket] = found.toxic, found.other
    if not toxic.sum() or not other.sum():
        return None
    table = log_odds(toxic, other)
    seen = other > 0
    model = ToxicityModel(table, gumbel_rate(table[seen], other[seen]) if (table[seen] > 0).any() else 1.0, 0.0)
    first = segments_of(sample, model, "text").select("label", "best", "total").toPandas()
    hits = first[(first.label == 0) & (first.best > -30)]
    # the mean of a Gumbel variable lies Euler's constant above its mode, here log K
    model.log_k = float(hits.best.mean() - np.euler_gamma) if len(hits) else 0.0
    second = segments_of(sample, model, "text").select("label", "best", "total").toPandas()
    x = np.column_stack([evidence(second.best.to_numpy()), np.log1p(np.maximum(second.total.to_numpy(), 0))])
    model.weights = logistic(x, second.label.to_numpy(float))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, text_column: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and passages (characters start to stop of each significant passage, and its
    surplus). A null or empty text, or one without letters, gets the score of a text with no toxic token; without a
    model all scores are 0. Repeated rows get equal scores, columns of these names are replaced."""
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "passages": F.expr("array()").cast("array<struct<start:bigint,stop:bigint,surplus:double>>")})
    return segments_of(docs, model, text_column).drop("best", "total")
