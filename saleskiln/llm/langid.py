"""Language identification: averaged hashed subword embeddings under a linear softmax, fitted by SGD in numpy.

A text is the mean of the embeddings of its subwords (one to four letters, word edges marked, hashed to buckets), and a
linear layer with softmax names the language. Mean and layer are both linear, so that for prediction each bucket's
embedding is multiplied with the layer once, and a text costs one table lookup per subword.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from saleskiln.llm.common import batch_udf, unused_name, with_struct

BUCKETS, DIM, SIZES = 1 << 15, 12, (1, 2, 3, 4)
#: Training rows taken per language (about; drawn by a hash of the id): so many where that makes no more than TRAIN_ROWS
#: over all languages, else fewer, but no fewer than LEAST_ROWS, so that each is learnt.
ROWS_PER_LANGUAGE, TRAIN_ROWS, LEAST_ROWS = 600, 120_000, 64
#: Rows of a language in an epoch at least; where there are fewer, they are repeated.
LEAST_SEEN = 120
#: Chances that are calculated at once for temperature and rejection.
HELD_CHANCES = 5_000_000
EPOCHS, BATCH, RATE = 6, 32, 0.5
#: Share of rightly named validation texts that rejection may cost.
REJECT_RIGHT = 0.001
UNKNOWN = "und"
#: Odd multipliers of the subword hash, one per position.
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def subwords(texts: Sequence[str], letters: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the subwords that begin at each character, one array per size (BUCKETS where there is none); the
    first character of each text; the letters in each."""
    parts = [f" {text.lower()} " for text in texts]
    # spaces at the end, so that there are subwords of every size
    codes = np.frombuffer(("".join(parts) + " " * max(SIZES)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)
    is_letter = letters[codes]
    codes = np.where(is_letter, codes, np.uint32(32))
    found = []
    for size in SIZES:
        span = len(codes) - size + 1
        mixed = np.full(span, size, dtype=np.uint32)
        inner = np.ones(span, dtype=bool)
        for k in range(size):
            mixed = (mixed ^ codes[k : k + span]) * MULTIPLIERS[k]
            mixed ^= mixed >> np.uint32(15)
            if size < 3 or 0 < k < size - 1:
                inner &= is_letter[k : k + span] if size != 2 else True
        if size == 2:
            inner = is_letter[:-1] | is_letter[1:]
        bucket = np.full(len(codes), BUCKETS, dtype=np.int32)
        bucket[:span][inner] = (mixed & np.uint32(BUCKETS - 1)).astype(np.int32)[inner]
        found.append(bucket)
    return found, starts, np.add.reduceat(is_letter.astype(np.int64), starts)


@dataclass
class LanguageModel:
    """``table`` has each bucket's share of the logits, a row of zeros at the end, or with ``layer`` its embedding, which
    is the shorter one where there are many languages; ``floor`` is the least score kept."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    floor: float
    layer: np.ndarray | None = None

    def scores(self, texts: Sequence[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, and whether a text has letters."""
        found, starts, count = subwords(texts, letters)
        logits = np.zeros((len(texts), self.table.shape[1]))
        total = np.zeros(len(texts))
        for bucket in found:
            logits += np.add.reduceat(self.table[bucket], starts, axis=0)
            total += np.add.reduceat((bucket < BUCKETS).astype(np.int64), starts)
        logits /= np.maximum(total, 1)[:, None]
        return softmax(((logits if self.layer is None else logits @ self.layer) + self.bias) / self.temperature), count > 0


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], languages: list[str], seed: int = 7) -> LanguageModel:
    """SGD on (buckets, counts, language); every fifth row is kept for temperature and rejection, and learnt from where
    its language has no other."""
    rng = np.random.default_rng(seed)
    classes = {name: k for k, name in enumerate(languages)}
    train, held = [r for k, r in enumerate(rows) if k % 5], [r for k, r in enumerate(rows) if k % 5 == 0]
    learnt = {r[2] for r in train}
    train = train + [r for r in held if r[2] not in learnt]
    least, own = min(LEAST_SEEN, max(1, TRAIN_ROWS // len(languages))), Counter(r[2] for r in train)
    train = [r for r in train for _ in range(max(1, -(-least // own[r[2]])))]
    held = held[:: 1 + len(held) * len(languages) // HELD_CHANCES]
    embed = rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (DIM, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)

    def gather(batch: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.concatenate([b for b, _, _ in batch])
        share = np.concatenate([c / max(c.sum(), 1) for _, c, _ in batch]).astype(np.float32)
        return at, share, np.concatenate([[0], np.cumsum([len(b) for b, _, _ in batch])[:-1]])

    steps, done = EPOCHS * -(-len(train) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(train))
        for first in range(0, len(order), BATCH):
            batch = [train[k] for k in order[first : first + BATCH]]
            at, share, starts = gather(batch)
            mean = np.add.reduceat(embed[at] * share[:, None], starts, axis=0)
            error = softmax(mean @ layer + bias)
            error[np.arange(len(batch)), [classes[r[2]] for r in batch]] -= 1
            rate = np.float32(RATE * (1 - done / steps))
            back = (error @ layer.T).astype(np.float32)
            layer -= rate * (mean.T @ error) / len(batch)
            bias -= rate * error.mean(axis=0)
            owner = np.repeat(np.arange(len(batch)), np.diff(np.append(starts, len(at))))
            # a bucket's share of a text is small, so its steps are scaled up to those of the layer
            np.add.at(embed, at, -rate * 10 * share[:, None] * back[owner])
            done += 1
    embed[BUCKETS] = 0
    at, share, starts = gather(held)
    logits = np.add.reduceat(embed[at] * share[:, None], starts, axis=0) @ layer + bias
    truth = np.array([classes[r[2]] for r in held])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(held)), truth] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.05, 5, 40), key=loss))
    chances = softmax(logits / temperature)
    right = chances.max(axis=1)[chances.argmax(axis=1) == truth]
    floor = float(min(np.quantile(right, REJECT_RIGHT), 0.5)) if len(right) else 0.0
    if len(languages) > DIM:
        return LanguageModel(languages, embed, bias.astype(float), temperature, floor, layer)
    return LanguageModel(languages, (embed @ layer).astype(np.float32), bias.astype(float), temperature, floor)


def sparse_counts(docs: DataFrame, text_column: str) -> DataFrame:
    """``docs`` with buckets and counts of the subwords of each text."""

    def start():
        letters = letter_table()

        def work(texts: list) -> pa.Array:
            found, starts, _ = subwords([t or "" for t in texts] or [""], letters)
            rows = []
            for k in range(len(texts)):
                end = starts[k + 1] if k + 1 < len(starts) else len(found[0])
                at, count = np.unique(np.concatenate([f[starts[k] : end] for f in found]), return_counts=True)
                rows.append({"buckets": at[at < BUCKETS], "counts": count[at < BUCKETS]})
            return pa.array(rows, pa.struct([("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]))

        return work

    return with_struct(docs, batch_udf("buckets array<int>, counts array<int>", start)(F.col(text_column)), ["buckets", "counts"])


def train_languages(rows: DataFrame, text_column: str = "text", language_column: str = "lang", id_column: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel | None:
    """Model of the labelled ``rows``, or None where there are none. Languages are counted over all rows, and all are
    learnt; of each, about ``rows_per_language`` whole texts, fewer with many languages, are drawn by a hash of the id, so
    that the draw doesn't depend on partitions."""
    labelled = rows.where(F.col(language_column).isNotNull() & F.col(text_column).isNotNull() & F.col(id_column).isNotNull())
    counts = labelled.groupBy(F.col(language_column).alias("language")).count().orderBy(F.desc("count"), "language").collect()
    if not counts:
        return None
    scale = 1 << 30
    each = min(rows_per_language, max(LEAST_ROWS, TRAIN_ROWS // len(counts)))
    parts = [(row.language, min(scale, int(scale * each / row["count"]) + 1)) for row in counts]
    share, language = unused_name(rows, "_share"), unused_name(rows, "_language")
    shares = rows.sparkSession.createDataFrame(parts, f"`{language}` string, `{share}` bigint")
    drawn = labelled.join(F.broadcast(shares), F.col(language_column) == F.col(language))
    drawn = drawn.where(F.pmod(F.xxhash64(F.col(id_column)), F.lit(scale)) < F.col(share))
    drawn = drawn.select(F.col(id_column).alias("id"), F.col(language_column).alias("language"), F.col(text_column).alias("text"))
    most = 4 * each * len(counts)  # far above what the hash can draw unless ids repeat
    drawn = sparse_counts(drawn.limit(most), "text").select("id", "language", "buckets", "counts")
    found = [(np.array(r.buckets, np.int32), np.array(r.counts, np.int32), r.language) for r in sorted(drawn.collect(), key=lambda r: (str(r.id), r.language)) if r.buckets]
    return fit(found, [r.language for r in counts]) if found else None


def identify_language(docs: DataFrame, model: LanguageModel | None, text_column: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (calibrated probability of it, 0 for ``und``) and rejected.

    Null texts, texts without a letter, and all texts where there is no model, are ``und`` with score 0 and rejected;
    other texts are rejected where the score is below the model's floor, and keep the language named. Repeated rows
    give equal results, an empty table gives none; columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model, letters = shared.value, letter_table()

        def work(texts: list) -> pa.Array:
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if model is not None and texts:
                chances, lettered = model.scores([t or "" for t in texts], letters)
                best = chances.argmax(axis=1)
                names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
                scores = np.where(lettered, chances[np.arange(len(texts)), best], 0.0)
            rejected = [name == UNKNOWN or score < model.floor for name, score in zip(names, scores)]
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"])

        return work

    return with_struct(docs, batch_udf("lang_pred string, score double, rejected boolean", start)(F.col(text_column)), ["lang_pred", "score", "rejected"])
