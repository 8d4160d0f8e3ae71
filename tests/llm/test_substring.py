"""Substring dedup against brute force, on edge rows, periodic and hot passages, and over a whole table."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from saleskiln.llm import fmindex, substring
from saleskiln.llm.queries import QUERIES

WORD = r"[^\x20\x09-\x0D]+"


def brute(texts, window):
    lists = [re.findall(WORD, t or "") for t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in lists for k in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = {k + j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(window)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_wavelet_matrix_and_orders():
    rng = np.random.default_rng(3)
    for sigma in (2, 3, 40):
        sequence = rng.integers(0, sigma, 1000)
        matrix = fmindex.WaveletMatrix(sequence, sigma)
        symbols, low = rng.integers(0, sigma, 200), rng.integers(0, 1001, 200)
        high = np.minimum(low + rng.integers(0, 300, 200), 1000)
        a, b, smaller = matrix.ranks_and_smaller(symbols, low, high)
        assert a.tolist() == matrix.rank(symbols, low).tolist() == [(sequence[:x] == c).sum() for c, x in zip(symbols, low)]
        assert b.tolist() == [(sequence[:x] == c).sum() for c, x in zip(symbols, high)]
        assert smaller.tolist() == [(sequence[x:y] < c).sum() for c, x, y in zip(symbols, low, high)]
        order = fmindex.suffix_order(np.append(sequence, -1))
        assert order.tolist() == sorted(range(1001), key=lambda k: [*sequence[k:].tolist(), -1])


@pytest.mark.parametrize("seed", range(4))
def test_backward_search_counts(seed):
    rng = random.Random(seed)
    sequence = [rng.randint(1, 4) for _ in range(300)]
    index, both = fmindex.FMIndex(np.array(sequence), 5), fmindex.BidirectionalIndex(np.array(sequence), 5)
    for _ in range(50):
        at, n = rng.randrange(290), rng.randint(1, 10)
        pattern = sequence[at : at + n] if rng.random() < 0.7 else [rng.randint(1, 4) for _ in range(n)]
        count = sum(sequence[k : k + len(pattern)] == pattern for k in range(300))
        low, high = index.all(1)
        for symbol in reversed(pattern):
            low, high = index.before(np.array([symbol]), low, high)
        assert high[0] - low[0] == count
        # from the middle outwards, in any order of directions
        left, right, state = len(pattern) // 2, len(pattern) // 2, both.all(1)
        while left > 0 or right < len(pattern):
            if left > 0 and (right == len(pattern) or rng.random() < 0.5):
                left -= 1
                state = both.left(np.array([pattern[left]]), *state)
            else:
                state = both.right(np.array([pattern[right]]), *state)
                right += 1
        assert state[2][0] == count and (not count or state[0][0] == low[0])


def texts_of(seed, window):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [prose(n) for n in (window - 1, window, window + 1, 3 * window)]
    made = [prose(rng.randint(0, 90)) for _ in range(15)]
    made += [f"{prose(rng.randint(0, 20))} {rng.choice(passages)} \t\n{prose(rng.randint(0, 20))}" for _ in range(25)]
    base = prose(150).split()
    for k in range(8):
        copy = list(base)
        copy[rng.randrange(150)] = f"edit{k}"
        made.append(" ".join(copy))
    made += [made[0], made[3], made[3], None, "", "  ", "a " * 200, "a b " * 120, "é\u00a0\u0085ß " * 60, made[20].upper(), prose(6000)]
    return made


@pytest.mark.parametrize("window, hot", [(35, 4096), (35, 3), (8, 4096), (8, 5), (5, 2)])
def test_repeats_against_brute_force(spark, monkeypatch, window, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "BLOCK_WORDS", 500)
    texts = texts_of(window + hot, window)
    rows = [(k % 50, t) for k, t in enumerate(texts)] + [(None, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = substring.drop_repeats(docs.withColumn("n_removed", F.lit("clash")).withColumn("_row", F.lit(1)), window=window).collect()
    expected = Counter((i, t, *x) for (i, t), x in zip(rows, brute([t for _, t in rows], window)))
    assert Counter((r.doc_id, r.text, r.n_words, r.n_removed, r.kept_words) for r in found) == expected
    for r in found:
        assert sum(p["stop"] - p["first"] for p in r.passages) == r.n_removed
    assert found[0].asDict()["_row"] == 1


def test_repeats_of_empty_tables_and_bad_windows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    assert substring.drop_repeats(docs.limit(0)).count() == 0
    assert [(r.n_words, r.n_removed, r.kept_words) for r in substring.drop_repeats(docs).collect()] == [(1, 0, "a")]
    with pytest.raises(ValueError):
        substring.drop_repeats(docs, window=3)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_over_a_whole_table(spark, testdata, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{testdata}/{sf}/documents.parquet").select("doc_id", "text").collect()]
    expected = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for (i, _), (n, gone, kept) in zip(docs, brute([t for _, t in docs], 35))}
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op12_substring"](spark, f"{testdata}/{sf}").collect()}
    assert found == expected and sum(n for _, n, _ in expected.values())
