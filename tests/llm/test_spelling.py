"""Spelling variants against brute force over words, edge rows and whole tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from saleskiln.llm import spelling
from saleskiln.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits(word, letters):
    out = {word[:k] + word[k + 1 :] for k in range(len(word))}
    for c in letters:
        out |= {word[:k] + c + word[k:] for k in range(len(word) + 1)} | {word[:k] + c + word[k + 1 :] for k in range(len(word))}
    return out - {word}


def brute(counts, ratio=5):
    letters = {c for w in counts for c in w}
    form, result = {}, {}
    for w, n in counts.items():
        near = [v for v in edits(w, letters) if v in counts]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        result[w] = (n, len(near))
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        n, near = result[w]
        result[w] = (form[w], root, n, near, counts[form[w]] if form[w] is not None else None)
    return result


def words_of(rows, typo=199):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if typo and h % typo == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def as_rows(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


@pytest.mark.parametrize("seed, least, shard_words", [(0, 2, 30), (1, 3, 10_000), (2, 6, 50), (3, 6, 10_000)])
def test_variants_against_brute_force(spark, seed, least, shard_words):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(least, least + 6))) for _ in range(60)]
    counts = {}
    for word in base:
        counts[word] = rng.choice([1, 5, 25, 125, 625])
        for _ in range(6):
            k, c = rng.randrange(len(word) + 1), rng.choice("abcéÿ")
            near = rng.choice([word[:k] + c + word[k:], word[:k] + c + word[k + 1 :], word[:k] + word[k + 1 :]])
            if len(near) >= least:
                counts[near] = rng.choice([1, 1, 5, 25, 125])
    counts |= {"a" * 40: 3, "a" * 41: 20, "a" * 42: 200, "a" * 39 + "b": 20, "xyxyxy" * 30: 4, "xyxyxy" * 30 + "x": 40}
    rows = [(w, n) for w, n in counts.items()] + [(None, 7)]
    words = spark.createDataFrame(rows, "word string, n bigint").withColumn("form", F.lit(1))
    assert as_rows(spelling.spelling_variants(words, shard_words=shard_words)) == brute(counts)


def test_equal_counts_repeated_rows_and_empty_tables(spark):
    words = spark.createDataFrame([("colour", 1), ("colouré", 25), ("coloury", 25), ("kolour", 10), ("kolour", 15), ("single", 9)], "word string, n bigint")
    found = as_rows(spelling.spelling_variants(words))
    assert found["colour"] == ("coloury", "coloury", 1, 3, 25) and found["kolour"] == (None, "kolour", 25, 1, None) and found["single"] == (None, "single", 9, 0, None)
    assert spelling.spelling_variants(words.limit(0)).count() == 0
    empty = pa.table({"shard": [], "side": [], "word": [], "n": [], "asked": []})
    assert spelling.search_shard(empty).num_rows == 0


def test_words_of_edge_rows(spark):
    rng = random.Random(7)
    stock = ["Straße", "STRAßE", "naïveté", "ÉTRANGER", "Étranger", "information", "infirmation", "shorts", "a1bcdefg_hijklmn", "漢字letters", "×timesx÷signs"]
    rows = [(k, " ".join(rng.choices(stock, k=40)) + "." * (k % 3)) for k in range(60)] + [(None, "Straße " * 300), (3, None), (4, ""), (5, "x" * 20_000 + " y"), (6, "information " * 9000)]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"word": F.lit("clash"), "n": F.lit(1)})
    for typo in (None, 199, 3):
        found = {r.word: r.n for r in spelling.word_counts(docs, typo=typo).collect()}
        assert found == words_of(rows, typo)
    assert as_rows(spelling.group_spellings(docs, typo=3)) == brute(words_of(rows, 3))
    assert spelling.group_spellings(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_over_a_whole_table(spark, testdata, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{testdata}/{sf}/documents.parquet").select("doc_id", "text").collect()]
    expected = brute(words_of(rows))
    assert as_rows(QUERIES["op13_spelling"](spark, f"{testdata}/{sf}")) == expected and any(v[0] for v in expected.values())
