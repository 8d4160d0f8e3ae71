"""Every operator on repeated rows, empty tables, columns with the names it uses itself, and very long texts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from saleskiln.llm import byte_bpe, decontaminate, html_extract, langid, line_quality, line_spread, minhash, pii, substring, token_counts, toxicity

#: Column names of the operators' own making, results aside.
CLASHES = "_result _row _id _gone _work _share _language id node hash line band component near_id key component_id_ item_id place block marks site value label".split()
WORDS = [f"word{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]


def prose(seed, n=40):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def docs(spark):
    texts = [*(prose(k) for k in range(24)), prose(3), prose(4) + " more", None, "", " \n\t", "A.\nA.", "mail a.b7@x.org or token=ab12cd34ef"]
    rows = [(k, t, ("en", "de")[k % 2], f"s{k % 11}") for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[26], (None, texts[5], None, None), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return frame.withColumns({name: F.lit(f"own {name}") for name in CLASHES})


def models(docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    return toxicity.train_toxicity(docs, labels), langid.train_languages(docs)


@pytest.fixture(scope="module")
def operators(spark, docs):
    toxic, languages = models(docs)
    benchmark = spark.createDataFrame([(1, prose(7)), (2, prose(8)), (None, "x"), (3, None)], "item_id bigint, text string").withColumns({"node": F.lit(1), "block": F.lit(2)})
    pages = docs.withColumnRenamed("text", "html")
    trees = html_extract.train_extractor(pages, id_column="doc_id")
    return {
        "html_extract": lambda d: html_extract.extract_main_text(d.withColumn("html", F.col("text")), trees),
        "toxicity": lambda d: toxicity.score_toxicity(d, toxic),
        "line_quality": line_quality.clean_lines,
        "token_counts": token_counts.count_tokens,
        "minhash": minhash.near_duplicates,
        "langid": lambda d: langid.identify_language(d, languages),
        "byte_bpe": byte_bpe.bpe_round_trip,
        "decontaminate": lambda d: decontaminate.find_contamination(d, benchmark),
        "decontaminate, blocks": lambda d: decontaminate.find_contamination(d, benchmark, block_bytes=200),
        "pii": pii.pseudonymise,
        "line_spread": line_spread.drop_spread_lines,
        "substring": substring.drop_repeats,
    }


NAMES = ["html_extract", "toxicity", "line_quality", "token_counts", "minhash", "langid", "byte_bpe", "decontaminate", "decontaminate, blocks", "pii", "line_spread", "substring"]


@pytest.mark.parametrize("name", NAMES)
def test_rows_and_other_columns_stay(docs, operators, name):
    found = operators[name](docs)
    assert len(found.columns) == len(set(found.columns)) and set(docs.columns) <= set(found.columns)
    rows = found.collect()
    order = lambda ids: sorted(ids, key=lambda k: (k is None, k))
    assert order(r.doc_id for r in rows) == order(r.doc_id for r in docs.select("doc_id").collect())
    own = set(CLASHES) - {"label"}
    assert all(r[c] == f"own {c}" for r in rows for c in own)
    for k in (3, 26):  # repeated rows
        same = [r for r in rows if r.doc_id == k]
        assert len(same) > 1 and all(r == same[0] for r in same)
    # in other partitions and another order the rows are the same
    again = operators[name](docs.repartition(5).sortWithinPartitions(F.desc("text"))).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(docs, operators, name):
    found = operators[name](docs.limit(0))
    assert found.count() == 0 and found.columns == operators[name](docs).columns


def test_ids_of_any_type(docs):
    """Text ids give the groups of number ids; the smallest is that of their order."""
    named = docs.withColumn("doc_id", F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 4, "0")))
    number = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    text = {r.doc_id: r.component_id for r in minhash.near_duplicates(named).collect()}
    assert text == {k if k is None else f"doc-{k:04d}": v if v is None else f"doc-{v:04d}" for k, v in number.items()}
    assert any(k != v for k, v in number.items())


def test_very_long_texts(spark, operators):
    """Half a million characters each: words, one run without a boundary, white space, and short lines."""
    passage = prose(7)
    texts = [" ".join([prose(1, 40_000), passage, prose(2, 30_000)]), "x" * 500_000, " " * 500_000, "Line of text.\n" * 35_000, "12 " * 160_000]
    frame = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string").repartition(5)
    for name in NAMES:
        if name == "line_quality":  # its own figures are in test_operators; sorting the windows of one row is what it costs
            continue
        rows = {r.doc_id: r for r in operators[name](frame).collect()}
        assert sorted(rows) == list(range(5)), name
        if name.startswith("decontaminate"):
            assert rows[0]["items"] == [1] and rows[0].n_hit == 40 and not rows[1].contaminated
        if name == "token_counts":
            assert [rows[k].n_bytes for k in range(5)] == [len(t) for t in texts] and all(r.over_limit for r in rows.values())
        if name == "byte_bpe":
            assert all(bytes(rows[k].decoded).decode() == texts[k] for k in range(5))
        if name == "pii":
            assert all(rows[k].text == texts[k] for k in (0, 1, 2, 3))
        if name == "minhash":
            assert all(r.kept for r in rows.values())


@pytest.mark.parametrize("size", [7, 12, 30, 80, 200, 555])
def test_recall_of_bands_and_estimate(size):
    """Of sets as similar as the threshold asks or hardly more, bands and estimate lose at most one in a hundred."""
    rng, order, lost, draws = np.random.default_rng(size), minhash.loan_order(), 0, 300
    percent, rows = minhash.PERCENT, minhash.ROWS
    floor = percent / 100 - minhash.ERRORS * (percent / 100 * (1 - percent / 100) / minhash.BUCKETS) ** 0.5
    for _ in range(draws):
        both = -(-percent * size // 100)
        union = 100 * both // percent
        alone = union - both
        hashes = rng.integers(0, 2**64, union, dtype=np.uint64)
        cut = both + rng.integers(0, alone + 1)
        a, b = np.unique(hashes[:cut]), np.unique(np.concatenate([hashes[:both], hashes[cut:]]))
        x, y = minhash.registers_of(a, order), minhash.registers_of(b, order)
        banded = any((x[k * rows : (k + 1) * rows] == y[k * rows : (k + 1) * rows]).all() for k in range(minhash.BANDS))
        about = minhash.similarity_estimate([x.tobytes()], [y.tobytes()], np.array([len(a)]), np.array([len(b)]))[0]
        lost += not (banded and about >= floor)
    assert lost <= draws / 100
