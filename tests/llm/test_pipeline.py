"""The stages one after another, and the registered SQL, on the smallest tables."""

from __future__ import annotations

import re

import corpus_pipeline
import duckdb
import pytest

from pyspark.sql import functions as F

from saleskiln.llm import langid
from saleskiln.llm.common import SPACES, Scratch
from saleskiln.llm.oracles import ORACLES
from saleskiln.llm.queries import QUERIES
from tests.llm.test_operators import classes
from tests.llm.test_queries import plain_bpe, plain_contamination

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_one_of_each_group(spark):
    scratch, docs = Scratch(spark), spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, SF))
        assert docs.columns == corpus_pipeline.COLUMNS and {r.doc_id for r in docs.select("doc_id").collect()} <= set(before), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == docs.count() > 0.4 * len(before) and all(r.round_trip and len(r.ids) == r.n_tokens for r in last)
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def plain_run(spark, docs, benchmark, model):
    """The rows of a whole run, from rows in memory: (doc_id, lang, source, n_chars, ids)."""
    # language ID: the model is the same, its chances are asked text by text
    sure = []
    for d in docs:
        chances, lettered = model.scores([d["text"] or ""], langid.letter_table())
        if lettered[0] and chances[0].max() >= model.floor:
            sure.append(dict(d))
    # line dedup
    word, key = re.compile(r"[^\x20\x09-\x0D]"), lambda line: line.strip(SPACES)
    sites, first = {}, {}
    for d in sure:
        for line in (d["text"] or "").split("\n"):
            if word.search(line):
                sites.setdefault(key(line), set()).add(d["source"])
                first[key(line)] = min(first.get(key(line), d["doc_id"]), d["doc_id"])
    spread = {k for k, s in sites.items() if len(s - {None}) >= 10}
    left = []
    for d in sure:
        lines = (d["text"] or "").split("\n")
        stay = [x for x in lines if not word.search(x) or key(x) not in spread or first[key(x)] == d["doc_id"]]
        if len(stay) < len(lines):
            d["text"] = "\n".join(stay)
            d["n_chars"] = len(d["text"])
            if not word.search(d["text"]):
                continue
        left.append(d)
    # near-dedup, decontamination, tokens
    group = classes([(d["doc_id"], d["text"]) for d in left], 80)
    left = [d for d in left if group[d["doc_id"]][1] == d["doc_id"]]
    left = [d for d in left if not plain_contamination(d["text"], benchmark)[1]]
    library = plain_bpe()
    return sorted((d["doc_id"], d["lang"], d["source"], d["n_chars"], library.encode_ordinary(d["text"] or "")) for d in left)


def same_rows(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    model = langid.train_languages(docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0))
    expected = plain_run(spark, [r.asDict() for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], model)
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.lang, r.source, r.n_chars, r.ids) for r in found) == expected
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in found)
    return expected


def test_whole_run_against_plain_version(spark, tmp_path):
    """All documents, and boilerplate on many sites, near copies of what is left, benchmark passages and rejects: every
    stage decides here."""
    own = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    passage = next(" ".join(t.split()) for _, t in items if len(t.split()) >= 12)
    base = [d for d in own if 60 < len(d["text"].split()) < 400][:24]
    rows, boiler = list(own), "Every site repeats this line of boilerplate."
    for k, d in enumerate(base):
        words = d["text"].split()
        rows.append({**d, "doc_id": 10_000 + k, "text": f"{boiler}\n{d['text']}\n {boiler}", "source": f"site{k % 12}"})
        rows.append({**d, "doc_id": 11_000 + k, "text": " ".join([*words[:20], f"edit{k}", *words[21:]])})
        rows.append({**d, "doc_id": 12_000 + k, "text": f"{d['text'][::-1]} {passage} {k}"})
        rows.append({**d, "doc_id": 13_000 + k, "text": boiler, "source": f"site{k % 12}"})
    rows += [{**own[0], "doc_id": 14_000 + k, "text": t, "lang": None, "source": None} for k, t in enumerate([None, "", "12 !?", "\n\n"])]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    spark.createDataFrame([tuple(r[n] for n in schema.names) for r in rows], schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r[0] for r in same_rows(spark, str(tmp_path))}
    assert {d["doc_id"] for d in own} & kept and not {k for k in kept if 12_000 <= k < 13_000 or k >= 14_000}


def test_stages_on_nulls_repeats_and_other_columns(spark):
    """Stages take what a table may hold: rows without id go through each stage alone, rows of one id together."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(12)
    first = base.first()
    odd = spark.createDataFrame([tuple(first), (None, first.text, None, None, None), (None, None, None, None, None), (7_000, None, "en", None, 0)], base.schema)
    docs = base.unionByName(odd).withColumn("component_id", F.lit("own")).withColumn("near_id", F.lit(1)).withColumn("items", F.lit(2)).withColumn("ids", F.lit(3))
    docs = Scratch(spark).write(docs)
    named = corpus_pipeline.language_id(spark, docs, SF).collect()
    assert sum(r.doc_id == first.doc_id for r in named) == 2 and not any(r.text is None for r in named)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        ids = [r.doc_id for r in out.collect()]
        assert out.columns == corpus_pipeline.COLUMNS and ids.count(None) == 2 and 7_000 in ids, name
    last = corpus_pipeline.byte_bpe(spark, docs, SF).collect()
    assert len(last) == 16 and all(r.round_trip for r in last)


def test_near_dedup_takes_copies_from_80_percent_on(spark):
    rows = []
    for k, (n, edits) in enumerate([(120, 2), (100, 2), (90, 2), (300, 6), (300, 7)]):
        words = [f"t{k}w{j}" for j in range(n)]
        copy = list(words)
        for e in range(edits):
            copy[10 + e * 12] = f"t{k}edit{e}"
        a, b = ({tuple(x[j : j + 5]) for j in range(n - 4)} for x in (words, copy))
        rows += [(10 * k, " ".join(words), len(a & b) / len(a | b)), (10 * k + 1, " ".join(copy), len(a & b) / len(a | b))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert sum(0.8 <= s < 0.85 for *_, s in rows) >= 4 and any(s < 0.8 for *_, s in rows)
    assert kept == {i for i, _, s in rows if i % 10 == 0 or s < 0.8}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF).toPandas()
    expected = con.execute(ORACLES[name]).fetch_df()[list(found.columns)]
    key = lambda f: sorted(map(tuple, f.itertuples(index=False)))
    assert key(found) == key(expected)
