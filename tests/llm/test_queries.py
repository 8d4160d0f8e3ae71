"""Queries without SQL against libraries and plain versions, over whole tables: every row and every digest."""

from __future__ import annotations

import hashlib
import re
import zlib
from html import unescape

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from saleskiln.llm import byte_bpe, pii
from saleskiln.llm.queries import QUERIES
from tests.llm.test_operators import classes

SF = "/root/testdata/sf0.001"
BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def digest(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def plain_bpe():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(), special_tokens={})


def plain_contamination(text, items, size=10):
    """Number of words, those hit, and items found, by a table of all runs of words of the lengths that windows have."""
    wanted = {}
    for item, other in items:
        words = re.findall(BENCH_WORD, lowered(other))
        for k in range(max(1, len(words) - size + 1)) if words else ():
            wanted.setdefault(tuple(words[k : k + size]), set()).add(item)
    own, hit, found = re.findall(BENCH_WORD, lowered(text)), set(), set()
    for length in {len(w) for w in wanted}:
        for k in range(len(own) - length + 1):
            owners = wanted.get(tuple(own[k : k + length]))
            if owners:
                hit.update(range(k, k + length))
                found |= owners
    return len(own), len(hit), found


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def benchmark(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


def test_token_counts_are_those_of_the_library(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = QUERIES["op4_token_counts"](spark, SF).collect()
    assert len(found) == len(documents) and {r.doc_id for r in found} == set(documents)
    for r in found:
        text = documents[r.doc_id].text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)


def test_bpe_digests_are_those_of_the_library(spark, documents):
    library = plain_bpe()
    found = QUERIES["op7_byte_bpe"](spark, SF).collect()
    assert len(found) == len(documents) and {r.doc_id for r in found} == set(documents)
    for r in found:
        text = documents[r.doc_id].text or ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(text))


def test_contamination_digests_against_all_windows(spark, documents, benchmark):
    found = QUERIES["op8_decontamination"](spark, SF).collect()
    assert len(found) == len(documents) and any(r.contaminated for r in found)
    for r in found:
        n_words, n_hit, items = plain_contamination(documents[r.doc_id].text, benchmark)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n_words, n_hit, len(items), n_hit > 0)
        assert r.items_sha256 == digest(",".join(sorted(map(str, items))))


def test_near_duplicates_against_all_pairs_of_documents(spark, documents):
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op5_minhash"](spark, SF).collect()}
    expected = classes([(k, r.text) for k, r in documents.items()], 85)
    assert found == {k: (n, c, k == c) for k, (n, c) in expected.items()}


def test_pseudonyms_go_back_to_every_document(spark, documents):
    named = QUERIES["op9_pii"](spark, SF)
    changed = {r.doc_id: r for r in named.collect()}
    assert set(changed) == set(documents) and any(r.n_found for r in changed.values())
    assert all(r.n_found == sum(r[f"n_{kind}"] for kind in pii.KINDS) and (r.n_found or r.text == documents[k].text) for k, r in changed.items())
    back = {r.doc_id: r.text for r in pii.pseudonymise(named.select("doc_id", "text"), back=True).collect()}
    assert back == {k: r.text for k, r in documents.items()}


def test_languages_of_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    found = QUERIES["op6_language_id"](spark, sf).collect()
    assert len(found) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out and truth[r.doc_id] is not None and r.lang_pred != "und"]
    assert len(held) > 150 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_toxicity_of_held_out_documents(spark):
    sf = SF.replace("0.001", "0.1")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None}
    found = QUERIES["op2_toxicity"](spark, sf).collect()
    assert len(found) == 10_000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    held = [(r.predicted, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    both = sum(p and t for p, t in held)
    assert both >= 0.8 * sum(p for p, _ in held) and both >= 0.7 * sum(t for _, t in held)


def marked_article(html):
    """Text of the one article element, by its paragraphs as these tables write them."""
    inner = re.search(r"(?s)<article[^>]*>(.*?)</article>", html)[1]
    for part in ("script", "style", "aside", "form", "nav", "footer", "header"):
        inner = re.sub(rf"(?s)<{part}\b.*?</{part}>", "", inner)
    inner = re.sub(r"(?s)<!--.*?-->", "", inner)
    blocks = re.split(r"</?(?:p|h\d|li|ul|ol|div|blockquote|br|table|tr|td|section|pre|figure|figcaption)\b[^>]*>", inner)
    blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks]
    return "\n\n".join(b for b in blocks if b)


def test_main_texts_of_all_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").collect()}
    found = QUERIES["op1_html_extraction"](spark, SF.replace("0.001", "0.01")).collect()
    assert {r.page_id for r in found} == set(pages) and len(found) == len(pages)
    assert all(r.url == pages[r.page_id].url and r.n_chars == len(r.text) for r in found)
    assert all(r.text == marked_article(pages[r.page_id].html) for r in found)
