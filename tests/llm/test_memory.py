"""What operators leave behind, and what they shuffle."""

import gc
import itertools
import random
import re
import weakref

import numpy as np
import pyarrow as pa

from saleskiln.llm import byte_bpe, common, substring
from saleskiln.llm.byte_bpe import PrefixBPE
from tests.test_operators import plan_text


def test_encoder_is_freed_without_the_collector():
    gc.disable()
    try:
        bpe = PrefixBPE({b"a": 0, b"b": 1, b"ab": 2})
        assert bpe.encode("abab").tolist() == [2, 2]
        ref = weakref.ref(bpe)
        del bpe
        assert ref() is None
    finally:
        gc.enable()


def test_segments_meet_their_masks_without_a_distinct_of_their_own(spark, monkeypatch):
    plans, write = [], substring.Scratch.write
    monkeypatch.setattr(substring.Scratch, "write", lambda self, frame: plans.append(plan_text(frame)) or write(self, frame))
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(1, f"x {words}"), (2, f"y y {words}"), (3, words), (3, words), (4, "short"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = substring.drop_repeats(docs).select("doc_id", "n_removed", "kept_words").collect()
    assert sorted((r.doc_id, r.n_removed, r.kept_words) for r in found) == [(1, 60, "x"), (2, 60, "y y"), (3, 60, ""), (3, 60, ""), (4, 0, "short"), (5, 0, "")]
    spans = plans[-1].split("== Optimized Logical Plan ==")[1]
    assert "collect_set" in spans and "Aggregate [row#" not in spans.replace("Aggregate [row#", "", 1)


def test_words_of_segments_are_exchanged_once(spark, monkeypatch):
    plans, write = [], substring.Scratch.write
    monkeypatch.setattr(substring.Scratch, "write", lambda self, frame: plans.append(plan_text(frame)) or write(self, frame))
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(60)))] * 3, "doc_id bigint, text string")
    assert [r.n_removed for r in substring.drop_repeats(docs).collect()] == [60] * 3
    physical = plans[-1].split("== Physical Plan ==")[1]
    assert re.search(r"Exchange hashpartitioning\(key#\d+L, \d+\)", physical)
    assert not re.search(r"hashpartitioning\([^)]*words#", physical)


def test_windows_keep_their_keys_in_segments():
    rng = np.random.default_rng(4)
    hot = substring.Bits(substring.LOG_HOT, [])
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 300, 400)) for _ in range(30)]
    hashes = [np.array([substring.xxhash.xxh3_64_intdigest(w.encode()) for w in t.split()], np.uint64) for t in texts]
    keys = np.unique(np.concatenate([substring.window_keys(h, 35, hot)[0] for h in hashes]))[::9]
    low = (keys & np.uint64((1 << substring.LOG_HOT) - 1)).astype(np.int64)
    hot.data = np.zeros(1 << (substring.LOG_HOT - 3), np.uint8)
    np.bitwise_or.at(hot.data, low >> 3, (1 << (low & 7)).astype(np.uint8))
    found = substring.Segments(texts, 35, hot, lambda keys, _: np.ones(len(keys), bool))
    expected = [substring.window_keys(h, 35, hot) for h in hashes]
    for text, first, count, key in zip(found.text, found.first, found.count, found.key):
        assert (expected[text][0][first : first + count] == key).all()
    assert found.count.sum() == sum(len(k) for k, _, _ in expected) and any(w.any() and not w.all() for _, _, w in expected)


def test_short_pieces_are_encoded_together(monkeypatch):
    rng = random.Random(5)
    for seed in range(40):
        tokens = [b"a", b"b", b"c", b" "]
        while len(tokens) < 4 + seed % 20:
            token = rng.choice(tokens) + rng.choice(tokens)
            if token not in tokens:
                tokens.append(token)
        bpe = byte_bpe.PrefixBPE({token: 3 * rank + 1 for rank, token in enumerate(tokens)})
        monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", rng.choice([1, 50, 1 << 17]))
        monkeypatch.setattr(byte_bpe, "GROUP_CHARS", rng.choice([1, 300, 1 << 20]))
        texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 9, 64, 65, 200]))) for _ in range(rng.randint(0, 9))) for _ in range(20)]
        expected = [[i for piece in bpe.split(text) for i in bpe.encode_piece(piece.encode())] for text in texts]
        alone, extend = [], bpe.extend
        bpe.extend = lambda data, *more: alone.append(data) or extend(data, *more)
        assert [ids.tolist() for ids in bpe.encode_texts(texts)] == expected
        assert all(len(data) > byte_bpe.SHORT for data in alone)
        assert [bpe.decode(ids).decode() for ids in bpe.encode_texts(texts)] == texts


def test_pairs_that_share_a_place_are_told_apart(monkeypatch):
    monkeypatch.setattr(byte_bpe, "LOG_PAIRS", 1)
    bpe = byte_bpe.PrefixBPE({b"a": 0, b"b": 1, b"ab": 2, b"aba": 3, b"bb": 4})
    words = [w for n in range(1, 8) for w in map(bytes, itertools.product(b"ab", repeat=n)) if w not in bpe.ranks]
    assert [np.frombuffer(ids, np.int32).tolist() for ids in bpe.encode_pieces(words)] == [bpe.encode_piece(w) for w in words]


def test_results_go_back_slice_by_slice_and_kept_tables_are_freed(spark):
    made = [common.built_once("a", lambda: [1]), common.built_once("a", lambda: [2])]
    assert made == [[1], [1]] and common.built_once("b", lambda: [3]) == [3] and len(common.KEPT) == 1
    rows = common.SLICE_ROWS * 2 + 5
    keeping = common.batch_udf("bigint", lambda: pa.array, keeps=True).func(iter([pa.array(range(rows))]))
    assert [len(part) for part in keeping] == [common.SLICE_ROWS, common.SLICE_ROWS, 5] and common.KEPT
    freeing = common.batch_udf("bigint", lambda: pa.array).func(iter([pa.array(range(rows)), pa.array([], pa.int64())]))
    assert [x for part in freeing for x in part.to_pylist()] == list(range(rows)) and not common.KEPT
