"""Substring dedup: windows of words that stand anywhere else, found by backward search in FM-indexes.

A window's key is the smallest hash of the word runs inside it, so that equal windows have equal keys wherever they
stand, and neighbouring windows mostly share one. Runs of windows with one key, which cover each window once, are dealt
to shards by that key: a shard holds every occurrence of its windows, and each document is streamed against those shards
only that can hold a match. Keys that occur once are left out by a bitmap of fixed size. Equal runs become one with a
count before they meet, and windows under a very frequent key get a hash of the whole window for a key, so no key
gathers an unbounded group. What is keyed by the whole window is decided by counting; only the other segments, of
which a key has less than ``HOT``, are sent with their words, once.

A shard is cut at keys into blocks of bounded size, each with an FM-index over its words (numbered, so no hash decides
what is equal). Matching statistics are taken from right to left; where a match breaks off, the search goes on at the
last window that does not contain the break.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from saleskiln.llm.common import SLICE_ROWS, Scratch, unused_name
from saleskiln.llm.fmindex import FMIndex
from saleskiln.llm.minhash import mix

WINDOW_WORDS = 35
#: Segments of one key from which on its windows are keyed one by one.
HOT = 4096
#: Bits, as a power of two, of the bitmap of repeated keys and of that of hot keys: 16 MB and 2 MB at every size.
LOG_REPEATED, LOG_HOT, BLOCK = 27, 24, 1 << 15
#: Words of one FM-index, but for the end of its last key's group.
BLOCK_WORDS = 1 << 20
#: Windows of one segment at most: bits of a mask.
LONGEST = 60
LEFT, RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Bits:
    """A bitmap of the low bits of hashes; a set bit may be another hash's."""

    def __init__(self, log_size: int, blocks: list[tuple[int, bytes]]) -> None:
        self.log_size, self.data = log_size, None
        if blocks:
            self.data = np.zeros(1 << (log_size - 3), np.uint8)
            for block, marks in blocks:
                self.data[block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)] = np.frombuffer(marks, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        if self.data is None:
            return np.zeros(len(keys), bool)
        at = (keys & np.uint64((1 << self.log_size) - 1)).astype(np.int64)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bits_of(keys: DataFrame, log_size: int) -> Bits:
    """Bitmap of a column ``key``; what comes to the driver is the bitmap, of at most 2^(log_size - 3) bytes."""
    at = F.col("key").bitwiseAND(F.lit((1 << log_size) - 1))
    marks = keys.select(F.shiftright(at, 15).alias("block"), (at % BLOCK).alias("at")).groupBy("block").agg(F.bitmap_construct_agg("at").alias("marks"))
    return Bits(log_size, [(r.block, bytes(r.marks)) for r in marks.collect()])


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * LEFT + b * RIGHT)


def gram_of(window: int) -> int:
    """Words of the runs whose hashes make keys: the largest power of two up to half a window."""
    return 1 << max((window // 2).bit_length() - 1, 0)


def window_keys(hashes: np.ndarray, window: int, hot: Bits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the window that begins at each word: its key, the word where the run that gave it begins, and whether the
    key is that of the window as a whole. Equal windows that overlap get their keys from different places."""
    count, gram = max(len(hashes) - window + 1, 0), gram_of(window)
    if not count:
        return np.array([], np.uint64), np.array([], np.int64), np.array([], bool)
    runs, size = mix(hashes), 1
    while size < gram:
        runs, size = combine(runs[:-size], runs[size:]), 2 * size
    choice = window - gram + 1
    least, size = np.arange(len(runs)), 1
    smaller = lambda a, b: np.where(runs[a] <= runs[b], a, b)
    while 2 * size <= choice:
        least, size = smaller(least[:-size], least[size:]), 2 * size
    least = smaller(least[:count], least[choice - size : choice - size + count])
    key = runs[least]
    by_whole = hot.has(key)
    if not by_whole.any():
        return key, least, by_whole
    whole = runs[window - gram : window - gram + count]
    for at in range(0, window - gram, gram):
        whole = combine(runs[at : at + count], whole)
    return np.where(by_whole, whole, key), np.where(by_whole, np.arange(count), least), by_whole


class Segments:
    """The segments of a few texts: ``text`` (number), ``first`` (window of it), ``count`` (windows), ``key`` and
    ``by_whole`` (whether the key is that of the window as a whole)."""

    def __init__(self, texts: list[str | None], window: int, hot: Bits, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        self.words = [(t or "").encode().split() for t in texts]
        lengths = np.array([len(w) for w in self.words], np.int64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(self.words)), np.uint64, int(lengths.sum()))
        ends = np.cumsum(lengths)
        keys, places, by_whole = window_keys(hashes, window, hot)
        text = np.repeat(np.arange(len(texts)), lengths)[: len(keys)]
        at = np.arange(len(keys))
        # windows of one text, and of these the wanted ones
        at = at[(at + window <= ends[text]) & wanted(keys, by_whole)] if len(keys) else at
        key, text, place, by_whole = keys[at], text[at], places[at], by_whole[at]
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (by_whole[1:] != by_whole[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)
        starts = np.flatnonzero(new)
        new[(np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))) % LONGEST == 0] = True
        starts = np.flatnonzero(new)
        self.count = np.diff(np.append(starts, len(at)))
        self.text, self.key, self.by_whole = text[starts], key[starts], by_whole[starts]
        self.first = at[starts] - (ends - lengths)[self.text]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def segment_id(key: int, words: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b"%d " % key + words)


def key_counts(texts: DataFrame, window: int, hot: Bits | None = None) -> DataFrame:
    """(key, n): segments by key, or with ``hot`` the windows under hot keys by the hash of the whole."""
    shared = texts.sparkSession.sparkContext.broadcast(hot or Bits(LOG_HOT, []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        wanted = (lambda keys, by_whole: by_whole) if hot.data is not None else (lambda keys, by_whole: np.ones(len(keys), bool))
        for part in slices(batches):
            found = Segments(part.column(0).to_pylist(), window, hot, wanted)
            yield pa.record_batch([pa.array(found.key.view(np.int64))], ["key"])

    return texts.select("text").mapInArrow(run, "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def segment_rows(texts: DataFrame, window: int, hot: Bits, repeated: Bits) -> DataFrame:
    """(row, first, segment, key, by_whole, words) of the segments whose key may occur elsewhere, for texts of (row, text)."""
    shared = texts.sparkSession.sparkContext.broadcast((hot, repeated))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, repeated = shared.value
        for part in slices(batches):
            found = Segments(part.column(1).to_pylist(), window, hot, lambda keys, _: repeated.has(keys))
            keys, firsts = found.key.view(np.int64), found.first.tolist()
            words = [b" ".join(found.words[t][a : a + n + window - 1]) for t, a, n in zip(found.text.tolist(), firsts, found.count.tolist())]
            ids = [segment_id(k, w) for k, w in zip(keys.tolist(), words)]
            columns = [part.column(0).take(pa.array(found.text)), pa.array(firsts, pa.int32()), pa.array(ids, pa.binary()), pa.array(keys), pa.array(found.by_whole), pa.array(words, pa.binary())]
            yield pa.record_batch(columns, ["row", "first", "segment", "key", "by_whole", "words"])

    return texts.mapInArrow(run, "row binary, first int, segment binary, key bigint, by_whole boolean, words binary")


def repeated_windows(parts: list[list[bytes]], asked: np.ndarray, window: int) -> list[int]:
    """For each of the ``asked`` word lists, a mask of its windows that occur twice or more in all of ``parts``."""
    numbers: dict[bytes, int] = {}
    lengths = np.array([len(p) for p in parts], np.int64)
    coded = np.fromiter((numbers.setdefault(w, len(numbers) + 2) for w in chain.from_iterable(parts)), np.int64, int(lengths.sum()))
    # a separator behind each part
    ends = np.cumsum(lengths)
    sequence = np.insert(coded, ends, 1)
    starts = (ends - lengths) + np.arange(len(parts))
    index = FMIndex(sequence, len(numbers) + 2, depth=int(lengths.max()))
    base, stop = starts[asked], lengths[asked].copy()
    masks = np.zeros(len(asked), np.uint64)
    at = stop.copy()
    low, high = index.all(len(asked))
    live = np.flatnonzero(stop >= window)
    while len(live):
        begin = at[live] - 1
        a, b = index.before(sequence[base[live] + begin], low[live], high[live])
        on = b - a >= 2
        ok, broken = live[on], live[~on]
        at[ok], low[ok], high[ok] = begin[on], a[on], b[on]
        # what reaches over a whole window and stands elsewhere
        full = ok[stop[ok] - at[ok] >= window]
        masks[full] |= np.uint64(1) << at[full].astype(np.uint64)
        # no window that holds the broken run occurs elsewhere: go on at the last one that does not
        stop[broken] = np.minimum(stop[broken] - 1, at[broken] - 1 + window)
        at[broken], low[broken], high[broken] = stop[broken], 0, index.size
        live = live[(stop[live] >= window) & (at[live] > 0)]
    return masks.tolist()


def search_shards(segments: DataFrame, window: int) -> DataFrame:
    """(segment, mask) of the distinct ``segments`` (key, words) that hold a repeated window. A key should have a
    bounded number of them: they are dealt by key as they are, and equal ones become one where they meet."""

    def block(keys: list[int], words: list[bytes], counts: list[int]) -> pa.RecordBatch:
        key, n = np.array(keys, np.int64), np.array(counts, np.int64)
        new = np.append(True, key[1:] != key[:-1])
        group = np.cumsum(new) - 1
        members = np.bincount(group)[group]
        parts = [w.split(b" ") for w in words]
        masks = np.array([(1 << (len(p) - window + 1)) - 1 for p in parts], np.uint64)
        # copies say it all; others are searched for among all that share their key
        masks[n == 1] = 0
        held = np.flatnonzero(members > 1)
        asked = np.flatnonzero((n == 1)[held])
        if len(asked):
            masks[held[asked]] = np.array(repeated_windows([parts[k] for k in held], asked, window), np.uint64)
        hits = np.flatnonzero(masks)
        ids = [segment_id(keys[k], words[k]) for k in hits]
        return pa.record_batch([pa.array(ids, pa.binary()), pa.array(masks[hits].astype(np.int64))], ["segment", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        words: list[bytes] = []
        counts: list[int] = []
        size = 0
        for part in slices(batches, 4096):
            for key, text, n in zip(*(part.column(k).to_pylist() for k in range(3))):
                if size >= BLOCK_WORDS and key != keys[-1]:
                    yield block(keys, words, counts)
                    keys, words, counts, size = [], [], [], 0
                keys.append(key)
                words.append(text)
                counts.append(n)
                size += text.count(b" ") + 2
        if keys:
            yield block(keys, words, counts)

    distinct = segments.select("key", "words").repartition("key").groupBy("key", "words").agg(F.count(F.lit(1)).alias("n"))
    return distinct.sortWithinPartitions("key").mapInArrow(run, "segment binary, mask bigint")


def hit_words(n_words: int, found: list, window: int) -> np.ndarray:
    """Which words of a text lie in a repeated window, from (first, mask) of its segments."""
    edges = np.zeros(n_words + 1, np.int64)
    if found:
        first = np.array([f["first"] for f in found], np.int64)
        mask = np.array([f["mask"] for f in found], np.uint64)
        on = (mask[:, None] >> np.arange(LONGEST, dtype=np.uint64)) & np.uint64(1)
        which, bit = np.nonzero(on)
        np.add.at(edges, first[which] + bit, 1)
        np.add.at(edges, first[which] + bit + window, -1)
    return np.cumsum(edges[:-1]) > 0


def drop_repeats(docs: DataFrame, text_column: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` with n_words, n_removed, ``kept_words`` (the words that stay, joined by one space) and ``passages``
    (first and behind-last word of each run removed).

    A word goes if a window of ``window`` consecutive words over it begins anywhere else, in the same text or another
    row; every occurrence goes, the first included, and all is judged on the input. Words are runs without the six ASCII
    white-space characters, compared as they are. Null, empty and short texts lose nothing (kept_words of a null text is
    empty). Repeated rows are occurrences of each other. Rows are told apart by their texts, not by an id, which may be
    missing or occur twice. An empty table gives no rows; columns of these names are replaced.
    """
    if window < 4:
        raise ValueError("windows of fewer than 4 words are not supported")
    scratch = Scratch(docs.sparkSession)
    row = unused_name(docs, "_row")
    keyed = docs.withColumn(row, F.unhex(F.substring(F.sha2(F.col(text_column).cast("binary"), 256), 1, 32)))
    texts = keyed.select(F.col(row).alias("row"), F.col(text_column).alias("text")).where("row is not null")
    counts = scratch.write(key_counts(texts, window).where("n > 1"))
    hot, repeated = bits_of(counts.where(F.col("n") >= HOT), LOG_HOT), counts.select("key")
    if hot.data is not None:
        repeated = repeated.unionByName(scratch.write(key_counts(texts, window, hot).where("n > 1").select("key")))
    rows = scratch.write(segment_rows(texts, window, hot, bits_of(repeated, LOG_REPEATED)))
    # a window under a key of its own is repeated if it is there twice; it can have any number of copies
    copies = rows.where("by_whole").groupBy("segment").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("segment", F.lit(1).cast("bigint").alias("mask"))
    masks = search_shards(rows.where("not by_whole"), window).unionByName(copies)
    found = rows.select("row", "first", "segment").join(masks, "segment")
    spots = unused_name(docs, "_spots")
    spans = scratch.write(found.groupBy(F.col("row").alias(row)).agg(F.collect_set(F.struct("first", "mask")).alias(spots)))

    def cut(both: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))
        names = ["n_words", "n_removed", "kept_words", "passages"]
        for batch in both:
            parts = []
            for at in range(0, max(len(batch), 1), SLICE_ROWS):
                totals, gone, kept, passages = [], [], [], []
                for item in batch.slice(at, SLICE_ROWS).to_pylist():
                    words = (item["text"] or "").encode().split()
                    hit = hit_words(len(words), item["spots"] or [], window) if item["spots"] else None
                    totals.append(len(words))
                    gone.append(int(hit.sum()) if hit is not None else 0)
                    kept.append(b" ".join(words if hit is None else [w for w, h in zip(words, hit.tolist()) if not h]).decode())
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]))) if hit is not None else np.array([], int)
                    passages.append([{"first": a, "stop": b} for a, b in edges.reshape(-1, 2).tolist()])
                columns = [pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(passages, kind)]
                parts.append(pa.StructArray.from_arrays(columns, names))
            yield parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

    cut.__annotations__ = {"both": Iterator[pa.Array], "return": Iterator[pa.Array]}
    schema = "n_words bigint, n_removed bigint, kept_words string, passages array<struct<first:bigint,stop:bigint>>"
    result = unused_name(docs, "_cut")
    udf = arrow_udf(cut, schema).asNondeterministic()
    joined = keyed.join(spans, row, "left")
    out = joined.withColumn(result, udf(F.struct(F.col(text_column).alias("text"), F.col(spots).alias("spots")))).drop(row, spots)
    return out.withColumns({name: F.col(result)[name] for name in ("n_words", "n_removed", "kept_words", "passages")}).drop(result)
