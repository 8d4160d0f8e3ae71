"""Benchmark decontamination: one automaton over the word windows of all benchmark items, every text scanned once.

Texts are normalised byte by byte (A-Z lowered, separators to spaces), so that a place in the normalised text maps back
to the original. The automaton (Aho-Corasick) finds every window wherever it begins. It runs over words, not characters:
each word of the items is one symbol, all other words are a symbol of no window. Its size is that of the benchmark: the
items are collected only up to ``BLOCK_BYTES`` of text; a larger benchmark is cut into blocks of items of that size, each
with an automaton of its own, and the passages found by the blocks are joined per document. A worker process builds the
automaton of a block once and keeps it for its next tasks, until a task of another operator comes.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from saleskiln.llm.common import Scratch, batch_udf, built_once, unused_name, with_struct

WINDOW_WORDS = 10
#: Benchmark text that one automaton holds: measured at 0.11 GB for 1 MB of text without repeats (tests/llm holds it to
#: 0.2 GB), in every Python worker.
BLOCK_BYTES = 1 << 20
#: Word bytes: digits, letters and everything beyond ASCII; A-Z become a-z, all others a space.
NORMAL = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
SPAN = "struct<item_id:bigint,first:bigint,last:bigint,start:bigint,stop:bigint>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


def symbol(number: int) -> str:
    """Characters as numbers of words: from 1 on, without the surrogates, which no string may hold."""
    return chr(number + 1 if number + 1 < 0xD800 else number + 1 + 0x800)


class Scanner:
    """Automaton of the items [(item_id, text)]."""

    def __init__(self, items: list[tuple[int, str]], size: int = WINDOW_WORDS) -> None:
        self.symbols: dict[bytes, str] = {}
        owners: dict[str, set[int]] = {}
        for item, text in items:
            words = words_of(text or "")
            line = "".join([self.symbols.setdefault(w, symbol(len(self.symbols))) for w in words])
            for at in range(max(1, len(line) - size + 1)) if line else ():
                owners.setdefault(line[at : at + size], set()).add(item)
        self.automaton = ahocorasick.Automaton() if owners else None
        while owners:
            window, found = owners.popitem()
            self.automaton.add_word(window, (len(window), tuple(sorted(found))))
        if self.automaton:
            self.automaton.make_automaton()

    def spans(self, text: str) -> tuple[int, list[tuple[int, int, int, int, int]]]:
        """Number of words, and per item and run of overlapping windows: item, first and last word, and the
        characters of the original from start to stop."""
        normal = text.encode().translate(NORMAL)
        words = normal.split()
        if not words or self.automaton is None:
            return len(words), []
        line = "".join([self.symbols.get(w, "\0") for w in words])
        found: dict[int, list[tuple[int, int]]] = {}
        for last, (count, items) in self.automaton.iter(line):
            for item in items:
                found.setdefault(item, []).append((last - count + 1, last))
        if not found:
            return len(words), []
        places = [m.span() for m in WORD.finditer(normal)]
        data = text.encode()
        # characters in front of a byte: bytes that don't continue a character
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        out = []
        for item, runs in sorted(found.items()):
            merged: list[list[int]] = []
            for first, last in sorted(runs):
                if merged and first <= merged[-1][1] + 1:
                    merged[-1][1] = max(merged[-1][1], last)
                else:
                    merged.append([first, last])
            out += [(item, a, b, int(chars[places[a][0]]), int(chars[places[b][1]])) for a, b in merged]
        return len(words), out


def hit_words(spans: list[tuple]) -> int:
    """Words inside any span."""
    count, reach = 0, -1
    for first, last in sorted((s[1], s[2]) for s in spans):
        count += max(0, last - max(first, reach + 1) + 1)
        reach = max(reach, last)
    return count


def item_blocks(benchmark: DataFrame, id_column: str, text_column: str, block_bytes: int) -> list[DataFrame]:
    """The items with words, in blocks of at most ``block_bytes`` of text (an item longer than that is a block). Only
    the total is collected: items are dealt to blocks by a hash, twice as many as the total needs."""
    items = benchmark.select(F.col(id_column).cast("bigint").alias("item_id"), F.col(text_column).alias("item_text")).where("item_id is not null and item_text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()[0]
    if total <= block_bytes:
        return [items]
    count = -(-2 * total // block_bytes)
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k) for k in range(count)]


def scan_with(docs: DataFrame, items: list[tuple[int, str]], text_column: str, size: int) -> DataFrame:
    """``docs`` with n_words, n_hit, items and spans of one automaton."""
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def start():
        scanner = built_once(name, lambda: Scanner(shared.value, size))

        def work(texts: list) -> pa.Array:
            rows = [scanner.spans(text or "") for text in texts]
            spans = [[dict(zip(("item_id", "first", "last", "start", "stop"), s)) for s in found] for _, found in rows]
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "first", "last", "start", "stop")]))
            columns = {
                "n_words": pa.array([n for n, _ in rows], pa.int64()),
                "n_hit": pa.array([hit_words(found) for _, found in rows], pa.int64()),
                "items": pa.array([sorted({s[0] for s in found}) for _, found in rows], pa.list_(pa.int64())),
                "spans": pa.array(spans, kind),
            }
            return pa.StructArray.from_arrays(list(columns.values()), list(columns))

        return work

    schema = f"n_words bigint, n_hit bigint, items array<bigint>, spans array<{SPAN}>"
    return with_struct(docs, batch_udf(schema, start, keeps=True)(F.col(text_column)), ["n_words", "n_hit", "items", "spans"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside any occurrence of a window), items (ids with an occurring window),
    spans (per item and passage: words first to last, original characters start to stop) and contaminated (n_hit > 0).

    Null and empty texts have no words, items without words or id occur nowhere, items that share a window are all
    found. An empty benchmark leaves every document clean; repeated rows give equal results; columns of the same name
    are replaced. Runs one small job for the size of the benchmark.
    """
    blocks = item_blocks(benchmark, item_column, item_text_column, block_bytes)
    rows = [[(r.item_id, r.item_text) for r in blocks[0].collect()]] if len(blocks) == 1 else None
    if rows is not None:
        return scan_with(docs, rows[0], text_column, window).withColumn("contaminated", F.col("n_hit") > 0)
    return _by_blocks(docs, blocks, text_column, window)


def _by_blocks(docs: DataFrame, blocks: list[DataFrame], text_column: str, window: int) -> DataFrame:
    """Several automata: each block's passages are written, and joined per row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    row = unused_name(docs, "_row")
    kept = scratch.write(docs.withColumn(row, F.expr("uuid()")))
    parts = []
    for block in blocks:
        items = [(r.item_id, r.item_text) for r in block.collect()]
        found = scan_with(kept.select(row, F.col(text_column)), items, text_column, window)
        parts.append(scratch.write(found.where("n_hit > 0").select(row, F.explode("spans").alias("s"))))
    spans = parts[0]
    for part in parts[1:]:
        spans = spans.unionByName(part)
    # words inside any span, by the furthest reach of the spans in front
    order = Window.partitionBy(row).orderBy("s.first", "s.last").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("s.last") - F.greatest(F.col("s.first"), F.coalesce(F.max("s.last").over(order), F.lit(-1)) + 1) + 1)
    merged = spans.withColumn("new", new).groupBy(row).agg(
        F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("s.item_id")).alias("items"), F.array_sort(F.collect_list("s")).alias("spans")
    )
    base = scan_with(kept, [], text_column, window).drop("n_hit", "items", "spans")
    out = base.join(merged, row, "left").drop(row)
    empty = {"items": F.expr("array()").cast("array<bigint>"), "spans": F.expr("array()").cast(f"array<{SPAN}>")}
    return out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), **{n: F.coalesce(F.col(n), e) for n, e in empty.items()}}).withColumn("contaminated", F.col("n_hit") > 0)
