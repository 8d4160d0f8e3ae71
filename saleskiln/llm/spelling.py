"""Spelling variants by search schemes over bidirectional FM-indexes.

Of two words one edit apart, the halves of either tell: the edit is in one of them, so the other stands unchanged at the
same end of both words. The vocabulary is dealt to shards by its words' first halves and once more by their last halves,
a word also under the halves that words one longer or shorter have. A shard joins its words, sorted and delimited, to
one text and indexes it in both directions. A word asked for is matched at its unchanged half from the inside out to the
delimiter, then across the other half, where one symbol may be replaced, left out or put in, up to the delimiter at the
other end. The interval that is left is the rank of a suffix that begins with a delimiter, and so the rank of the word.

Only counted words meet in a shard, and each word gets its near words as a count and the best of them, so neither texts
nor pairs are gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from saleskiln.llm.common import Scratch
from saleskiln.llm.fmindex import BidirectionalIndex

#: Letters of words: ASCII, and from U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form occurs at least this many times as often as its variant.
RATIO = 5
#: A run whose checksum this number divides loses a code point.
TYPO = 199
#: Words of a shard on average; each is in it once to four times over all shards.
SHARD_WORDS = 20_000
#: Words asked for at a time.
ASKED = 4096


def word_counts(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", length: int = LEAST_LENGTH, least: int = LEAST_COUNT, typo: int | None = None) -> DataFrame:
    """(word, n): the words of at least ``length`` code points that occur ``least`` times, A-Z lowered.

    With ``typo``, a run whose crc32 of ``<id>:<run>`` it divides has lost the code point at that crc32 modulo its
    length; a null id counts as no text in front of the colon.
    """
    lowered = F.translate(F.col(text_column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # a greedy match of at least so many letters is a whole run
    runs = F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    word: Column = F.col("run")
    if typo:
        drawn = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (F.col("drawn") % F.length("run")).cast("int")
        cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        found = found.withColumn("drawn", drawn)
        word = F.when(F.col("drawn") % typo == 0, cut).otherwise(F.col("run"))
    counted = found.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.length("word") >= length) & (F.col("n") >= least))


def routed(words: DataFrame, shards: int) -> DataFrame:
    """(shard, side, word, n, asked): every word in the shards of its halves, and of those that words one longer or
    shorter look it up by; ``asked`` where it is its own half."""
    n = F.length("word")
    first, last = (n / 2).cast("int"), n - (n / 2).cast("int")
    head = lambda size: F.struct(F.lit(0).alias("side"), F.substring(F.col("word"), F.lit(1), size).alias("half"), (size == first).alias("asked"))
    tail = lambda size: F.struct(F.lit(1).alias("side"), F.substring(F.col("word"), n - size + 1, size).alias("half"), (size == last).alias("asked"))
    # a word of m letters asks by its first m div 2 and its last m - m div 2
    heads = [head(((n + k) / 2).cast("int")) for k in (-1, 0, 1)]
    tails = [tail(n + k - ((n + k) / 2).cast("int")) for k in (-1, 0, 1)]
    places = words.select("word", "n", F.explode(F.array_distinct(F.array(*heads, *tails))).alias("at"))
    return places.select(F.pmod(F.xxhash64("at.side", "at.half"), F.lit(shards)).alias("shard"), F.col("at.side").alias("side"), "word", "n", F.col("at.asked").alias("asked"))


class Vocabulary:
    """Distinct words in order, indexed as ``$word$word$``, where the delimiter is the smallest symbol."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.letters, coded = np.unique(points, return_inverse=True)
        self.lengths = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(self.lengths) - self.lengths
        self.codes = coded.astype(np.int64) + 2
        self.starts = starts
        self.sigma = len(self.letters) + 2
        self.index = BidirectionalIndex(np.append(np.insert(self.codes, starts, 1), 1), self.sigma)

    def near(self, asked: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (of ``asked``, of all words) one edit apart that share the asked word's first half (side 0) or its
        last half (side 1)."""
        n, start = self.lengths[asked], self.starts[asked]
        first = n // 2
        onward, outward = (self.index.right, self.index.left) if side == 0 else (self.index.left, self.index.right)
        # what stays, from the inside out, and what is searched, from the inside out
        kept, rest = (first, n - first) if side == 0 else (n - first, first)
        middle = start + first
        step = 1 if side == 0 else -1
        searched = lambda q, at: self.codes[np.where(step == 1, middle[q] + at, middle[q] - 1 - at)]
        unchanged = lambda q, at: self.codes[np.where(step == 1, middle[q] - 1 - at, middle[q] + at)]
        query, state = np.arange(len(asked)), self.index.all(len(asked))
        # the unchanged half, then its delimiter
        for at in range(int(kept.max(initial=0)) + 1):
            go = np.flatnonzero(at <= kept)
            symbol = np.where(at < kept[go], unchanged(query[go], np.minimum(at, kept[go] - 1)), 1)
            moved = outward(symbol, *(s[go] for s in state))
            for old, new in zip(state, moved):
                old[go] = new
        found: list[np.ndarray] = []
        edited: list[tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]] = []
        letters = np.arange(2, self.sigma)
        at = 0
        while len(query):
            # one word left in an interval is the asked word itself
            live = state[2] > 1
            query, state = query[live], tuple(s[live] for s in state)
            if not len(query):
                break
            open_ = at < rest[query]
            own = np.where(open_, searched(query, np.minimum(at, rest[query] - 1)), 0)
            left_out = np.flatnonzero(open_)
            edited.append((query[left_out], np.full(len(left_out), at + 1), tuple(s[left_out] for s in state)))
            who = np.repeat(np.arange(len(query)), len(letters))
            symbol = np.tile(letters, len(query))
            more = onward(symbol, *(s[who] for s in state))
            some = np.flatnonzero(more[2] > 0)
            who, symbol, more = who[some], symbol[some], tuple(m[some] for m in more)
            edited.append((query[who], np.full(len(who), at), more))
            other = np.flatnonzero(open_[who] & (symbol != own[who]))
            edited.append((query[who[other]], np.full(len(other), at + 1), tuple(m[other] for m in more)))
            same = np.flatnonzero(open_[who] & (symbol == own[who]))
            query, state = query[who[same]], tuple(m[same] for m in more)
            at += 1
            if sum(len(e[0]) for e in edited) > 1 << 20:
                found.append(self.finish(edited, rest, searched, onward))
                edited = []
        found.append(self.finish(edited, rest, searched, onward))
        pairs = np.unique(np.concatenate(found))
        return asked[pairs // len(self.words)], pairs % len(self.words)

    def finish(self, edited: list, rest: np.ndarray, searched, onward) -> np.ndarray:
        """Pairs as one number each: the patterns with their one edit made, matched to the end and the delimiter."""
        if not edited:
            return np.array([], np.int64)
        query, at = (np.concatenate([e[k] for e in edited]) for k in (0, 1))
        state = tuple(np.concatenate([e[2][k] for e in edited]) for k in range(3))
        done = [np.array([], np.int64)]
        while len(query):
            last = at == rest[query]
            symbol = np.where(last, 1, searched(query, np.minimum(at, np.maximum(rest[query] - 1, 0))))
            moved = onward(symbol, *state)
            hit = last & (moved[2] > 0)
            # the suffix that begins with the word's delimiter; the first of those is the text's last delimiter
            done.append(query[hit] * len(self.words) + self.rank_of(moved, hit))
            on = ~last & (moved[2] > 0)
            query, at, state = query[on], at[on] + 1, tuple(m[on] for m in moved)
        return np.concatenate(done)

    def rank_of(self, state: tuple[np.ndarray, ...], hit: np.ndarray) -> np.ndarray:
        return state[0][hit] - self.index.ahead.start[1] - 1


def search_shard(table: pa.Table) -> pa.Table:
    """(word, n_near, form_n, form) of the words asked for in one shard, as far as they share the half it was asked by."""
    words = sorted(set(table.column("word").to_pylist()))
    place = {w: k for k, w in enumerate(words)}
    counts = np.zeros(len(words), np.int64)
    rows = list(zip(*(table.column(c).to_pylist() for c in ("word", "n", "side", "asked"))))
    for word, n, _, _ in rows:
        counts[place[word]] = n
    vocabulary = Vocabulary(words)
    out: list[tuple[str, int, int, str]] = []
    for side in (0, 1):
        asked = np.array(sorted({place[w] for w, _, s, a in rows if a and s == side}), np.int64)
        for at in range(0, len(asked), ASKED):
            who, near = vocabulary.near(asked[at : at + ASKED], side)
            if side:
                # pairs that share the first half too belong to the other side
                fresh = [words[b][: len(words[a]) // 2] != words[a][: len(words[a]) // 2] for a, b in zip(who.tolist(), near.tolist())]
                who, near = who[fresh], near[fresh]
            # words are in order, so of equal counts the first is the smallest
            order = np.lexsort((near, -counts[near], who))
            who, near = who[order], near[order]
            heads = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.array([], np.int64)
            sizes = np.diff(np.append(heads, len(who)))
            out += [(words[who[h]], int(c), int(counts[near[h]]), words[near[h]]) for h, c in zip(heads.tolist(), sizes.tolist())]
    names = ["word", "n_near", "form_n", "form"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.table([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names)


def roots_of(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of the words that have a form: the forms followed to the last, by joins that double the step. The
    count grows RATIO-fold with each step, so a handful of rounds does."""
    links = scratch.write(forms.select("word", F.col("form").alias("root")))
    while True:
        above = links.select(F.col("word").alias("root"), F.col("root").alias("above"))
        if links.join(above, "root", "left_semi").isEmpty():
            return links
        links = scratch.write(links.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root")))


def spelling_variants(words: DataFrame, ratio: int = RATIO, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n).

    Two words are near if they differ by one code point put in, left out or replaced. A word's form is the near word of
    largest n (of equal ones the smallest by code points) if that is at least ``ratio`` times its own, else null; its
    root is where the forms lead. Null words are left out, repeated ones count together; an empty vocabulary gives no
    rows. Words shorter than two code points have no near words.
    """
    scratch = Scratch(words.sparkSession)
    words = scratch.write(words.where("word is not null").groupBy("word").agg(F.sum("n").cast("bigint").alias("n")))
    shards = max(1, -(-words.count() // shard_words))
    places = routed(words.where(F.length("word") > 1), shards)
    found = places.groupBy("shard").applyInArrow(search_shard, "word string, n_near bigint, form_n bigint, form string")
    # the largest count, and of those the first word: bytes of UTF-8 are in the order of code points
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("order"), "form")).alias("best"))
    near = scratch.write(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.col("best.form").alias("near"), (-F.col("best.order")).alias("near_n")))
    is_form = F.col("near_n") >= ratio * F.col("n")
    formed = near.select("word", F.when(is_form, F.col("near")).alias("form"), "n", "n_near", F.when(is_form, F.col("near_n")).alias("form_n"))
    roots = roots_of(formed.where("form is not null"), scratch)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", typo: int | None = None) -> DataFrame:
    """Variants among the words of all ``docs``. Null texts have no words, repeated rows count again, an empty table
    gives no rows, other columns play no part."""
    return spelling_variants(word_counts(docs, text_column, id_column, typo=typo))

