"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that a valid encoding of that prefix can end with: the
token before it is the valid last token of the shorter prefix, and the two stay apart when their bytes are merged.
Storing that one token per prefix gives the encoding in one pass over the bytes, lets bytes be appended exactly, and
lets an edited text be encoded again only near the edit. The pieces of many texts go through that pass together, a place
of all of them at a time; a long piece, or one that grows, goes through it alone.
"""

from __future__ import annotations

import base64
import weakref
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, functions as F

from saleskiln.llm.common import Memo, batch_udf, with_struct

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Entries that a task's table of pieces, or of token pairs, holds before it starts anew.
MEMO = 300_000
#: Characters a match of the pattern may look at behind its end.
LOOK = 3
#: Rank of two tokens that don't join.
NEVER = 1 << 40
#: Bytes of a piece up to which it is encoded together with others.
SHORT = 64
#: Characters of texts that are split at one time, but for the end of the last text.
GROUP_CHARS = 1 << 20
#: Bytes of pieces that are encoded together, but for the end of the last one.
BLOCK_BYTES = 1 << 17
#: Places, as a power of two, for token pairs that were tested.
LOG_PAIRS = 20
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str = RANK_FILE) -> dict[bytes, int]:
    """Token bytes to rank, from a local path or a URI of any file system pyarrow knows."""
    system, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with system.open_input_stream(name) as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.read().splitlines())}


class TokenTrie:
    """Tokens by their bytes from the front, in arrays. Nodes are numbered level by level and, within a level, by parent
    and byte; the root is 0. A hash table with linear probing leads from a node and a byte to the node behind."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens = sorted((token for token in ranks if token), key=len)
        sizes = np.array([len(token) for token in tokens], np.int64)
        flat = np.frombuffer(b"".join(tokens), np.uint8).astype(np.int64)
        starts, node = np.cumsum(sizes) - sizes, np.zeros(len(tokens), np.int64)
        edges, count = [np.array([-1])], 1
        for depth in range(int(sizes.max(initial=0))):
            on = np.searchsorted(sizes, depth, "right")
            level, place = np.unique(node[on:] << 8 | flat[starts[on:] + depth], return_inverse=True)
            node[on:] = count + place
            edges.append(level)
            count += len(level)
        #: the parent and byte of each node, and its token or -1
        self.edges, self.tokens = np.concatenate(edges), np.full(count, -1, np.int64)
        self.tokens[node] = [ranks[token] for token in tokens]
        self.shift = np.uint64(64 - (4 * count).bit_length())
        self.slots = np.zeros(1 << (4 * count).bit_length(), np.int32)
        waiting = np.arange(1, count, dtype=np.int32)
        slot = self.slot_of(self.edges[1:])
        while len(waiting):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = waiting[free]
            left = self.slots[slot] != waiting
            waiting, slot = waiting[left], (slot[left] + 1) & (len(self.slots) - 1)

    def slot_of(self, edges: np.ndarray) -> np.ndarray:
        return (edges.astype(np.uint64) * SPREAD >> self.shift).astype(np.int64)

    def behind(self, nodes: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The nodes behind ``nodes`` by a byte each, 0 where there is none."""
        edges = nodes << 8 | data
        slot = self.slot_of(edges)
        found = self.slots[slot]
        other = np.flatnonzero((found > 0) & (self.edges[found] != edges))
        while len(other):
            slot[other] = (slot[other] + 1) & (len(self.slots) - 1)
            found[other] = self.slots[slot[other]]
            other = other[(found[other] > 0) & (self.edges[found[other]] != edges[other])]
        return found.astype(np.int64)

    def occurrences(self, data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, token) of all tokens that stand in ``data``, none beyond the ``stops`` entry of its start."""
        at, size = np.arange(len(data)), 0
        node, out = np.zeros(len(data), np.int64), []
        while len(at):
            node = self.behind(node, data[at + size])
            size += 1
            token = self.tokens[node]
            hit = (node > 0) & (token >= 0)
            out.append((at[hit], at[hit] + size, token[hit]))
            on = (node > 0) & (at + size < stops[at])
            at, node = at[on], node[on]
        return tuple(np.concatenate(column) for column in zip(*out))


def blocks_of(pieces: list[bytes]) -> Iterator[list[bytes]]:
    first, size = 0, 0
    for at, piece in enumerate(pieces, 1):
        size += len(piece)
        if size >= BLOCK_BYTES or at == len(pieces):
            yield pieces[first:at]
            first, size = at, 0


class PrefixBPE:
    """Encoder of pieces and texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, memo: int = MEMO) -> None:
        self.ranks, self.memo = ranks, memo
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.spans = regex.compile(pattern).finditer
        self.trie = TokenTrie(ranks)
        #: token pairs that were tested, each at the place its hash gives; a later pair takes the place over
        self.pairs, self.pairs_apart = np.zeros(1 << LOG_PAIRS, np.uint64), np.zeros(1 << LOG_PAIRS, bool)
        self.longest = max(map(len, ranks), default=1)
        self.apart_memo: dict[int, bool] = {}
        self.alone_memo: dict[int, bool] = {}
        # no cycle through the memo: an encoder's tables are freed with its task, not when the collector comes round
        make = weakref.WeakMethod(self.piece_bytes)
        self.pieces = Memo(lambda pieces: make()(pieces), memo)
        # decoding table: the bytes of all tokens in a row, and where each starts
        size = max(self.bytes_of, default=-1) + 1
        self.sizes = np.array([len(self.bytes_of.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), dtype=np.uint8)

    @cached_property
    def root(self) -> dict:
        """Tokens by their bytes from the front, for single pieces: a node has its token under -1 and the nodes behind
        it by their byte."""
        root: dict = {}
        for token, rank in self.ranks.items():
            node = root
            for byte in token:
                node = node.setdefault(byte, {})
            node[-1] = rank
        return root

    def merged(self, data: bytes) -> list[bytes]:
        """The defining procedure, on the few bytes of one or two tokens: join the lowest pair until none is left."""
        get = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        joined = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while joined and (lowest := min(joined)) != NEVER:
            at = joined.index(lowest)
            parts[at] += parts.pop(at + 1)
            joined.pop(at)
            if at:
                joined[at - 1] = get(parts[at - 1] + parts[at], NEVER)
            if at < len(joined):
                joined[at] = get(parts[at] + parts[at + 1], NEVER)
        return parts

    def alone(self, token: int) -> bool:
        if token not in self.alone_memo:
            self.alone_memo[token] = len(self.merged(self.bytes_of[token])) == 1
        return self.alone_memo[token]

    def apart(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens, encoded together, give just these two tokens."""
        key = left << 32 | right
        known = self.apart_memo.get(key)
        if known is None:
            known = self.stay_apart(left, right)
            if len(self.apart_memo) >= self.memo:
                self.apart_memo.clear()
            self.apart_memo[key] = known
        return known

    def stay_apart(self, left: int, right: int) -> bool:
        a, b = self.bytes_of[left], self.bytes_of[right]
        return a + b not in self.ranks and self.merged(a + b) == [a, b]

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each token ``right``, whether it may stand behind ``left``, or at the front where that is -1."""
        key = (left + 1).astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        # 0 marks a free place
        key += np.uint64(1)
        place = (key * SPREAD >> np.uint64(64 - LOG_PAIRS)).astype(np.int64)
        fits, new = self.pairs_apart[place], np.flatnonzero(self.pairs[place] != key)
        if len(new):
            _, first, which = np.unique(key[new], return_index=True, return_inverse=True)
            pairs = zip(left[new[first]].tolist(), right[new[first]].tolist())
            fits[new] = np.array([self.stay_apart(a, b) if a >= 0 else self.alone(b) for a, b in pairs])[which]
            # of pairs with one place, the last stays
            last = dict(zip(place[new].tolist(), new.tolist()))
            at, by = np.array(list(last)), np.array(list(last.values()))
            self.pairs[at], self.pairs_apart[at] = key[by], fits[by]
        return fits

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids, as the bytes of int32, of pieces of at least one byte: ``extend`` and ``backtrack`` for all of them at
        once. The tokens that begin at one place of their piece end at different places, so they are tried together."""
        sizes = np.array([len(piece) for piece in pieces], np.int64)
        stops = np.cumsum(sizes)
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        begins = np.repeat(stops - sizes, sizes)
        start, end, token = self.trie.occurrences(data, np.repeat(stops, sizes))
        place = (start - begins[start]).astype(np.int32)
        order = np.argsort(place, kind="stable")
        start, end, token = start[order], end[order], token[order]
        # valid last token of the prefix that ends in front of each byte
        last = np.full(len(data) + 1, -1, np.int64)
        edges = np.concatenate([[0], np.cumsum(np.bincount(place))])
        for k in range(len(edges) - 1):
            at, to, by = (column[edges[k] : edges[k + 1]] for column in (start, end, token))
            before = last[at] if k else np.full(len(at), -1)
            open_ = np.flatnonzero((last[to] < 0) & (before >= 0) if k else last[to] < 0)
            fits = open_[self.fit(before[open_], by[open_])]
            last[to[fits]] = by[fits]
        ends, left, used = stops, stops - sizes, np.zeros(len(data) + 1, bool)
        while len(ends):
            if (last[ends] < 0).any():
                raise KeyError("a piece has bytes without a token")
            used[ends] = True
            ends = ends - self.sizes[last[ends]]
            on = ends > left
            ends, left = ends[on], left[on]
        places = np.flatnonzero(used)
        ids = last[places].astype(np.int32).tobytes()
        cuts = (4 * np.searchsorted(places, stops, "right")).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts)]

    def extend(self, data: bytes, last: list[int], start: int) -> list[int]:
        """Valid last tokens of the prefixes of ``data``; ``last`` has those of the first ``start`` bytes. From each
        place, the tokens that begin there are tried for the prefixes they would end."""
        root, known, size = self.root, self.apart_memo.get, len(data)
        last.extend([-1] * (size - start))
        for at in range(max(0, start - self.longest), size):
            before, node = last[at], root
            for end in range(at, size):
                node = node.get(data[end])
                if node is None:
                    break
                if end < start or last[end + 1] >= 0:
                    continue
                token = node.get(-1)
                if token is None:
                    continue
                if not at:
                    fits = self.alone(token)
                else:
                    fits = known(before << 32 | token)
                    if fits is None:
                        fits = self.apart(before, token)
                if fits:
                    last[end + 1] = token
        return last

    def backtrack(self, data: bytes, last: list[int]) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        out, end = [], len(data)
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.backtrack(data, self.extend(data, [-1], 0))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text as int32."""
        return self.encode_texts([text])[0]

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text as int32; the pieces of a group of texts are looked up together."""
        out, group, chars = [], [], 0
        for text in texts:
            group.append(self.split(text))
            chars += len(text)
            if chars >= GROUP_CHARS:
                out += self.encode_group(group)
                group, chars = [], 0
        return out + self.encode_group(group)

    def encode_group(self, group: list[list[str]]) -> list[np.ndarray]:
        ids, out, at = self.pieces.values_of(list(chain.from_iterable(group))), [], 0
        for pieces in group:
            out.append(np.frombuffer(b"".join(ids[at : at + len(pieces)]), dtype=np.int32))
            at += len(pieces)
        return out

    def piece_bytes(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces as the bytes of int32."""
        data = [piece.encode() for piece in pieces]
        whole = [self.ranks.get(piece) for piece in data]
        many = [piece for piece, rank in zip(data, whole) if rank is None and len(piece) <= SHORT]
        coded = chain.from_iterable(map(self.encode_pieces, blocks_of(many)))
        return [
            np.int32(rank).tobytes() if rank is not None else next(coded) if len(piece) <= SHORT else np.array(self.encode_piece(piece), dtype=np.int32).tobytes()
            for piece, rank in zip(data, whole)
        ]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, looked up together; an id without a token raises IndexError."""
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + sizes, sizes)
        return self.flat[at].tobytes()


class PieceEncoder:
    """A growing piece: ``append`` continues the table of prefixes, the ids are those of all bytes so far."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b"") -> None:
        self.bpe, self.data, self.last = bpe, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        start = len(self.data)
        self.data += data
        self.bpe.extend(self.data, self.last, start)

    def ids(self) -> list[int]:
        return self.bpe.backtrack(self.data, self.last) if self.data else []


class EncodedText:
    """A text kept with its pieces. ``edit`` splits again from just before the change until a piece starts where one
    started before; the pieces beyond keep their ids. ``reused`` tells how many did."""

    def __init__(self, bpe: PrefixBPE, text: str) -> None:
        self.bpe, self.text, self.reused = bpe, text, 0
        self.pieces = [(m.start(), self.ids_of(m.group())) for m in bpe.spans(text)]

    def ids_of(self, piece: str) -> list[int]:
        return self.bpe.encode_piece(piece.encode())

    def ids(self) -> list[int]:
        return [i for _, ids in self.pieces for i in ids]

    def append(self, text: str) -> None:
        self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, stop: int, new: str) -> None:
        shift = len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        keep = 0  # pieces that end early enough to have seen nothing of the change
        while keep + 1 < len(self.pieces) and self.pieces[keep + 1][0] <= start - LOOK:
            keep += 1
        later = {at + shift: k for k, (at, _) in enumerate(self.pieces) if at >= stop}
        out, at = self.pieces[:keep], self.pieces[keep][0] if keep < len(self.pieces) else 0
        self.reused = keep
        for match in self.bpe.spans(self.text, at):
            if match.start() >= start + len(new) and match.start() in later:
                rest = self.pieces[later[match.start()] :]
                self.reused += len(rest)
                out = out + [(a + shift, ids) for a, ids in rest]
                break
            out.append((match.start(), self.ids_of(match.group())))
        self.pieces = out


def bpe_round_trip(docs: DataFrame, text_column: str = "text", ranks_path: str = RANK_FILE) -> DataFrame:
    """``docs`` with ``ids`` (array of int, the encoding of the whole text) and ``decoded`` (binary, the bytes those
    ids stand for). A null text counts as empty and gives no ids. Rows stay as they are otherwise: repeated rows give
    equal results, an empty table gives none, columns called ids or decoded are replaced."""

    def start():
        bpe = PrefixBPE(read_ranks(ranks_path))

        def work(texts: list) -> pa.Array:
            ids = bpe.encode_texts([text or "" for text in texts])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.array([], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
            return pa.StructArray.from_arrays([lists, pa.array([bpe.decode(x) for x in ids], pa.binary())], ["ids", "decoded"])

        return work

    return with_struct(docs, batch_udf("ids array<int>, decoded binary", start)(F.col(text_column)), ["ids", "decoded"])
