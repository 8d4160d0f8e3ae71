"""Token counts of whole texts, huge ones by overlapping chunks.

A huge text is encoded chunk by chunk with offsets. Two neighbours overlap, and are spliced at a common boundary: a
place where a pre-token starts in both, far enough from the end of the left chunk that its splitter and its search for
special strings had seen all they can look at. The splitter has no memory, so from such a place on both chunks go on
alike, and as the left one began at a true boundary the splice is exact. Where the overlap holds no such place, the
right chunk is started earlier, twice as far each time, at most at the start of the left one, which then grows to twice
its length instead, so that the work stays in proportion to a text without any such place as well.
"""

from __future__ import annotations

import os

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from saleskiln.llm.common import Memo, batch_udf

TOKENIZER_FILE = public_tokenizers.path("byte_bpe_50k.json")
#: Characters of a chunk; longer texts are cut. Characters two chunks share at first.
CHUNK, OVERLAP = 32_768, 512
#: Characters that the splitter may look at behind a pre-token, added to the longest special string.
LOOK = 4
#: Pre-tokens whose counts a task remembers before it starts anew.
MEMO = 300_000


class Counter:
    def __init__(self, path: str = TOKENIZER_FILE, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.margin = LOOK + max(map(len, self.special), default=0)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.memo = Memo(self.sizes, MEMO)
        self.widened = 0

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        return [self.short(text) if len(text) <= self.chunk else self.long(text) for text in texts]

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def short(self, text: str) -> int:
        """A text of one chunk: the sum over its pre-tokens, which the library encodes one by one; those seen before
        are not encoded again. Texts with special strings go to the library whole."""
        if any(special in text for special in self.special):
            return self.whole(text)
        return sum(self.memo.values_of(self.split(text)))

    def sizes(self, pieces: list[str]) -> list[int]:
        return list(map(len, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)))

    def starts(self, text: str, at: int, end: int) -> tuple[dict[int, int], int]:
        """Start of each pre-token of text[at:end] with the number of tokens before it, and the number of all."""
        found = self.tokenizer.encode(text[at:end], add_special_tokens=False)
        places: dict[int, int] = {}
        before = None
        for k, (word, offset) in enumerate(zip(found.word_ids, found.offsets)):
            if word != before:
                places[at + offset[0]] = k
                before = word
        return places, len(found.ids)

    def long(self, text: str) -> int:
        total, at, end = 0, 0, self.chunk
        left, left_size = self.starts(text, at, end)
        first = 0  # tokens of the left chunk in front of its own splice
        while end < len(text):
            overlap = self.overlap
            while True:
                start = max(at, end - overlap)
                right_end = min(len(text), end + (self.chunk if start > at else end - at))
                right, right_size = self.starts(text, start, right_end)
                if start == at:  # the overlap is the whole left chunk: the right one takes its place
                    place = at
                    break
                stable = [p for p in right if p in left and p <= end - self.margin and left[p] >= first]
                if stable:
                    place = max(stable)
                    break
                overlap *= 2
                self.widened += 1
            if start == at:
                right_first = first
            else:
                total += left[place] - first
                right_first = right[place]
            left, left_size, first, at, end = right, right_size, right_first, start, right_end
        return total + left_size - first


def count_tokens(docs: DataFrame, text_column: str = "text", limit: int = 512, path: str = TOKENIZER_FILE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``). A null text counts as empty: 0
    bytes, 0 tokens. Repeated rows give equal counts, an empty table gives none, columns of these names are replaced."""

    def start():
        counter = Counter(path, chunk, overlap)
        return lambda texts: pa.array(counter.count([text or "" for text in texts]), pa.int64())

    counted = docs.withColumn("n_tokens", batch_udf("bigint", start)(F.col(text_column)))
    sizes = {"n_bytes": F.octet_length(F.coalesce(F.col(text_column), F.lit(""))).cast("bigint"), "over_limit": F.col("n_tokens") > limit}
    return counted.withColumns(sizes)
