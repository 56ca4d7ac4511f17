"""Token counts by heap-and-linked-list byte-pair merging.

A byte-level BPE vocabulary (tokenizers JSON) is read once per worker. A text is
cut at the strings of special tokens (each counts one, as the library does by
default), then by the byte-level split pattern into pieces. For every piece the
adjacent pair of lowest rank is popped from a heap again and again and merged in
a doubly linked list; the count is the number of initial symbols minus the
number of merges. No id is ever built. Counts of pieces are cached in a bounded
table, since natural text repeats its words.

Null text counts as empty (0 tokens), a null id stays null. Empty tables give empty results; repeated
rows and equal ids are counted each. A very long text is split and counted whole; pieces over 48 characters
are not kept in the table. Columns of other names stay, one named like the count is replaced by it.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphline.llm.common import map_texts, text_or_empty

#: Blocks whose classes have been the same in all Unicode versions since 5.2;
#: a text outside them is split by the library itself.
BLOCKS = "\t-\r\x20-\x7e\xa0-ɏΑ-ΡΣ-ωА-я‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥！-～"
SETTLED = re.compile(f"[^{BLOCKS}]")


def _class(kind: str) -> str:
    """Ranges of the settled characters of a general category, for use in a regex class."""
    out: list[list[int]] = []
    for c in range(0x10000):
        if unicodedata.category(chr(c))[0] == kind and not SETTLED.match(chr(c)):
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out)


@lru_cache(maxsize=1)
def split_pattern() -> re.Pattern:
    """The split of byte-level BPE, for settled texts."""
    letter, number = _class("L"), _class("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^\s{letter}{number}]+|\s+(?!\S)|\s+")


CACHE_ENTRIES = 250_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def tokenizer_path(path: str | None, name: str) -> str:
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceSplitter:
    """Cuts texts at special tokens, then into the pieces that are merged on their own, as the library does."""

    def __init__(self, path: str):
        self.spec = spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError(f"{path}: only plain byte-level BPE is supported")
        added = spec.get("added_tokens", [])
        if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path}: an added token takes in its surroundings")
        self.special = {t["content"]: t["id"] for t in added}
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.pattern = split_pattern()
        self.path = path

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def parts(self, text: str) -> list[str]:
        """The texts between special tokens, which are the parts of odd number."""
        return self.cut.split(text) if self.cut and self.cut.search(text) else [text]

    def pieces(self, text: str) -> list[str]:
        if not SETTLED.search(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]


class PairMerger(dict):
    """Token count of a piece (str), filled on demand."""

    def __init__(self, path: str):
        super().__init__()
        self.splitter = PieceSplitter(path)
        model = self.splitter.spec["model"]
        vocab = model["vocab"]
        self.symbol = [vocab[c] for c in byte_symbols()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])

    def __missing__(self, piece: str) -> int:
        n = self.merged(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 48:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = n
        return n

    def merged(self, raw: bytes) -> int:
        """Symbols left of ``raw`` when no adjacent pair can be merged."""
        ids = [self.symbol[b] for b in raw]
        left = n = len(ids)
        if n < 2:
            return n
        merges = self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*m, i) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, new) for rank, new, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or merges.get((ids[i], ids[j])) != (rank, new):
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, m[1]))
        return left

    def count(self, text: str) -> int:
        parts = self.splitter.parts(text)
        return len(parts) // 2 + sum(sum(map(self.__getitem__, self.splitter.pieces(p))) for p in parts[::2] if p)


@lru_cache(maxsize=4)
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def count_tokens(df: DataFrame, text_col: str = "text", out_col: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``df`` with ``out_col`` (bigint): tokens of each whole text.

    ``path``: a byte-level BPE JSON readable on every worker; by default the
    50k vocabulary of the installed public tokenizers.
    """

    def make():
        m = merger(tokenizer_path(path, "byte_bpe_50k.json"))
        return lambda texts: {out_col: [m.count(t) if t else 0 for t in texts]}

    return map_texts(df, text_col, [T.StructField(out_col, T.LongType())], make)


def token_report(docs: DataFrame, limit: int = 1024, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``."""
    counted = count_tokens(docs.select("doc_id", "text"), path=path)
    return counted.select(
        F.col("doc_id"),
        F.octet_length(text_or_empty()).cast("bigint").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
