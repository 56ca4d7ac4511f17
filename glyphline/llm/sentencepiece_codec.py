"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The unique words of a batch are laid out as one flat array of symbols. In every
round each word finds its minimum pair rank (a segmented minimum), merges at the
leftmost place of that rank and, as far as no merge creates a pair that would
come first, at the later places too; the array is compacted; words without a
mergeable pair leave. The result is that of the library's agenda, one merge after
another by score and place.

Words are cut before spaces, around line feeds and between letters and others, which
is exact if no piece spans such a place; that is checked against the vocabulary,
else texts are cut less or encoded whole. Encoded words are kept in
a bounded table.

Only models like those of the public 32k vocabulary are taken: BPE, identity
normalisation, no user-defined pieces, extra white space kept, byte fallback.

Decoding joins the bytes of all pieces of a text, looked up by id in one flat table; only where they
aren't valid UTF-8 as a whole, runs of byte pieces are decoded one by one.

Null text counts as empty: no ids, decoded to the empty text. Null or equal ids and repeated rows come out
each. A very long text is encoded and decoded whole. An empty table gives no rows. Columns named like an output are
replaced by it, others stay (encode_documents, decode_documents) or aren't read (codec_report).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphline.llm.common import map_texts
from glyphline.llm.tables import KeyTable
from glyphline.llm.token_counts import tokenizer_path

SPACE = "▁"
CACHE_WORDS = 300_000
NONE = np.int32(2**31 - 1)


class PieceCodec:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if spec.model_type != 2 or norm.name != "identity" or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not spec.byte_fallback or spec.treat_whitespace_as_suffix or kinds & {4, 5}:
            raise ValueError(f"{path}: not a plain BPE model with byte fallback")
        self.prefix = norm.add_dummy_prefix
        self.piece = [p.piece for p in model.pieces]
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == 3}
        self.unknown = {i for i, p in enumerate(model.pieces) if p.type == 2}
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        rank = {s: k for k, s in enumerate(sorted({model.pieces[i].score for i in normal.values()}, reverse=True))}
        # symbols: pieces by id, then characters that aren't pieces but occur in them
        self.n_pieces = len(self.piece)
        symbol = dict(normal)
        for p in normal:
            for c in p:
                symbol.setdefault(c, len(self.piece) + len(symbol) - len(normal))
        self.first_other = max(symbol.values(), default=0) + 1
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.first_other
        self.char_of = {}
        for s, i in symbol.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
                self.char_of[i] = s
        keys, new, ranks = [], [], []
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    new.append(i)
                    ranks.append(rank[model.pieces[i].score])
        self.pairs = KeyTable(np.array(keys, np.uint64))
        self.new, self.rank = np.array([*new, 0], np.int64), np.array([*ranks, NONE], np.int32)
        safe = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal)
        letter = re.compile(r"[^\W\d_]")
        mixed = any(bool(letter.match(a)) != bool(letter.match(b)) for p in normal for a, b in zip(p.lstrip(SPACE), p.lstrip(SPACE)[1:], strict=False))
        # without pieces that mix letters with others, words are cut between these too
        self.words = re.compile((r" *[^ \n]+|\n| +" if mixed else r" *[^\W\d_]+| *(?:[^ \n\w]|[\d_])+|\n| +| *[^ \n]") if safe else r"(?s).+")
        self.known: dict[str, bytes] = {}
        self.id_text = [str(i) for i in range(self.n_pieces)]
        self.raw = [p.replace(SPACE, " ").encode() for p in self.piece]
        for i in range(self.n_pieces):
            if i in self.id_byte:
                self.raw[i] = bytes([self.id_byte[i]])
            elif i in self.unknown:
                self.raw[i] = " ⁇ ".encode()
            elif i in self.silent:
                self.raw[i] = b""

    # -- encoding -------------------------------------------------------------
    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word (as bytes of unsigned 32-bit integers) when no pair is left."""
        out = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym, word = self.of_char[code], np.repeat(np.arange(len(words)), sizes)
        while len(sym):
            at = self._pair(sym[:-1], sym[1:])
            at = np.append(np.where(word[1:] == word[:-1], at, -1), -1)
            rank = self.rank[at]
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(sym)))
            done = least == NONE
            if done.any():
                stay = np.repeat(~done, length)
                self._settle(out, word[start[done]], length[done], sym[~stay])
                sym, word, at, rank = sym[stay], word[stay], at[stay], rank[stay]
                least, length = least[~done], length[~done]
                if not len(sym):
                    break
            hit = rank == np.repeat(least, length)
            spot = np.flatnonzero(hit)
            # of touching places every other one, from the left
            run = np.append(True, np.diff(spot) > 1)
            spot = spot[(np.arange(len(spot)) - np.maximum.accumulate(np.where(run, np.arange(len(spot)), 0))) % 2 == 0]
            spot = spot[self._in_turn(spot, sym, word, at, rank)]
            sym = sym.copy()
            sym[spot] = self.new[at[spot]]
            left = np.ones(len(sym), bool)
            left[spot + 1] = False
            sym, word = sym[left], word[left]
        return out

    def _settle(self, out: list[bytes], word: np.ndarray, length: np.ndarray, sym: np.ndarray) -> None:
        """Stores the symbols of words that are done; those that are no pieces become byte pieces."""
        end = np.cumsum(length)
        raw = sym.astype("<u4").tobytes()
        for w, a, b in zip(word.tolist(), (4 * (end - length)).tolist(), (4 * end).tolist(), strict=True):
            out[w] = raw[a:b]
        for k in np.flatnonzero(np.maximum.reduceat(sym, end - length) >= self.n_pieces).tolist():
            out[word[k]] = np.array(self.ids(sym[end[k] - length[k] : end[k]]), "<u4").tobytes()

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.pairs.find((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))

    def _in_turn(self, spot: np.ndarray, sym: np.ndarray, word: np.ndarray, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Which merges may be done in this round: the first of each word, and those that no pair made before comes ahead of."""
        first = np.append(True, word[spot[1:]] != word[spot[:-1]])
        if first.all():
            return first
        n, made, r = len(sym), self.new[at[spot]], rank[spot]
        before = sym[np.maximum(spot - 1, 0)]
        joined = np.append(False, np.diff(spot) == 2)
        before[joined] = made[np.flatnonzero(joined) - 1]
        after = sym[np.minimum(spot + 2, n - 1)]
        has_before = (spot > 0) & (word[np.maximum(spot - 1, 0)] == word[spot])
        has_after = (spot + 2 < n) & (word[np.minimum(spot + 2, n - 1)] == word[spot])
        ahead = (has_before & (self.rank[self._pair(before, made)] <= r)) | (has_after & (self.rank[self._pair(made, after)] <= r))
        so_far = np.cumsum(ahead) - ahead
        return so_far == np.repeat(so_far[first], np.diff(np.append(np.flatnonzero(first), len(spot))))

    def ids(self, symbols: np.ndarray) -> list[int]:
        """Ids of symbols, of which those that are no pieces are spelt in bytes."""
        full = []
        for s in symbols.tolist():
            if s < self.n_pieces:
                full.append(s)
            else:
                c = chr(s - self.first_other) if s >= self.first_other else self.char_of[s]
                full += [self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")]
        return full

    def _split(self, text: str) -> list[str]:
        text = text.replace(SPACE, " ")
        return self.words.findall(" " + text if self.prefix else text) if text else []

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        split = [self._split(t or "") for t in texts]
        known = self.known
        seen = set().union(*split)
        new = list(seen.difference(known))
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = list(seen)
        known.update(zip(new, self.merge(new), strict=True))
        for words in split:
            yield np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4").tolist()

    # -- decoding -------------------------------------------------------------
    def _surface(self, ids: list[int]) -> str:
        """Text of ids, spaces for the space mark; runs of byte pieces are decoded as UTF-8, bad bytes one by one."""
        parts, run = [], bytearray()
        for i in ids:
            if i in self.id_byte:
                run.append(self.id_byte[i])
                continue
            if run:
                parts.append(_utf8(bytes(run)))
                run.clear()
            if i in self.unknown:
                parts.append(" ⁇ ")
            elif i not in self.silent:
                parts.append(self.piece[i].replace(SPACE, " "))
        if run:
            parts.append(_utf8(bytes(run)))
        return "".join(parts)

    def decode(self, ids: list[int]) -> str:
        """The first piece loses its leading space mark (the dummy prefix), a leading byte piece doesn't."""
        try:
            surface = b"".join(map(self.raw.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            surface = self._surface(ids)
        return surface[1:] if self.prefix and surface.startswith(" ") and ids[0] not in self.id_byte else surface


def _utf8(raw: bytes) -> str:
    """Each byte that starts no whole character becomes one replacement character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_documents(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with ids (array of int) of each whole text."""

    def make():
        c = codec(tokenizer_path(path, "piece_bpe_32k.model"))
        return lambda texts: {"ids": list(c.encode(texts))}

    return map_texts(df, text_col, [T.StructField("ids", T.ArrayType(T.IntegerType()))], make)


def decode_documents(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with decoded (string), the text of its ids."""

    def make():
        c = codec(tokenizer_path(path, "piece_bpe_32k.model"))
        return lambda rows: {"decoded": [c.decode(r or []) for r in rows]}

    return map_texts(df, ids_col, [T.StructField("decoded", T.StringType())], make)


def codec_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""

    def make():
        c = codec(tokenizer_path(path, "piece_bpe_32k.model"))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

        def run(texts):
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for ids in c.encode(texts):
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(sha(",".join(map(c.id_text.__getitem__, ids))))
                out["decoded_sha256"].append(sha(c.decode(ids)))
            return out

        return run

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_texts(docs.select("doc_id", F.col("text")), "text", fields, make).drop("text")
