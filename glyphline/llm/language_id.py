"""Language identification by prediction by partial matching.

For every language a context tree of bytes up to order ``ORDER`` is counted on a
bounded sample of labelled rows and then frozen. A byte is coded in its longest
known context; a context in which it is new costs an escape (method C: distinct
successors over total plus distinct) and leads to the next shorter one, the last
resort being 8 bits. The language with the shortest code of the whole text is
predicted, ties going to the first name.

With frozen counts the code length of a byte depends on the byte and the
``ORDER`` bytes before it only, so the trees are flattened: a table an order from
gram to the code lengths under all languages (in 2**-16 bits, so sums are exact),
and one from context to escape lengths. A batch of texts is scored by a few array
lookups. Texts are lower-cased, ASCII non-letters count as spaces.

Null texts and texts without a letter are ``und`` with score 0; so is everything
if nothing can be learned from. Empty table: no rows. Repeated rows and equal texts: equal results; ids are carried as they
are. Whole texts are scored, however long. Columns named lang_pred or score are replaced, others stay (identify) or
aren't read (language_report).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphline.llm.common import map_texts
from glyphline.llm.tables import KeyTable

ORDER = 4
#: Bounds of the training sample: rows of a language, bytes of a row, bytes in all (equally shared by the languages).
TRAIN_ROWS, TRAIN_ROW_BYTES, TRAIN_BYTES = 300, 65_536, 64 << 20
MAX_LANGUAGES = 512
UNKNOWN = "und"
UNIT = 1 << 16
#: A text counts as so many bytes of evidence at most in the score.
EVIDENCE = 64

_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def folded(text: str) -> bytes:
    return b" " * ORDER + text.lower().encode("utf-8", "replace").translate(_FOLD)


def has_letter(text: str | None) -> bool:
    return bool(text) and next((True for c in text if c.isalpha()), False)


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """Grams of ``n`` bytes that end at each position from ORDER on, as integers."""
    out = np.zeros(len(data) - ORDER, np.uint64)
    for k in range(n):
        at = ORDER - n + 1 + k
        out = (out << np.uint64(8)) | data[at : at + len(out)].astype(np.uint64)
    return out


@dataclass
class Ppm:
    """Frozen statistics of all languages."""

    languages: list[str]
    grams: list[np.ndarray]  # by order, sorted
    codes: list[np.ndarray]  # (grams, languages), in UNIT bits
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def __post_init__(self):
        self.tables = None

    @classmethod
    def train(cls, samples: dict[str, list[str]]) -> Ppm:
        languages = sorted(samples)
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for lang in languages:
            arrays = [np.frombuffer(folded(t), np.uint8) for t in samples[lang]]
            counts.append([np.unique(np.concatenate([_grams(a, o + 1) for a in arrays]), return_counts=True) for o in range(ORDER + 1)])
        model = cls(languages, [], [], [], [])
        for o in range(ORDER + 1):
            keys = np.unique(np.concatenate([c[o][0] for c in counts]))
            above = np.unique(keys >> np.uint64(8))
            codes, escapes = np.zeros((len(keys), len(languages))), np.zeros((len(above), len(languages)))
            if o:
                shorter = keys & np.uint64((1 << 8 * o) - 1)
                lower = model.codes[o - 1][np.searchsorted(model.grams[o - 1], shorter)]
            else:
                lower = np.full((len(keys), len(languages)), 8.0)
            for k, c in enumerate(counts):
                seen, n = c[o]
                ctx, first, distinct = np.unique(seen >> np.uint64(8), return_index=True, return_counts=True)
                total = np.add.reduceat(n, first)
                at = np.searchsorted(above, ctx)
                escapes[at, k] = -np.log2(distinct / (total + distinct))
                codes[:, k] = lower[:, k] + escapes[np.searchsorted(above, keys >> np.uint64(8)), k]
                codes[np.searchsorted(keys, seen), k] = -np.log2(n / np.repeat(total + distinct, distinct))
            model.grams.append(keys)
            model.codes.append(codes)
            model.contexts.append(above)
            model.escapes.append(escapes)
        fixed = lambda xs: [np.rint(x * UNIT).astype(np.int32) for x in xs]
        model.codes, model.escapes = fixed(model.codes), fixed(model.escapes)
        return model

    def lengths(self, texts: list[str], cells: int = 8_000_000) -> np.ndarray:
        """Code length of each text under each language, in UNIT bits (int64)."""
        if self.tables is None:
            self.tables = [KeyTable(g) for g in self.grams], [KeyTable(c) for c in self.contexts]
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        step = max(1 << 12, cells // max(1, len(self.languages)))
        held, size = [], 0
        for i, t in enumerate(texts):
            raw = folded(t)
            for a in range(ORDER, len(raw), step):  # parts of a long text, each with the bytes before it
                part = np.frombuffer(raw, np.uint8, min(step, len(raw) - a) + ORDER, a - ORDER)
                if size and size + len(part) > step:
                    self._add(held, out)
                    held, size = [], 0
                held.append((i, part))
                size += len(part)
        if held:
            self._add(held, out)
        return out

    def _add(self, parts: list[tuple[int, np.ndarray]], out: np.ndarray) -> None:
        grams, contexts = self.tables
        keys = np.concatenate([_grams(p, ORDER + 1) for _, p in parts])
        starts = np.cumsum([0, *[len(p) - ORDER for _, p in parts[:-1]]])
        rows = [i for i, _ in parts]
        bits = np.zeros((len(keys), len(self.languages)), np.int32)
        todo = np.arange(len(keys))
        for o in range(ORDER, -1, -1):
            at = grams[o].find(keys)
            known = at >= 0
            bits[todo[known]] += self.codes[o][at[known]]
            todo, keys = todo[~known], keys[~known]
            if not len(todo):
                break
            up = contexts[o].find(keys >> np.uint64(8))
            seen = up >= 0
            bits[todo[seen]] += self.escapes[o][up[seen]]
            keys = keys & np.uint64((1 << 8 * o) - 1)
        bits[todo] += 8 * UNIT
        np.add.at(out, rows, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if has_letter(t)]
        if not at or not self.languages:
            return names, scores
        sizes = np.array([len(folded(texts[i])) - ORDER for i in at])
        bits = self.lengths([texts[i] for i in at])
        best = bits.argmin(1)
        weight = np.minimum(1.0, EVIDENCE / sizes) / UNIT
        share = 1 / np.exp2(-(bits - bits.min(1, keepdims=True)) * weight[:, None]).sum(1)
        for i, b, s in zip(at, best.tolist(), share.tolist(), strict=True):
            names[i], scores[i] = self.languages[b], s
        return names, scores


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, rows: int = TRAIN_ROWS, row_bytes: int = TRAIN_ROW_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Ppm:
    """Statistics from at most ``rows`` whole texts of each language, of at most ``row_bytes`` bytes each.

    Held-out rows are never read. The sample is the rows of lowest hash, so it is
    the same in each run; it is cut by a hash threshold before anything moves. What reaches the
    driver follows ``TRAIN_BYTES``, whatever the number of languages; more than
    ``MAX_LANGUAGES`` are an error, since tables of code lengths have a column a language: split the labels then.
    """
    known = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("train"), F.col(id_col), F.col(text_col)).alias("h")
    ).where((F.octet_length("text") <= row_bytes) & (F.length(F.trim("text")) > 0))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Ppm([], [], [], [], [])
    unit = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    limit = F.lit(None).cast("double")
    for r in sizes:
        share = min(1.3 * rows / r["n"] + 10 / r["n"], TRAIN_BYTES / len(sizes) / r["b"])
        limit = F.when(F.col("lang") == r["lang"], F.lit(share)).otherwise(limit)
    found: dict[str, list] = {}
    for r in known.where(unit < limit).collect():
        found.setdefault(r["lang"], []).append((r["h"] & (1 << 64) - 1, r["text"]))
    return Ppm.train({lang: [t for _, t in sorted(set(x))[:rows]] for lang, x in found.items()})


def identify(docs: DataFrame, model: Ppm, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def make():
        m = shared.value

        def run(texts):
            names, scores = m.predict(texts)
            return {"lang_pred": names, "score": scores}

        return run

    return map_texts(docs, text_col, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make, 256)


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    return identify(docs.select("doc_id", "text"), learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
