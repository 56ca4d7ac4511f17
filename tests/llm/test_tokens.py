"""SentencePiece codec, token files and token counts against the libraries."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from glyphline.llm import sentencepiece_codec, token_counts, token_output
from glyphline.llm.common import fresh_dir
from tests.llm.rows import ODD, no_documents, odd_documents, odd_rows, prose, rowset


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def strange_texts(n: int) -> list[str]:
    rng = random.Random(n)
    alphabet = [*"abcdeghinorst  \n▁<>|'.-09éßñ", "ing", " the", "  ", "日", "🙂", " ", "\t", "\x00", "ы", "Ж", " ", "...", "==="]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_piece_ids_and_texts_are_those_of_the_library(pieces):
    codec = sentencepiece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t for t in ODD if t is not None] + strange_texts(800) + [prose(random.Random(1), 3000), "ab" * 5000]
    want = [pieces.encode(t) for t in texts]
    got = list(codec.encode(texts))
    for t, w, g in zip(texts, want, got, strict=True):
        assert g == w, t[:80]
        assert codec.decode(g) == pieces.decode(w), t[:80]


def test_codec_report(spark, pieces):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text, *_ in odd_rows():
        ids = pieces.encode(text or "")
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(pieces.decode(ids))))
    got = sentencepiece_codec.codec_report(odd_documents(spark))
    assert rowset(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert sentencepiece_codec.codec_report(no_documents(spark)).count() == 0


def test_encode_then_decode_documents(spark, pieces):
    docs = odd_documents(spark).select("doc_id", "text")
    out = sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(docs)).collect()
    assert len(out) == len(odd_rows())
    for r in out:
        assert r["ids"] == pieces.encode(r["text"] or "") and r["decoded"] == pieces.decode(r["ids"])


def test_counts_are_those_of_the_library(spark, bpe):
    merger = token_counts.PairMerger(public_tokenizers.path("byte_bpe_50k.json"))
    for t in [x for x in ODD if x] + strange_texts(800) + ["ab" * 4000, prose(random.Random(2), 2000)]:
        assert merger.count(t) == len(bpe.encode(t, add_special_tokens=False).ids), t[:80]
    want = []
    for doc_id, text, *_ in odd_rows():
        n = len(bpe.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 1024))
    got = token_counts.token_report(odd_documents(spark))
    assert rowset(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts.token_report(no_documents(spark)).count() == 0


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("top", [0, 200, 50_257, 2**32 - 1])
def test_planes_round_trip(planes, top):
    ids = np.random.default_rng(top).integers(0, top + 1, 5000, dtype=np.uint64).astype("<u4")
    assert (token_output.from_planes(token_output.to_planes(ids, planes), len(ids), planes) == ids).all()


def _in_order(rows):
    """By id, null first; ties among equal ids may come in any order of the text, so tests compare sets of them."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_files_hold_the_ids(spark, bpe, planes, tmp_path):
    docs = odd_documents(spark)
    folder = fresh_dir(spark, "plane-test")
    manifest = token_output.write_plane_files(docs, folder, planes=planes, block=512)
    got = _in_order(map(tuple, token_output.read_plane_files(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    want = {}
    for doc_id, text, *_ in odd_rows():
        ids = [*bpe.encode(text or "", add_special_tokens=False).ids, 2]
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have = {}
    for doc_id, _, n, crc in got:
        have.setdefault(doc_id, []).append((n, crc))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    starts = sorted((s, n) for _, s, n, _ in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    assert [s for _, s, _, _ in sorted(got, key=lambda r: r[1])] == [s for s, _ in starts]
    by_start = [d for d, *_ in sorted(got, key=lambda r: r[1])]
    assert by_start == sorted(by_start, key=lambda d: (d is not None, d or 0))
    assert sum(m["n_docs"] for m in manifest) == len(got)


def test_random_access_and_damage(tmp_path):
    import pyarrow as pa

    path = str(tmp_path / "x.gpz")
    ids = np.arange(10_000, dtype="<u4")
    with pa.OSFile(path, "wb") as sink:
        writer = token_output.PlaneWriter(sink, block=1000)
        for a in range(0, 10_000, 77):
            writer.add(a, ids[a : a + 77])
        writer.close()
    with pa.OSFile(path) as source:
        reader = token_output.PlaneReader(source)
        assert (reader.ids(1990, 2500) == ids[1990:4490]).all() and len(reader.ids(10_000, 5)) == 0
    data = open(path, "rb").read()
    with pytest.raises(Exception):  # noqa: B017
        token_output.PlaneReader(pa.BufferReader(data[:-100]))


def test_token_output_of_nothing(spark):
    assert token_output.round_trip(no_documents(spark).select("doc_id", "text")).count() == 0
