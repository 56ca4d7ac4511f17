"""Chat formatting, fingerprints, language, quality against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import pytest
import xxhash

from glyphline.llm import chat, fingerprints, language_id, quality
from glyphline.llm.common import WORD
from tests.llm.rows import no_documents, odd_documents, odd_rows, prose, rowset

SPACES = re.compile("[\x20\x09-\x0d]+")


# -- chats ----------------------------------------------------------------------
TURNS = [
    (1, 1, "user", "hi"), (1, 2, "assistant", "hello"),
    (2, 1, "user", "hi"), (2, 2, "assistant", "hello"), (2, 3, "user", "more"),
    (3, 1, "user", "hi"), (3, 2, "assistant", "hello"), (3, 3, "user", "more"),
    (4, 1, "user", "hi"), (4, 2, "assistant", "other"),
    (5, 1, None, "hi"), (5, 2, "assistant", None), (6, 1, "", "hi"), (6, 2, "assistant", ""),
    (7, None, "system", "s"), (7, 1, "user", "q"), (8, 1, "user", "q"), (8, 1, "user", "q"),
    (None, 1, "user", "nobody"), (None, 2, "user", "nobody"), (None, 1, "user", "hi"), (None, 1, "user", "x" * 100_000), (None, 5, None, None), (None, None, "user", "y" * 200_000), (9, 2, "user", "hi"), (10, 1, "user", "hi"), (11, 1, "user", ""), (12, 1, "user", "x" * 100_000),
]


def maximal_chats(turns):
    low = lambda x: (x is not None, x)
    by = {}
    for i, (c, t, r, x) in enumerate(turns):
        by.setdefault((i,) if c is None else c, []).append((low(t), low(r), low(x), r, x))
    own = {c: tuple(x[3:] for x in sorted(v, key=lambda x: (x[0][0], x[0][1] or 0, x[1][0], x[1][1] or "", x[2][0], x[2][1] or ""))) for c, v in by.items()}
    longer = {own[c][:k] for c in own for k in range(1, len(own[c]))}
    first = {}
    for c in sorted(own, key=lambda c: (isinstance(c, tuple), c if isinstance(c, int) else 0)):
        first.setdefault(own[c], []).append(c)
    return sorted(
        ((None if isinstance(cs[0], tuple) else cs[0], len(t), len(cs), "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in t)) for t, cs in first.items() if t not in longer),
        key=repr,
    )


def test_only_maximal_conversations_stay(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    clash = turns.selectExpr("*", "'a' AS pos", "'b' AS h1", "'c' AS kept_id", "'d' AS n_copies", "'e' AS last")
    assert rowset(chat.format_chats(clash), "conv_id", "n_turns", "n_copies", "chat") == maximal_chats(TURNS)
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_many_turns_without_an_id_are_spread(spark):
    turns = spark.range(20_000).selectExpr("IF(id % 3 = 0, id, NULL) AS conv_id", "1L AS turn", "'user' AS role", "CONCAT('m', id % 9000) AS text")
    got = chat.format_chats(turns)
    assert got.agg({"n_copies": "sum"}).first()[0] == 20_000 and got.count() == 9000
    alone = spark.createDataFrame([(None, t, "user", f"m{t}") for t in range(3000)], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(alone).where("conv_id IS NULL AND n_turns = 1 AND n_copies = 1").count() == 3000


def test_chat_sql(spark, tmp_path):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    turns.toPandas().to_parquet(tmp_path / "c.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM read_parquet('{tmp_path}/c.parquet')")
    assert sorted(con.execute(chat.SQL).fetchall(), key=repr) == maximal_chats(TURNS)


def test_many_snapshots(spark):
    rng = random.Random(5)
    turns = []
    for c in range(300):
        for t in range(rng.randrange(1, 7)):
            turns.append((c, t, "user" if t % 2 == 0 else "assistant", f"m{rng.randrange(2)}"))
    got = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert rowset(got, "conv_id", "n_turns", "n_copies", "chat") == maximal_chats(turns)


# -- fingerprints -----------------------------------------------------------------
def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(*xs):
    seed = 42
    for x in xs:
        data = x.encode("utf-8", "surrogatepass") if isinstance(x, str) else struct.pack("<q", x)
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def order_minhash(text):
    """Slot codes, straight from the definition."""
    words = [spark_hash(w) for w in SPACES.split(text) if w]
    kmers = [spark_hash(*words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else ([spark_hash(*words)] if words else [])
    seen, slots = Counter(), {}
    low = (1 << 30) - 1
    for i, k in enumerate(kmers):
        o = seen[k]
        seen[k] += 1
        h = (k if o == 0 else signed(xxhash.xxh64_intdigest(struct.pack("<i", o), xxhash.xxh64_intdigest(struct.pack("<q", k), 42)))) & ~low
        slots.setdefault((h & (1 << 64) - 1) >> 58, []).append((h | i, h >> 30, i))
    out = []
    every = sorted(x for own in slots.values() for x in own)
    for s, own in sorted(slots.items(), key=lambda x: x[0] ^ 32):  # signed order
        at = every.index(min(own))
        own = [every[at], every[(at + 1) % len(every)]][: len(every)]
        pair = [h for _, h, _ in sorted(own, key=lambda x: x[2])]
        code = xxhash.xxh64_intdigest(struct.pack("<q", pair[0]), 42)
        if len(pair) == 2:
            code = xxhash.xxh64_intdigest(struct.pack("<q", pair[1]), code)
        out.append((s, s * 65536 + (code >> 48)))
    return out


def test_fingerprints(spark):
    rows = odd_rows()
    got = fingerprints.fingerprint_report(odd_documents(spark)).collect()
    assert len(got) == len(rows)
    text_of = {}
    for doc_id, text, *_ in rows:
        text_of.setdefault(doc_id, []).append(text or "")
    prints = {}
    for r in got:
        for t in text_of[r["doc_id"]]:
            if len(set(text_of[r["doc_id"]])) == 1:
                assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
                assert r["fingerprint"] == "".join(f"{c:06x}" for _, c in order_minhash(t)), t[:60]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    # ids without ties: the edited text and likeness to the next document
    lone = sorted((d for d in text_of if d is not None))
    by_id = {r["doc_id"]: r for r in got}
    for d, e in zip(lone, lone[1:], strict=False):
        if len(text_of[d]) > 1 or len(set(text_of[e])) > 1:
            continue
        t, n = text_of[d][0], text_of[e][0]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        a, b, c = (dict(order_minhash(x)) for x in (t, n, edited))
        like = lambda x, y: sum(x[s] == y.get(s) for s in x) / len({*x, *y}) if x or y else 1.0
        r = by_id[d]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
        assert math.isclose(r["near_edited"], like(a, c)) and math.isclose(r["near_next"], like(a, b))


def test_order_matters_to_fingerprints(spark):
    words = [f"w{i}" for i in range(400)]
    halves = words[200:] + words[:200]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(halves)), (3, " ".join(words[:300] + words[320:]))], "doc_id long, text string")
    df = fingerprints.add_fingerprint(docs, "text", "f")
    f = {r["doc_id"]: dict(zip([c >> 16 for c in r["f"]], r["f"], strict=True)) for r in df.collect()}
    like = lambda a, b: sum(f[a][s] == f[b].get(s) for s in f[a]) / len({*f[a], *f[b]})
    assert like(1, 2) < 0.8 < like(1, 3) + 0.15  # the same k-mers in another order are less alike than a small cut


def test_short_texts_keep_their_order(spark):
    likes = []
    for k in range(20):
        words = [f"w{k}x{i}" for i in range(30)]
        docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[15:] + words[:15]))], "doc_id long, text string") if k == 0 else docs.union(
            spark.createDataFrame([(2 * k + 1, " ".join(words)), (2 * k + 2, " ".join(words[15:] + words[:15]))], "doc_id long, text string"))
    f = {r["doc_id"]: set(r["f"]) for r in fingerprints.add_fingerprint(docs.coalesce(2), "text", "f").collect()}
    for k in range(20):
        a, b = f[2 * k + 1], f[2 * k + 2]
        likes.append(len(a & b) / len({x >> 16 for x in a | b}))
    assert sum(likes) / 20 < 0.5


def test_rows_without_ids_or_of_one_id_are_spread(spark):
    rows = [(None if i % 3 else 7, prose(random.Random(i), 25)) for i in range(900)]
    rows = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = rows.selectExpr("doc_id", "text", "xxhash64(text) AS tie").selectExpr("*", "CONCAT(IF(doc_id IS NULL, '0', '17'), HEX(tie + 0)) AS key")
    seats = fingerprints._ranged(keyed, 8).groupBy("range").count().collect()
    assert len(seats) >= 6 and max(r["count"] for r in seats) < 300
    got = fingerprints.fingerprint_report(rows)
    assert got.count() == 900 and got.where("near_next IS NULL").count() == 0


def test_one_document_and_none(spark):
    assert fingerprints.fingerprint_report(no_documents(spark)).count() == 0
    r = fingerprints.fingerprint_report(spark.createDataFrame([(7, "one two three four")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"one two tone two t").hexdigest() and r["near_next"] == 1.0


def test_last_document_is_followed_by_the_first(spark):
    rows = [(i, prose(random.Random(i), 30)) for i in range(500)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        half = len(t) // 2
        edited = t[: len(t) - half] + rows[(i + 1) % 500][1][:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


# -- languages ----------------------------------------------------------------------
def code_length(samples, data):
    """Bits of ``data`` after each language's samples, by counting in dicts."""
    out = {}
    for lang, texts in samples.items():
        counts = [{} for _ in range(language_id.ORDER + 1)]
        for raw in map(language_id.folded, texts):
            for i in range(language_id.ORDER, len(raw)):
                for o in range(language_id.ORDER + 1):
                    counts[o].setdefault(raw[i - o : i], Counter())[raw[i]] += 1
        bits = 0.0
        for i in range(language_id.ORDER, len(data)):
            for o in range(language_id.ORDER, -1, -1):
                ctx = counts[o].get(data[i - o : i])
                if ctx is None:
                    continue
                total = sum(ctx.values()) + len(ctx)
                if data[i] in ctx:
                    bits -= math.log2(ctx[data[i]] / total)
                    break
                bits -= math.log2(len(ctx) / total)
            else:
                bits += 8
        out[lang] = bits
    return out


def test_code_lengths_are_those_of_the_trees():
    samples = {"en": ["the quick brown fox", "over the lazy dog there"], "fr": ["le renard brun été", "où est le chien"]}
    model = language_id.Ppm.train(samples)
    texts = ["the dog", "le chien été", "zzz qqq", "日本", "the " * 50]
    got = model.lengths(texts) / language_id.UNIT
    for t, row in zip(texts, got, strict=True):
        want = code_length(samples, language_id.folded(t))
        for lang, bits in zip(model.languages, row, strict=True):
            assert abs(bits - want[lang]) < 0.001 * len(language_id.folded(t)), (t, lang)


def test_long_texts_are_scored_whole():
    model = language_id.Ppm.train({"en": ["the quick brown fox"], "fr": ["le renard brun"]})
    text = "the fox le renard " * 400
    assert (model.lengths([text], cells=2 * 4096) == model.lengths([text])).all()


def test_language_report(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.language_report(docs).join(docs.select("doc_id", "text", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    right = seen = 0
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if r["held_out"] and r["lang"] and r["lang_pred"] != "und":
            seen += 1
            right += r["lang"] == r["lang_pred"]
    assert seen and right / seen >= 0.95


def test_languages_of_odd_documents(spark):
    texts = {}
    for doc_id, text, *_ in odd_rows():
        texts.setdefault(doc_id, set()).add(text)
    out = language_id.language_report(odd_documents(spark)).collect()
    assert len(out) == len(odd_rows())
    for r in out:
        if len(texts[r["doc_id"]]) == 1:
            (t,) = texts[r["doc_id"]]
            letters = any(c.isalpha() for c in t or "")
            assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
    assert language_id.language_report(no_documents(spark)).count() == 0


def test_training_is_bounded(spark, monkeypatch):
    rows = [(i, prose(random.Random(i), 50), f"l{i % 4}") for i in range(2000)] + [(9000 + i, "long " * 20_000, "l0") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = language_id.learn(docs)
    monkeypatch.setattr(language_id, "TRAIN_BYTES", 40_000)
    few = language_id.learn(docs)
    assert few.languages == whole.languages and 0 < len(few.grams[-1]) < len(whole.grams[-1])
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 3)
    with pytest.raises(ValueError, match="languages"):
        language_id.learn(docs)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language_id.language_report(docs).first()["lang_pred"] == "und"


# -- quality ------------------------------------------------------------------------
def measures(text):
    text = text or ""
    words = [w for w in SPACES.split(text) if w]
    lines = [x for x in text.split("\n") if SPACES.sub("", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    want = []
    for doc_id, text, *_ in odd_rows():
        m = measures(text)
        want.append((doc_id, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    report = quality.quality_report(odd_documents(spark))
    got = rowset(report, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(want, key=repr)
    assert report.where("base_failed AND kept").count() == 0
    assert quality.quality_report(no_documents(spark)).count() == 0


def test_order_of_rules_never_changes_the_verdict(spark):
    measured = quality.measure(odd_documents(spark))
    names = list(quality.rules())
    a = measured.withColumn("k", quality.cascade(names))
    b = measured.withColumn("k", quality.cascade(names[::-1]))
    assert rowset(a, "doc_id", "n_words", "k") == rowset(b, "doc_id", "n_words", "k")
    found = quality.survey(measured)
    assert sorted(r.name for r in found) == sorted(names) and all(r.seconds > 0 and 0 <= r.rejected <= 1 for r in found)
    assert [r.name for r in quality.survey(measured.limit(0))] == names


def test_every_rule_rejects_something_and_clean_texts_stay(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    body = lambda n, end: " ".join(word() + end(k) for k in range(n))
    stop = lambda k: "." if k % 8 == 7 else ""
    few = [word() + "." for _ in range(60)]
    made = {
        "symbols": body(60, lambda k: "%%%."), "menus": " | ".join(word() + "." for _ in range(60)), "few_letters": body(60, lambda k: "1234567890."),
        "repeated_lines": "\n".join([body(3, stop) + ".", "ab."][k % 2] for k in range(40)) + "\nab." * 20, "unpunctuated": body(60, lambda k: ""),
        "monotone": " ".join(few[(k * k + k // 7) % 17] for k in range(100)), "shouting": body(60, stop).upper(), "clean": body(200, stop),
    }
    docs = spark.createDataFrame(list(made.items()), "name string, text string")
    measured = quality.measure(docs).where("NOT base_failED")
    hits = {r["name"]: r for r in measured.select("name", *[c.alias(n) for n, c in quality.rules().items()]).collect()}
    for name in quality.rules():
        assert hits[name][name], name
        assert not hits["clean"][name]
    assert quality.judge(docs).where("kept").select("name").collect() == [("clean",)]


def test_quality_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = con.execute(quality.SQL).df()
    got = quality.quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).toPandas()
    cols = sorted(got.columns)
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))


def test_word_pattern():
    assert re.findall(WORD, "a b c\x1fd\x85e") == ["a b", "c\x1fd\x85e"]
