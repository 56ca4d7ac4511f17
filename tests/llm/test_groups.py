"""SimHash classes, shards, mixtures and the pipeline against brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

from glyphline.llm import language_id, mixing, sharding, simhash
from tests.llm.rows import SCHEMA, no_documents, odd_documents, odd_rows, prose, rowset
from tests.llm.test_texts import SPACES

WHITE = SPACES


# -- SimHash ------------------------------------------------------------------------
def fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in WHITE.split(lowered) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(points, radius=4):
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(points))]


def expected(rows):
    prints = [fingerprint(t) for _, t, *_ in rows]
    known = sorted(set(prints))
    of = dict(zip(known, classes(known), strict=True))
    least = {}
    for (d, *_), p in zip(rows, prints, strict=True):
        if d is not None:
            least[of[p]] = min(d, least.get(of[p], d))
    return sorted(((d, f"{p:016x}", least.get(of[p])) for (d, *_), p in zip(rows, prints, strict=True)), key=repr)


def test_classes_of_odd_documents(spark):
    got = simhash.near_duplicate_report(odd_documents(spark))
    assert rowset(got, "doc_id", "fingerprint", "component_id") == expected(odd_rows())
    assert simhash.near_duplicate_report(no_documents(spark)).count() == 0


def test_classes_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = rowset(simhash.near_duplicate_report(docs), "doc_id", "fingerprint", "component_id")
    assert got == expected([tuple(r) for r in docs.collect()])


def clustered(seed, n=1500):
    rng = random.Random(seed)
    points = set()
    while len(points) < n:
        p = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 40])):
            points.add(p)
            for _ in range(rng.randrange(1, 6)):
                p ^= 1 << rng.randrange(64)
    return sorted(points)[:n]


def signed(p):
    return p - (1 << 64) if p >> 63 else p


@pytest.mark.parametrize("seed,shard", [(1, simhash.SHARD), (2, simhash.SHARD), (3, 16)])
def test_links_join_whole_classes(spark, seed, shard, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", shard)
    points = clustered(seed, 3000)
    roots = simhash.components(simhash.link(spark.createDataFrame([(signed(p),) for p in points], "fp long"))).collect()
    have = {r["node"]: r["root"] for r in roots}
    groups = defaultdict(set)
    for p, w in zip(points, classes(points), strict=True):
        groups[w].add(have.get(signed(p), signed(p)))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def joined(points, links):
    index, root = {p: i for i, p in enumerate(points)}, list(range(len(points)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in zip(*[x.tolist() for x in links], strict=True):
        assert (a ^ b).bit_count() <= simhash.RADIUS
        root[find(index[a])] = find(index[b])
    return [find(i) for i in range(len(points))]


def same_classes(a, b):
    return len(set(a)) == len(set(b)) == len(set(zip(a, b, strict=True)))


def test_local_tree_finds_the_classes_of_a_large_shard():
    points = clustered(9, 3000)
    links = simhash.forest(np.array(points, np.uint64))
    assert same_classes(joined(points, links), classes(points)) and len(links[0]) == len(points) - len(set(classes(points)))


@pytest.mark.parametrize("most", [2, 8, 1000])
def test_trees_of_any_depth_lose_no_link(most):
    # near copies that agree in whole projections, so that the shards' trees go on by whole fingerprints, with guests
    rng = random.Random(most)
    base = rng.getrandbits(64)
    dense = sorted({base ^ sum(1 << b for b in rng.sample(range(20), rng.randrange(12))) for _ in range(1500)})
    points = sorted({*clustered(7, 1500), *dense})
    array = np.array(points, np.uint64)
    tree = simhash.ShardTree.grow(array[::2], most)
    at, shard, projection = tree.seats(array)
    assert set(zip(at.tolist(), projection.tolist(), strict=True)) == {(i, k) for i in range(len(points)) for k in range(15)}
    tally = {}
    links = simhash.shard_links(array[at], shard, projection, tally=tally)
    assert same_classes(joined(points, links), classes(points))
    assert tally["pruned"] > 0 and (most > 2 or len(at) > 15 * len(points))


def test_dense_groups_send_no_pairs():
    rng = random.Random(5)
    base = rng.getrandbits(64)
    points = np.array(sorted({base ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(6000)}), np.uint64)
    links = simhash.forest(points)
    assert len(links[0]) == len(points) - 1


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i + 1, i) for i in range(0, 200)] + [(1000 + i, 1000) for i in range(1, 300)] + [(3001, 3000), (3003, 3002), (3003, 3000)]
    edges = [(max(a, b), min(a, b)) for a, b in edges]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "hi long, lo long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300)) and {got[k] for k in range(3000, 3004)} == {3000}


# -- shards -------------------------------------------------------------------------
def check_shards(rows, got, shards=24, even=None):
    want = sorted(((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == want
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    if even:
        assert max(sizes.values()) <= even * sum(sizes.values()) / shards
    return sizes


def test_shards_of_odd_documents(spark):
    got = sharding.shard_report(odd_documents(spark)).collect()
    check_shards(odd_rows(), got)
    assert {r["law"] for r in got} == {"bytes"}
    assert sharding.shard_report(no_documents(spark)).count() == 0


def test_shards_come_out_even(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, int(rng.paretovariate(1.2) * 10) + 1)[:60_000], "en", "web", 0) for i in range(6000)]
    hot = prose(rng, 80)
    rows += [(10_000 + i, hot, "en", "web", 0) for i in range(3000)]
    got = sharding.shard_report(spark.createDataFrame(rows, SCHEMA)).collect()
    check_shards(rows, got, even=1.02)
    for measure in (lambda r: r["n_words"], lambda r: 1):  # jointly: words and rows come out even too
        held = Counter()
        for r in got:
            held[r["shard"]] += measure(r)
        assert max(held.values()) <= 1.03 * sum(held.values()) / 24 and min(held.values()) >= 0.95 * sum(held.values()) / 24


def test_groups_up_to_a_shard_stay_whole_and_larger_ones_are_split(spark):
    rng = random.Random(12)
    rows = [(None, prose(rng, 60), "en", "web", 0) for _ in range(4600)]
    most, some = prose(rng, 61), prose(rng, 62)
    rows += [(None, most, "en", "web", 0)] * 600 + [(5, some, "en", "web", 0)] * 180  # 2.6 shards and 0.8 of one
    got = sharding.shard_report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    check_shards(rows, got, even=1.05)
    where = defaultdict(Counter)
    for r in got:
        where[r["text_crc32"]][r["shard"]] += 1
    assert len(where[zlib.crc32(some.encode())]) == 1
    split = where[zlib.crc32(most.encode())]
    assert len(split) > 2 and max(split.values()) < 300  # null ids are spread as well
    assert all(len(s) == 1 for c, s in where.items() if c != zlib.crc32(most.encode()))


def test_equal_texts_stay_together(spark):
    rng = random.Random(8)
    texts = [prose(rng, 40) for _ in range(500)]
    rows = [(i, texts[i % 500], "en", "web", 0) for i in range(2000)]
    where = defaultdict(set)
    for r in sharding.shard_report(spark.createDataFrame(rows, SCHEMA)).collect():
        where[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tail_is_placed_by_rows_and_words_too(seed):
    g = np.random.default_rng(seed)
    rows, words = g.poisson(20, 12_288) + 1.0, g.gamma(2, 2000, 12_288).round()
    vectors = np.stack([(words * g.uniform(5, 7, 12_288)).round(), words, rows], 1)
    at = sharding.place(vectors, 24)
    share = np.array([vectors[at == k].sum(0) for k in range(24)]) / (vectors.sum(0) / 24)
    assert 0.997 < share.min() and share.max() < 1.003


# -- mixtures -----------------------------------------------------------------------
def size_of(text):
    return len([w for w in WHITE.split(text or "") if w])


def want_targets(sizes):
    names = sorted(n for n in sizes if n is not None) + [n for n in sizes if n is None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, capped = {}, set()
    while True:
        free = [n for n in names if n not in capped]
        left = sum(sizes.values()) - sum(3 * sizes[n] for n in capped)
        target = {n: 3 * sizes[n] if n in capped else left * weight[n] / sum(weight[m] for m in free) for n in names}
        over = [n for n in free if target[n] > 3 * sizes[n]]
        if not over:
            return target
        capped |= set(over)


def check_mix(rows, got, near):
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += size_of(t)
    target, taken = want_targets(sizes), Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) <= 1e-6 * max(1, target[r["source"]])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= near(target[s]), (s, taken[s], target[s])
    assert sorted((r["size"] for r in got)) == sorted(size_of(t) for _, t, *_ in rows)


def test_mixture_of_odd_documents(spark):
    rows = odd_rows()
    got = mixing.mix_report(odd_documents(spark)).collect()
    # one text holds most of a source: no copies of whole texts come nearer than its size
    check_mix(rows, got, lambda t: max(r["size"] for r in got))
    again = mixing.mix_report(odd_documents(spark).repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix_report(no_documents(spark)).count() == 0


def test_mixture_meets_its_targets(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, int(rng.paretovariate(1.3) * 20)), "en", rng.choice(["a"] * 12 + ["b", "b", "c", "d", "", None]), 0) for i in range(4000)]
    got = mixing.mix_report(spark.createDataFrame(rows, SCHEMA)).collect()
    check_mix(rows, got, lambda t: max(0.005 * t, 3))


def test_hot_classes_and_equal_rows_are_cut(spark):
    # a third of the rows are one text, partly without an id; one source holds all but a few
    rng = random.Random(31)
    hot = prose(rng, 25)
    rows = [(k if k % 2 else None, hot, "en", "a", 0) for k in range(900)] + [(k, prose(rng, rng.randrange(1, 60)), "en", rng.choice("aaaab"), 0) for k in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_report(docs).collect()
    check_mix(rows, got, lambda t: 3)
    again = mixing.mix_report(docs.repartition(6)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_targets_share_out_the_excess():
    for sizes in ({"a": 10, "b": 1, "c": 1000}, {"a": 0, "b": 5}, {"x": 7}, {None: 3, "z": 30, "y": 300, "w": 1}):
        got, want = mixing.targets(sizes), want_targets(sizes)
        assert all(abs(got[k] - want[k]) < 1e-6 for k in sizes)
    assert mixing.targets({}) == {}


# -- pipeline -----------------------------------------------------------------------
def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, held = docs.columns, []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != cp.STAGES[-1][0]:
            assert out.columns == columns
        out = spark.createDataFrame(out.collect(), out.schema)
        held.append(out)
        docs = out
    language, judged, unique, mixed, encoded = held
    assert judged.join(language, "doc_id", "left_anti").count() == 0
    assert 0 < judged.count() <= language.count()
    # one document of each class stays, the first
    rows = [tuple(r) for r in judged.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted({c for _, _, c in expected(rows)})
    # the mixture repeats documents as its rates say
    copies = Counter(r["doc_id"] for r in mixed.collect())
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(unique).collect() if r["copies"]}
    assert dict(copies) == want and max(copies.values()) <= 3
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    n = {r["doc_id"]: len(pieces.encode(r["text"])) for r in mixed.collect()}
    assert sorted((r["doc_id"], r["n_tokens"]) for r in encoded.collect()) == sorted((d, n[d]) for d in copies.elements())


def test_pipeline_of_odd_documents(spark, tmp_path):
    import corpus_pipeline as cp

    docs = odd_documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = cp.run(spark, str(tmp_path)).collect()
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    # what comes out are the rows that the stages leave, and columns of clashing names keep their values on the way
    held = docs
    for name, stage in cp.STAGES[:-1]:
        held = spark.createDataFrame(stage(spark, held, str(tmp_path)).collect(), docs.schema)
        assert held.columns == docs.columns
        own = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
        assert all(r[c] == f"own {c}" for r in held.collect() for c in own), name
    want = sorted(((r["doc_id"], len(pieces.encode(r["text"]))) for r in held.collect()), key=repr)
    assert want and rowset(spark.createDataFrame(out), "doc_id", "n_tokens") == want
    no_documents(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert cp.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_language_against_counting(spark, sf_dir):
    """The first stage keeps the documents whose language has half of the evidence, by trees counted in dicts."""
    import corpus_pipeline as cp

    rows = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r["text"] or "") < 4000]
    docs = spark.createDataFrame(rows, SCHEMA)
    order, counts = language_id.ORDER, {}
    for r in rows:
        if r["lang"] and (r["text"] or "").strip(" ") and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            raw, own = language_id.folded(r["text"]), counts.setdefault(r["lang"], [{} for _ in range(order + 1)])
            for i in range(order, len(raw)):
                for o in range(order + 1):
                    own[o].setdefault(raw[i - o : i], Counter())[raw[i]] += 1
    totals = {lang: [{c: (sum(n.values()), len(n)) for c, n in trees.items()} for trees in own] for lang, own in counts.items()}

    def bits(lang, raw):
        out = 0.0
        for i in range(order, len(raw)):
            for o in range(order, -1, -1):
                c = raw[i - o : i]
                seen = counts[lang][o].get(c)
                if seen is None:
                    continue
                total, distinct = totals[lang][o][c]
                if raw[i] in seen:
                    out -= math.log2(seen[raw[i]] / (total + distinct))
                    break
                out -= math.log2(distinct / (total + distinct))
            else:
                out += 8
        return out

    want, unsure = set(), set()
    for r in rows:
        if any(c.isalpha() for c in r["text"] or ""):
            raw = language_id.folded(r["text"])
            lengths = [bits(lang, raw) for lang in counts]
            weight = min(1.0, language_id.EVIDENCE / (len(raw) - order))
            score = 1 / sum(2 ** (-(x - min(lengths)) * weight) for x in lengths)
            (unsure if abs(score - cp.MIN_SCORE) < 0.01 else want if score > cp.MIN_SCORE else set()).add(r["doc_id"])
    got = {r["doc_id"] for r in cp.identify_language(spark, docs, sf_dir).collect()}
    assert got - unsure == want and len(got) > len(rows) / 2


def reused_ids():
    """Different texts without an id and with a reused one; classes of such rows alone; equal rows."""
    rng = random.Random(21)
    texts = [prose(rng, 60 + k) for k in range(30)]
    rows = [(None, t, "en", "web", len(t)) for t in texts[:10]]
    rows += [(None, texts[0], "fr", None, 1), (None, texts[0], None, "fr", 1), (None, texts[1].upper(), "en", "web", 1), rows[2], rows[2]]
    rows += [(7, t, "en", "books", len(t)) for t in texts[10:20]] + [(7, texts[10], "en", "web", 1), (8, texts[11], "en", "web", 1)]
    rows += [(k, t, "en", "books", len(t)) for k, t in enumerate(texts[20:])] + [(None, texts[20], "en", "web", 0), (7, texts[25], "en", "books", 0)]
    rng.shuffle(rows)
    return rows


def test_pipeline_keeps_a_row_of_each_class_whatever_its_id(spark):
    import corpus_pipeline as cp

    rows = reused_ids()
    docs = spark.createDataFrame(rows, SCHEMA)
    prints = [fingerprint(t) for _, t, *_ in rows]
    known = sorted(set(prints))
    of = dict(zip(known, classes(known), strict=True))
    held = defaultdict(list)
    for r, p in zip(rows, prints, strict=True):
        held[of[p]].append(r)
    runs = [[tuple(r) for r in cp.drop_near_duplicates(spark, docs.repartition(n), "").collect()] for n in (1, 5)]
    assert sorted(map(repr, runs[0])) == sorted(map(repr, runs[1]))
    got = {of[fingerprint(r[1])]: r for r in runs[0]}
    assert len(runs[0]) == len(got) == len(held) >= 30
    for c, r in got.items():
        assert r in held[c] and r[0] == min((x[0] for x in held[c] if x[0] is not None), default=None)


def test_pipeline_mixes_rows_whatever_their_id(spark):
    import corpus_pipeline as cp

    docs = spark.createDataFrame(reused_ids(), SCHEMA)
    got = Counter(map(tuple, cp.mix_sources(spark, docs, "").collect()))
    want = Counter()
    for r in mixing.mix(docs, keep=("text", "lang", "n_chars")).collect():
        want[r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]] += r["copies"]
    assert got == +want


def test_pipeline_quality_and_mixture_against_brute_force(spark, sf_dir):
    import corpus_pipeline as cp
    import duckdb

    from glyphline.llm import quality

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    kept = con.execute(f"SELECT doc_id FROM ({quality.SQL}) WHERE kept").fetchall()
    assert sorted(r["doc_id"] for r in cp.apply_quality_rules(spark, docs, sf_dir).select("doc_id").collect()) == sorted(d for (d,) in kept)
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()]
    taken = Counter(r["doc_id"] for r in cp.mix_sources(spark, docs, sf_dir).select("doc_id").collect())
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += size_of(t)
    target = want_targets(sizes)
    got = [{"source": s, "size": size_of(t), "taken": taken[d] * size_of(t), "source_size": sizes[s], "target": target[s]} for d, t, _, s, _ in rows]
    check_mix(rows, got, lambda t: max(r["size"] for r in got))
