"""Each operator on small tables against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import brute_clause, brute_extract, brute_fingerprint, brute_knn, brute_language, brute_model, brute_overlap, brute_repeats
from tessera.llm import langid, ngram, suffix, toxicity, urls
from tessera.llm.decontamination import MASKS, Document, find_overlaps, longest, word_hashes
from tessera.llm.extraction import blocks, extract_text
from tessera.llm.knn import voronoi_knn
from tessera.llm.mixing import mix
from tessera.llm.simhash import fingerprint, local_links, simhash_groups

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, kept int, rank int, w int"
RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(150)]


def text(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


LONG = text(6000)
PASSAGE = text(70)
BASE = text(120)


def _rows():
    near = BASE.split()
    texts = [BASE, BASE, " ".join([*near[:60], "zz", *near[61:]]), " ".join(near[1:]), "", None, "  \n\t ", "one", "one two", "A-Z Ünïcode é 漢字 \U0001f600 " * 30, LONG, LONG + " tail", PASSAGE, text(30) + " " + PASSAGE + " " + text(20), text(40) + "\n" + PASSAGE]
    texts += [text(RNG.randint(1, 200)) for _ in range(25)] + ["the the the " * 200, "ab" * 400]
    out = [(i, t, ("en", "de", "fr", None)[i % 4], ("a", "b", None)[i % 3], len(t) if t else None, "x", 1, 2, 3) for i, t in enumerate(texts)]
    out += [out[0], out[13], (None, text(50), "en", None, 1, None, None, None, None)]
    return out


ROWS = _rows()


def rows():
    return ROWS


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_simhash(docs, none):
    got = simhash_groups(docs).collect()
    data = rows()
    fps = {r[0]: brute_fingerprint(r[1]) for r in data}
    ids = list(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                ra, rb = find(a), find(b)
                parent[ra] = rb
    want = {i: min((j for j in ids if find(j) == find(i) and j is not None), default=None) for i in ids}
    assert len(got) == len(data)
    for r in got:
        assert int(r.fingerprint, 16) == fps[r.doc_id] and r.component_id == want[r.doc_id]
    assert simhash_groups(none).count() == 0


def test_local_links_are_complete():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    flips = rng.integers(0, 64, (900, 3)).astype(np.uint64)
    fps = np.unique(base ^ np.bitwise_or.reduce(np.uint64(1) << flips, axis=1))
    u, v = local_links(fps, rows=64)
    root = {int(x): int(x) for x in fps}
    root |= {int(a): int(b) for a, b in zip(u, v)}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    for i, j in zip(*np.nonzero(near)):
        assert root[int(fps[i])] == root[int(fps[j])]
    assert fingerprint(b"") == 0


def test_windows_give_the_same_anchors(monkeypatch):
    rng = np.random.default_rng(8)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    off = np.array([0, len(data)])

    def each():
        text, anchor, _, first, last, shift = suffix.runs(data, off)
        assert not text.any()
        return {(int(f) + k, int(a), int(s) - k) for a, f, z, s in zip(anchor, first, last, shift) for k in range(z - f + 1)}

    whole = each()
    monkeypatch.setattr(suffix, "WINDOW", 700)
    assert each() == whole and len(whole) == 3801


@pytest.mark.parametrize("crowd", [suffix.GROUP_RUNS, 2])
def test_repeats(docs, none, crowd, monkeypatch):
    monkeypatch.setattr(suffix.repeated_spans, "__defaults__", (suffix.LENGTH, suffix.KMER, False, crowd))
    data = rows()
    want = Counter((r[0], *w) for r, w in zip(data, brute_repeats([r[1] for r in data], 200), strict=True))
    got = suffix.remove_repeats(docs.select("doc_id", "text", "kept", "rank"))
    assert got.columns == ["doc_id", "rank", "n_bytes", "n_removed", "n_spans", "kept"]
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == want
    assert suffix.remove_repeats(none).count() == 0


def test_crowded_anchors_are_cut_into_cells(spark):
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    common = [noise(150), noise(195), noise(199), noise(230)]
    texts = [noise(rng.randint(0, 90)) + rng.choice(common) + noise(rng.randint(0, 90)) for _ in range(90)] + [common[1] + "x" * 30, "=" * 700, "=" * 260, "ab" * 300]
    texts += [texts[3], texts[40][20:] + "tail"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = dict(enumerate(brute_repeats(texts, 200)))
    for crowd in (1, 4):
        spans = suffix.repeated_spans(docs.select(F.col("doc_id").alias("rid"), F.lit(0).alias("tag"), "text"), group_runs=crowd)
        got = {}
        for r in spans.collect():
            got.setdefault(r.rid, []).append(r)
        for i, (size, gone, n, _) in want.items():
            part = got.get(i, [])
            begin, end = suffix.intervals(np.array([r.pos for r in part]), [r.mask for r in part], 200) if part else (np.zeros(0), np.zeros(0))
            assert (gone, n) == (int((end - begin).sum()), len(begin))
    # across rows only: by owner, groups apart
    rows_ = docs.select(F.col("doc_id").alias("rid"), F.lit(0).alias("tag"), (F.col("doc_id") % 2).alias("grp"), "text")
    seen = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - 39):
            seen.setdefault((i % 2, t[j : j + 40]), set()).add(i)
    for crowd in (1, 100):
        got = {}
        for r in suffix.repeated_spans(rows_, 40, 16, True, crowd).collect():
            got.setdefault(r.rid, []).append(r)
        for i, t in enumerate(texts):
            cover = np.zeros(len(t), dtype=bool)
            for j in range(len(t) - 39):
                if len(seen[i % 2, t[j : j + 40]]) > 1:
                    cover[j : j + 40] = True
            part = got.get(i, [])
            begin, end = suffix.intervals(np.array([r.pos for r in part]), [r.mask for r in part], 40) if part else (np.zeros(0, dtype=int), np.zeros(0, dtype=int))
            mine = np.zeros(len(t), dtype=bool)
            for a, z in zip(begin.tolist(), end.tolist()):
                mine[a:z] = True
            assert (mine == cover).all()


def test_columns_order_matches_brute_force():
    rng = random.Random(5)
    strings, group, shift = [], [], []
    for g in range(6):
        core = bytes(rng.choice(b"ab") for _ in range(40))
        for _ in range(rng.randint(1, 30)):
            left, right = (bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 4))) for _ in range(2))
            strings.append(left + core + right)
            group.append(g)
            shift.append(len(left) + len(right))
    starts = np.array([len(s) - 39 for s in strings])
    found = suffix.insert_columns(np.array(group), strings, np.array(shift), starts, 40)
    seen = Counter()
    for g, s, p, n in zip(group, strings, shift, starts, strict=True):
        seen.update((g, p - j, s[j : j + 40]) for j in range(n))
    for k, (g, s, p, n) in enumerate(zip(group, strings, shift, starts, strict=True)):
        assert [bool(found[k, j]) for j in range(n)] == [seen[g, p - j, s[j : j + 40]] > 1 for j in range(n)]


def test_language_model(docs, none):
    data = rows()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [(r[0], [*(r[1] or "").encode().lower().split(), None]) for r in data]
    c = Counter(t for i, ts in tokens if not held(i) for t in ts)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 6)) for i, ts in tokens)
    got = ngram.score_texts(docs, ngram.held_out(F.col("doc_id")), chunk_tokens=500, block_keys=300).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    once = {(r.doc_id, r.n_tokens): r.score for r in ngram.score_texts(docs, ngram.held_out(F.col("doc_id"))).collect()}
    for r in got:
        assert abs(once[r.doc_id, r.n_tokens] - r.score) < 1e-6 * abs(r.score) and r.score < 0
    trained = sum(r.score for r in got if not r.held_out)
    assert trained > sum(r.base_score for r in got if not r.held_out)
    assert ngram.score_texts(none, ngram.held_out(F.col("doc_id"))).count() == 0
    assert ngram.score_texts(docs, F.lit(True)).where("score is null or isnan(score)").count() == 0


def test_bitmap_has_all_its_keys(spark):
    from tessera.llm.common import Bitmap

    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63, 5000)
    bits = Bitmap(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k", len(keys))
    assert bits.has(keys).all() and bits.has(rng.integers(-(2**63), 2**63, 20000)).mean() < 0.02
    assert not Bitmap(spark.createDataFrame([], "k long"), "k", 0).has(keys).any()


def test_model_equals_brute_force(docs, monkeypatch):
    rng = np.random.default_rng(6)
    weights = rng.dirichlet((1, 1, 1), ngram.BUCKETS)
    weights[0] = [0, 0.6, 0.4]
    tables = []
    monkeypatch.setattr(ngram, "learn_weights", lambda t: tables.append(t) or weights)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    data = [(r[0], r[1]) for r in rows()]
    scores, n, two, one = brute_model(data, held, weights)
    got = Counter((r.doc_id, r.n_tokens, round(r.score, 6)) for r in ngram.score_texts(docs, ngram.held_out(F.col("doc_id")), chunk_tokens=700, block_keys=200).collect())
    assert got == Counter((i, len((t or "").split()) + 1, round(s, 6)) for (i, t), s in zip(data, scores, strict=True))
    t = tables[0]
    assert t[:, 1].sum() == n and t[:, 1] @ t[:, 2] == pytest.approx(two) and t[:, 1] @ t[:, 3] == pytest.approx(one)


def test_counts_beyond_32_bits():
    import pyarrow as pa

    keys = np.array([3, 4], dtype=np.uint64)
    ask = [{"block": 0, "chunk": c, "kind": 0, "keys": keys.tobytes(), "counts": ngram._pack(np.array([2**32 - 1, 1], dtype=np.uint32))} for c in range(3)]
    got = [r for b in ngram._answer(iter([pa.RecordBatch.from_pylist(ask)])) for r in b.to_pylist()]
    assert all(ngram._unpack(r["counts"], np.uint64).tolist() == [3 * (2**32 - 1), 3] for r in got if r["chunk"] is not None)


def test_em_weights():
    rng = np.random.default_rng(1)
    table = np.stack([np.ones(400), np.ones(400), rng.exponential(3, 400), rng.exponential(1, 400)], axis=1)
    w = ngram.learn_weights(table)[1]
    like = lambda w: np.log(table[:, 2] * w[0] + table[:, 3] * w[1] + w[2]).sum()
    grid = [(a / 20, b / 20, 1 - a / 20 - b / 20) for a in range(21) for b in range(21 - a)]
    assert abs(w.sum() - 1) < 1e-9 and like(w) >= max(map(like, grid)) - 1e-3


def lists_of(result):
    got = {}
    for r in result.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return got


@pytest.mark.parametrize(("block", "part"), [(1 << 17, 1 << 19), (30, 400)])
def test_knn(spark, block, part):
    rng = np.random.default_rng(2)
    data = [(i, rng.normal(size=6).astype(float).tolist()) for i in range(300)]
    data += [(300 + i, [0.5] * 6) for i in range(150)] + [(450, None), (451, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (452, [float("nan")] * 6), (453, [float("inf")] * 6), (454, []), (None, [1.0] * 6)]
    # stray lengths, large components, zero vectors
    data += [(460 + i, rng.normal(size=1 + i % 3).tolist()) for i in range(40)] + [(550, [1e8, -1e8, 3.0, 0.0, 0.5, 1e7]), (551, [1e8] * 6), (600, [0.0] * 6), (650, [3e15, -2.5, 1.0, 0.0, 0.0, 1e15])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(4)
    got = lists_of(voronoi_knn(df, F.col("vec_id") % 50 == 0, block_values=block, slice_values=part))
    want = brute_knn(data, lambda i: i % 50 == 0)
    assert set(got) == {i for i, found in want if found}
    for i, found in want:
        assert [(j, s) for _, j, s in sorted(got.get(i, []))] == [(j, s) for j, s in found]
    assert voronoi_knn(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert voronoi_knn(df, F.lit(False)).count() == 0


def test_knn_rows_of_one_id(spark):
    # two vectors of one id, a row twice, and a product beyond a long
    data = [(0, [1.0]), (1, [1.0]), (0, [-2.0]), (3, [4.0]), (3, [4.0]), (4, [1e300])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in voronoi_knn(df, F.col("vec_id") == 0).collect())
    top = 2**63 - 1
    want = Counter([(0, 1, 4, top), (0, 2, 3, 262144), (0, 3, 3, 262144), (0, 4, 1, 65536), (0, 5, 0, -131072)])
    want += Counter([(0, 1, 0, -131072), (0, 2, 1, -131072), (0, 3, 3, -524288), (0, 4, 3, -524288), (0, 5, 4, -top)])
    assert got == want


def test_knn_prunes_clusters(spark, monkeypatch):
    from tessera.llm import knn

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16)) * 10
    data = [(i, (centres[i % 8] + 0.01 * rng.normal(size=16)).tolist()) for i in range(1200)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    written = {}
    monkeypatch.setattr(knn, "materialize", lambda t, name, f=knn.materialize: written.setdefault(name, f(t, name)))
    got = lists_of(voronoi_knn(df, F.col("vec_id") % 50 == 0, block_values=48, slice_values=2000))
    for i, found in brute_knn(data, lambda i: i % 50 == 0):
        assert [(j, s) for _, j, s in sorted(got[i])] == list(found)
    blocks = written["reach"].select("block").distinct().count()
    kept = written["reach"].join(written["summaries"], (F.col("r_n") == F.col("n")) & (F.col("r_cell") == F.col("cell"))).agg(F.sum("count")).first()[0]
    assert kept < 0.5 * blocks * len(data)


def test_mixing(docs, none):
    data = rows()
    got = mix(docs).collect()
    assert len(got) == len(data)
    total, sizes = 0, Counter()
    for r in data:
        n = len((r[1] or "").encode().split())
        sizes[r[3]] += n
        total += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / share for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s]} - capped
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.copies
    docs_of = Counter(r[3] for r in data)
    words_of = Counter()
    for r in got:
        words_of[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - docs_of[s] * target[s] / sizes[s]) <= 1 + 0.2 * docs_of[s] * target[s] / sizes[s]
        # in words: within a few hundredths, or half the source's longest text
        assert abs(words_of[s] - target[s]) <= max(0.03 * target[s], 0.5 * max(r.size for r in got if r.source == s))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(got, key=key) == sorted(mix(docs.repartition(2)).collect(), key=key)
    assert mix(none).count() == 0
    assert mix(docs.where("text = ''")).first().taken == 0


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, PASSAGE), (2, text(40, random.Random(99))), (3, None), (4, ""), (5, "one two"), (6, PASSAGE)], "item_id long, text string")
    words_ = PASSAGE.split()
    changed = " ".join("zz" if k % 7 == 3 else w for k, w in enumerate(words_))
    half = " ".join(words_[:8])
    more = docs.select("doc_id", "text", "fp").union(spark.createDataFrame([(900, text(30) + " " + changed.upper() + "!! " + text(20), "x"), (901, text(30) + " " + half + " " + text(30), "x")], "doc_id long, text string, fp string"))
    got = {r.doc_id: sorted({o.item_id for o in r.overlaps}) for r in find_overlaps(more, bench).collect()}
    assert got[12] == got[13] == got[14] == got[900] == [1, 6]
    assert got[901] == [] and got[10] == [] and got[5] == []
    assert got[8] == [5]
    assert {r.doc_id: sorted({o.item_id for o in r.overlaps}) for r in find_overlaps(more.repartition(7), bench, items_a_row=1).collect()} == got
    assert find_overlaps(none, bench).count() == 0
    assert find_overlaps(docs, bench.limit(0)).where("size(overlaps) > 0").count() == 0


def test_overlap_is_the_longest_stretch():
    rng = np.random.default_rng(3)
    for n, p in [(n, p) for n in (12, 13, 20, 60) for p in (0.6, 0.75, 0.85) for _ in range(30)]:
        same = rng.random(n) < p
        fits = [(z - a, int(same[a:z].sum()), a) for a in range(n) for z in range(a + 13, n + 1) if 5 * same[a:z].sum() >= 4 * (z - a)]
        ends = [f for f in fits if same[f[2]] and same[f[2] + f[0] - 1]]
        want = max(f[:2] for f in ends) if ends else max((f[:2] for f in fits if f[0] == 13), default=None)
        got = longest(same, 13)
        assert (got and (got[1] - got[0], int(same[got[0] : got[1]].sum()))) == want


def test_decontamination_searches_the_whole_diagonal(spark):
    item = [f"w{k}" for k in range(200)]
    # a stretch that a mask hits but too few words of agree, then changed words, then an exact passage
    poor = [w if k not in (3, 6, 8) else "zz" for k, w in enumerate(item[:12])] + ["zz"] * 20 + item[32:92]
    # an exact passage before a long stretch of which 70 % agrees
    mixed = item[:60] + [w if k % 10 not in (2, 5, 8) else "zz" for k, w in enumerate(item[60:])]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    df = spark.createDataFrame([(1, " ".join(poor)), (2, " ".join(mixed))], "doc_id long, text string")
    got = {r.doc_id: r.overlaps for r in find_overlaps(df, bench).collect()}
    assert got[1][0].words >= 60 and got[1][0].agree >= 60
    assert got[2][0].words >= 60 and got[2][0].agree >= 0.8 * got[2][0].words and got[2][0].first_word == 0
    # neighbouring texts with an item's halves, a first short hit and then a long one, and many hits at many shifts
    halves = [" ".join(item[:30]), " ".join(item[30:60])]
    gap = [*item[:12], *["zz"] * 10, *item[22:60]]
    bench = spark.createDataFrame([(1, " ".join(item[:60])), (2, "a b " * 40), (None, " ".join(item[:60]))], "item_id long, text string")
    df = spark.createDataFrame([(1, halves[0]), (2, halves[1]), (3, " ".join(gap)), (4, "b a " * 300), (5, " ".join(gap))], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: [(o.item_id, o.words, o.agree) for o in r.overlaps] for r in find_overlaps(df, bench).collect()}
    assert got[1] == got[2] == [(1, 30, 30), (None, 30, 30)] and got[3] == got[5] == [(1, 60, 50), (None, 60, 50)] and got[4] == [(2, 80, 80)]


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(21)
    words_ = [f"w{k}" for k in range(12)]
    items = [[rng.choice(words_) for _ in range(n)] for n in (5, 11, 12, 13, 20, 30)] + [["a", "b"] * 9, ["a"] * 15, ["a", "b", "c"] * 6]
    docs = []
    for _ in range(60):
        d = [rng.choice(words_) for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 2)):
            part = list(rng.choice(items))[rng.randint(0, 3) :]
            for k in range(len(part)):
                if rng.random() < 0.15:
                    part[k] = "zz"
            d += part + [rng.choice(words_) for _ in range(rng.randint(0, 4))]
        docs.append(d)
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)] + [(0, " ".join(docs[0]))], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    want = {i: {j: b for j, t in enumerate(items) if (b := brute_overlap(d, t))} for i, d in enumerate(docs)}
    got = find_overlaps(df, bench).collect()
    assert len(got) == 61 and sum(map(len, want.values())) > 30
    for r in got:
        assert {o.item_id: (o.words, o.agree) for o in r.overlaps} == want[r.doc_id]


def test_masks_hit_every_overlap():
    for n in range(12, 26):
        bad = np.array([sum(1 << k for k in c) for c in combinations(range(n), n // 5)])
        hit = np.zeros(len(bad), dtype=bool)
        for m in MASKS:
            for at in range(n - len(m) + 1):
                hit |= bad & int(m[::-1], 2) << at == 0
        assert hit.all()
    item = [f"w{k}" for k in range(13)]
    whole, ten = word_hashes(" ".join(item)), word_hashes("one two three four five six seven eight nine ten")
    for c in combinations(range(13), 2):
        assert Document(word_hashes(" ".join("zz" if k in c else w for k, w in enumerate(item)))).overlap(whole) == (13, 11, 0)
    assert Document(word_hashes("a b one two three four five six seven eight nine ten")).overlap(ten) == (10, 10, 2)
    assert Document(word_hashes("a b one two three four five six seven eight nine zz")).overlap(ten) is None


def test_toxicity(spark, docs, none):
    rng = random.Random(11)
    data, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        t = text(60, rng).split()
        if toxic:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(["jerkface", "dimwit", "CREEP", "créep"]))
        data.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame([*data, (None, None), (900, ""), (901, LONG)], "doc_id long, text string").withColumn("score", F.lit(1))
    lab = spark.createDataFrame([*labels, (5000, None), (None, 1), (900, 1), (900, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, lab).collect()}
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i in range(400))
    right = sum(got[i].predicted == (i % 5 == 0) for i in held)
    assert right >= 0.95 * len(held)
    # labels of the held-out rows make no difference
    other = spark.createDataFrame([(i, 1 - y if i in held else y) for i, y in labels], "doc_id long, toxic int")
    assert {r.doc_id: r.score for r in toxicity.score_toxicity(df, other).collect()} == {i: r.score for i, r in got.items()}
    assert toxicity.score_toxicity(df, lab.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.score_toxicity(none, lab).count() == 0


def test_grammar():
    i, n, r, g, o = toxicity.INSULT, toxicity.NEGATION, toxicity.REPORT, toxicity.TARGET, toxicity.OTHER
    score = lambda *c: toxicity.score_clause(list(c), [3.0 if x == i else 0.0 for x in c])
    assert score(o, i)[0] == 3.0
    assert score(n, i)[:2] == (1.5, True) and score(n, o, o, o, i)[:2] == (3.0, False)
    assert score(r, o, o, o, i)[0] == pytest.approx(2.3) and score(g, i)[0] == score(i, o, g)[0] == 3.5
    assert score(o, o)[0] == 0


def test_clauses_equal_brute_force():
    rng = random.Random(3)
    kinds = ["other", "insult", "threat", "target", "negation", "report"]
    for _ in range(3000):
        clause = [(kinds[k], (0.0, rng.choice([1.3, 2.0, 4.0]), toxicity.THREAT_WEIGHT, 0.0, 0.0, 0.0)[k]) for k in (rng.randrange(6) for _ in range(rng.randint(1, 9)))]
        got = toxicity.score_clause([kinds.index(k) for k, _ in clause], [w for _, w in clause])
        assert got[0] == pytest.approx(brute_clause(clause))
        assert got[3] == (any(k == "target" for k, _ in clause) and any(k in ("insult", "threat") for k, _ in clause))


def test_matches_equal_brute_force():
    rng = random.Random(4)
    insults = {"dimwit": 2.0, "créep": 3.0}
    reader = toxicity.Lexical({toxicity.word_hash(w): v for w, v in insults.items()})
    kind = {**dict.fromkeys(toxicity.REPORTS, "report"), **dict.fromkeys(toxicity.NEGATIONS, "negation"), **dict.fromkeys(toxicity.TARGETS, "target"), **dict.fromkeys(toxicity.THREATS, "threat"), **dict.fromkeys(insults, "insult")}
    pool = ["dimwit", "CRÉEP", "you", "not", "said", "kill", "apple", "pear", "x1"]
    texts = ["", "...", "dimwit"] + ["".join(rng.choice(pool) + rng.choice([" ", " ", ", ", ". ", "!\n"]) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    got = toxicity.match(np.frombuffer(b"".join(raw), dtype=np.uint8), off, reader)
    for t, row in zip(texts, got, strict=True):
        clauses = [[w for w in re.split(r"[ ,]+", c.lower()) if w] for c in re.split(r"[.!?;:\n]", t)]
        totals = [brute_clause([(kind.get(w, "other"), insults.get(w, 3.0 if kind.get(w) == "threat" else 0.0)) for w in c]) for c in clauses if any(kind.get(w) in ("insult", "threat") for w in c)]
        assert row[0] == bool(totals) and np.expm1(row[1]) == pytest.approx(sum(totals)) and row[2] == pytest.approx(max(totals, default=0))


def test_contradicting_labels_and_copies():
    import pandas as pd

    marks = pd.DataFrame([(1, 5, 6, 7), (1, 5, 6, 7), (1, 5, 8, 9), (0, 5, 6, 7), (0, -1, -1, -1), (0, -1, -1, -1)], columns=["toxic", "m0", "m1", "m2"])
    assert toxicity.likeness(marks).tolist() == [257, 257, 360, 600, 600, 600]


def test_urls(spark):
    data = [
        (0, "http://a.org/x", "allow", "org/"), (1, "https://sub.Example.ORG/es/1", "block", "example.org/es/"), (2, "http://example.org/en/12?q", "block", "example.org/en/1"), (3, "http://notexample.org/es/1", "allow", "org/"),
        (4, "http://x.com/fr/1", "allow", "com/fr/"), (5, "http://x.com/de/", "block", "com/de/"), (6, None, None, None), (7, "nonsense", None, None), (8, "http://h.net", None, None), (9, "http://h.net#f/de/", None, None), (10, "a://b://c/d", None, None), (11, "", None, None), (12, "http://x.com/de/", "block", "com/de/"),
    ]
    name = lambda k: chr(97 + k % 26) + chr(97 + k // 26)
    data += [(100 + k, f"http://big.net/a{name(k)}/{k}", None, None) for k in range(80)]
    # a host of both labels: many rare sections, and a deep path that only its last segments part
    wide = (("w.net", "/ok/", "allow"), ("w.net", "/a/b/c/d/bad/", "block"), ("w.net", "/a/b/c/d/good/", "allow"))
    data += [(300 + k, f"http://w.net/ok/{name(k)}", None, None) for k in range(90)] + [(400 + k, f"http://w.net/{name(k)}/x{k}", None, None) for k in range(60)]
    data += [(500 + k, f"http://w.net/a/b/c/d/{('bad', 'good')[k % 2]}/{name(k)}", None, None) for k in range(40)]
    data += [(700, "http://w.net/" + "long/" * 4000 + "?" + "q" * 100000, None, None)]
    data += [(600, "http://w.net/a/b/c/d/bad", None, None), (601, "http://w.net/a/b/c/d/good", None, None), (602, "http://w.net/a/b/c/d/bad/", None, None)]
    df = spark.createDataFrame([d[:2] for d in data], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urls.judge_urls(df).collect()}
    assert len(got) == len(data)
    for i, _, verdict, rule in data:
        assert got[i].rule == rule and got[i].verdict in ("allow", "block") and (verdict is None or got[i].verdict == verdict)
    assert (got[8].host, got[8].path) == ("h.net", "") and (got[9].host, got[9].path) == ("h.net", "") and (got[10].host, got[10].path) == ("b:", "//c/d") and (got[6].host, got[7].path) == ("", "")
    assert {got[100 + k].template for k in range(80)} == {"big.net"}
    deep = {r.page_id: r for r in urls.judge_urls(df, rules=(*urls.RULES, *wide)).collect()}
    assert deep[600].verdict == "block" and deep[601].verdict == "allow" and deep[600].rule is None
    assert deep[600].template == "w.net/a/b/c/d/bad" and deep[400].template == "w.net/*" and deep[300].template == "w.net/ok"
    assert urls.judge_urls(df.limit(0)).count() == 0
    assert urls.judge_urls(df, rules=()).where("rule is not null or verdict <> 'allow'").count() == 0
    assert urls.judge_urls(df.union(df.limit(5))).count() == len(data) + 5


def test_urls_equal_sql(spark, monkeypatch):
    rng = random.Random(17)
    hosts = ["example.org", "a.example.org", "h.com", "x.h.com", "z.net", "", "deep.com"]
    parts = ["es", "en", "1", "12", "fr", "de", "a", "b", "c1", "", "d", "en1"]
    data = [(i, rng.choice(["http://", "x://", ""]) + rng.choice(hosts) + rng.choice(["", "/"]) + "/".join(rng.choice(parts) for _ in range(rng.randint(0, 5))) + rng.choice(["", "?q=/de/", "#f"])) for i in range(700)]
    data += [(700 + i, f"http://h.com/{rng.choice(['fr', 'de', 'q'])}/{'s' * (1 + i % 70)}") for i in range(300)] + [(2000, None), data[0]]
    more = (("h.com", "/a/b/", "block"), ("h.com", "/a/", "allow"), ("h.com", "/b/", "block"), ("deep.com", "/a/b/d/", "block"), ("deep.com", "/a/b/a/", "allow"))
    monkeypatch.setattr(urls, "RULES", (*urls.RULES, *more))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", data)
    sql = urls.URLS_SQL
    for of in ("rule", "verdict"):
        sql = sql.replace(CASES[of], urls._case(of))
    want = Counter(con.sql(sql).fetchall())
    df = spark.createDataFrame(data, "page_id long, url string").repartition(3)
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict, r.template, r.share) for r in urls.judge_urls(df, rules=urls.RULES).collect())
    assert got == want and len({r[5] for r in want}) > 20


CASES = {of: urls._case(of) for of in ("rule", "verdict")}
PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav>
<!-- ad --><div class="ad">Buy <div>this</div></div>%s<article><h1>Title &amp; more</h1><p>One<b>two</b>\n three&nbsp;x<br>four &am <p>five<aside>side</aside><div class="comments"><p>first!</p></div></article><footer>&copy; host</footer></body></html>"""


def test_extraction(spark):
    want = "Title & more Onetwo three x four &am five"
    open_page = "<html><body><div>%s</div><p>Unique words of page %d stand here</p><div class=footer>f</div></body>"
    shared = "These words are on each page of the host and so they are no text of a page " * 2
    data = [(1, "http://h.com/1", PAGE % ""), (2, "http://h.com/2", PAGE % "<div class='ad'>never closed"), (3, "http://h.com/3", None), (4, None, ""), (5, "http://h.com/5", "plain text"), (6, "http://h.com/6", "<p>a<script>x</p>")]
    data += [(10 + k, f"http://o.com/{k}", open_page % (shared, k)) for k in range(3)] + [(20, "http://other.com/1", open_page % (shared, 20)), (20, "http://other.com/1", open_page % (shared, 20))]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r.page_id, r.text, r.n_chars) for r in extract_text(df).collect()]
    assert len(got) == len(data) and all(len(t) == n for _, t, n in got)
    by = {i: t for i, t, _ in got}
    assert by[1] == by[2] == want and by[3] == by[4] == "" and by[5] == "plain text" and by[6] == "a"
    assert [by[10 + k] for k in range(3)] == [f"Unique words of page {k} stand here" for k in range(3)]
    assert all(by[10 + k] == f"Unique words of page {k} stand here" for k in range(3))
    assert by[20].startswith("These words")  # another host, and its one page twice
    assert extract_text(df.limit(0)).count() == 0
    assert blocks("<p>x</p>") == [(b"o", "x")]


def test_extraction_keeps_article_text():
    words_of = lambda page: [t for k, t in blocks(page) if k == b"m"]
    kept = "<article><p class='notice-period'>Two weeks</p><p><span class='share-price'>12</span> <math><mi>x</mi></math> <button>go</button> <b class=header-less>b</b></p></article>"
    assert words_of(kept) == ["Two weeks", "12 x go b"]
    gone = "<article>a<div class='cookie-notice box'>c</div><div id=comments>d</div><span class=ad>e</span><form>f<button>g</button></form><aside>h</aside>z</article>"
    assert words_of(gone) == ["a", "z"]
    assert [t for _, t in blocks("x <y and no end")] == ["x <y and no end"] and [t for _, t in blocks("a <b title='x>y</b> c")] == ["a y c"]
    for hostile in ("<a '", "<a <a ", "<textarea>", "<!--", '<a "\'', "<nav>", "&amp", "<script>"):
        assert len(blocks(hostile * 20000 + "'")) < 30000


def test_extraction_equals_brute_force(spark):
    rng = random.Random(31)
    shared = [text(n, rng) for n in (3, 8, 12, 25)] + ["\u00e9t\u00e9 " * 12]
    pages = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.6 else text(rng.randint(1, 20), rng) for _ in range(rng.randint(0, 6))]
        tags = [rng.choice(["<p>%s</p>", "<div class=nav>%s</div>", "<article>%s</article>", "<div>%s</div>"]) for _ in parts]
        pages.append((i, f"http://h{i % 3}.com/", "".join(t % p for t, p in zip(tags, parts))))
    pages.append((60, "http://h1.com/", "<p>" + text(4000, rng) + " " + shared[3] + "</p>"))
    df = spark.createDataFrame(pages + pages[:2], "page_id long, url string, html string").repartition(4)
    got = extract_text(df).collect()
    want = brute_extract(pages)
    assert len(got) == 63 and all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)
    assert sum(r.repeated for r in got) > sum(r.by_mark for r in got) > 0


def test_language(spark, none):
    rng = random.Random(4)
    kinds = {"en": "the of and ing tion that wh th er ou", "de": "der die und sch ung ein keit ch lich zu", "fr": "le la les que eau eux ment é è ou"}
    make = lambda lang, n: " ".join("".join(rng.choice(kinds[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))
    data = []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        data.append((i, make(lang, 40), lang if i % 10 else ("en", "de", "fr")[(i + 1) % 3], f"s{i % 3}"))
    data += [(1000, None, "en", "s0"), (1001, "", None, None), (1002, "12 !!", "xx", "s9"), (1003, make("de", 40), None, None), data[0]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").withColumn("language", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify_documents(df).collect()}
    assert sum(got[i].language == ("en", "de", "fr")[i % 3] for i in range(240)) >= 238
    assert got[1003].language == "de" and got[1003].accepted and not got[1000].accepted and not got[1001].accepted and not got[1002].accepted
    assert langid.identify_documents(none).count() == 0
    assert langid.identify_documents(df.withColumn("lang", F.lit(None).cast("string"))).where("accepted").count() == 0


def test_language_equals_brute_force(spark):
    rng = random.Random(9)
    kinds = {"en": "the of and ing tion wh", "DE": "der die und sch ung ein", "fr": "le la les que eau eux"}
    data = []
    for i in range(90):
        lang = ("en", "DE", "fr")[i % 3]
        t = " ".join("".join(rng.choice(kinds[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 6)))
        data.append((i, t, rng.choice([lang, lang.lower(), " " + lang.upper(), "en", None, "", "xx"]), rng.choice(["a.b.c", "x.b.c", "c", "b.c", "solo", None, "y.d.c"])))
    data += [(100, None, "en", "solo"), (101, "12 !", "fr", "c"), (102, " ".join(["the of and"] * 9000), None, "solo"), data[0]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: (r.language, r.accepted) for r in langid.identify_documents(df).collect()}
    want = brute_language([r[1:] for r in data])
    assert {r[0]: (got[r[0]][0].strip().lower(), got[r[0]][1]) for r in data} == {r[0]: w for r, w in zip(data, want, strict=True)}


def test_rare_languages_are_classes(spark):
    rng = random.Random(8)
    make = lambda parts, n: " ".join("".join(rng.choice(parts.split()) for _ in range(rng.randint(1, 3))) for _ in range(n))
    en, rare = "the of and ing tion that wh th er ou", "\u0127a\u0121 g\u0127 iet ij \u017cz xej jje uq kk"
    data = [(i, make(en, 8), "en", "s0") for i in range(2600)] + [(5000, make(rare, 40), "mt", "s0"), (5001, make(rare, 40), " MT", "s0"), (5002, make(rare, 40), "mt", None), (5003, make(en, 40), " ", "s0"), (5004, "12", "xx", "s1")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in langid.identify_documents(df).where("doc_id >= 5000 or doc_id < 5").collect()}
    assert all(got[i].language == got[i].text_language == "mt" and got[i].accepted for i in (5000, 5001, 5002))
    assert all(got[i].language == "en" and got[i].accepted for i in (0, 1, 2, 3, 4, 5003)) and got[5004].language in ("en", "mt")


def test_language_sends_python_no_column_twice(spark, tmp_path):
    """What a query doesn't return stays out of Python's rows, and a returned text goes there once; the rows are the same."""
    from tessera.llm.queries import language_id_pages, op5_language_id

    docs = spark.createDataFrame([(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 3, ("de", "en")[i % 2], "s0") for i in range(20)] + [(20, None, None, None)], "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(i, f"http://a{i % 3}.de/p", f"<html lang='de'><p>{'die katze und ' * i}</p></html>") for i in range(9)] + [(9, None, None)], "page_id long, url string, html string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    fused = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "MapInArrow fuse(" in x]
    by_page, by_doc, whole = language_id_pages(spark, str(tmp_path)), op5_language_id(spark, str(tmp_path)), langid.identify_documents(docs)
    assert all(len(fused(x)) == 1 for x in (by_page, by_doc, whole))
    assert "html#" not in fused(by_page)[0] and " text#" not in fused(by_doc)[0] and "_lid_text#" not in fused(whole)[0]
    added = ("language", "text_language", "accepted")
    want = {r.page_id: tuple(r[c] for c in added) for r in langid.identify_pages(pages, docs).collect()}
    assert {r.page_id: tuple(r[c] for c in added) for r in by_page.collect()} == want and len(want) == 10
    want = {r.doc_id: tuple(r[c] for c in added) for r in whole.collect()}
    assert {r.doc_id: tuple(r[c] for c in added) for r in by_doc.collect()} == want and whole.where("text is null").count() == 1
