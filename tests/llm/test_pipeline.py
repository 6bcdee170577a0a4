"""The stages against brute-force versions and the operators, and the queries' shape on the small tables."""

import random

import duckdb
import pytest

import corpus_pipeline as P
from brute import brute_fingerprint, brute_language, brute_overlap, brute_repeats, components
from tessera.llm.mixing import MIX_SQL
from tessera.llm.decontamination import find_overlaps
from tessera.llm.queries import oracle_sql, queries
from tessera.llm.suffix import remove_repeats

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [f for _, f in P.STAGES] == [P.language_id, P.near_dedup, P.suffix_dedup, P.decontamination, P.mixing]
    a = P.language_id(spark, docs, SF)
    assert a.columns == docs.columns and a.count() == docs.count()
    b = P.near_dedup(spark, a.union(a.limit(3)), SF)
    ids = [r.doc_id for r in b.collect()]
    assert len(ids) == len(set(ids)) < docs.count()
    c = {r.doc_id: (r.text, r.n_chars) for r in P.suffix_dedup(spark, docs, SF).collect()}
    for r in remove_repeats(docs.select("doc_id", "text")).collect():
        text = bytes(r.kept).decode("utf-8", "ignore")
        assert c[r.doc_id] == (text, len(text))
    d = {r.doc_id for r in P.decontamination(spark, docs, SF).collect()}
    hit = find_overlaps(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("size(overlaps) > 0")
    assert d == {r.doc_id for r in docs.collect()} - {r.doc_id for r in hit.collect()}
    assert hit.count() > 0


def test_near_dedup_keeps_a_row_of_each_group(spark):
    words = [[f"{c}{k}" for k in range(60)] for c in "abcdef"]
    texts = [" ".join(w) for w in words]
    # null ids on different texts, one of them twice; one id on two texts, one of them in another's group
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (1, texts[3]), (2, texts[3]), (2, texts[4]), (3, texts[5]), (3, texts[5])]
    docs = spark.createDataFrame([(i, t, None, "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = sorted((r.text, r.doc_id) for r in P.near_dedup(spark, docs, SF).collect())
    assert got == sorted([(texts[0], None), (texts[1], None), (texts[2], None), (texts[3], 1), (texts[4], 2), (texts[5], 3)])
    assert P.near_dedup(spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "source", "size", "source_size", "target", "copies", "taken"] and out.count() > 100


def test_names():
    assert {n for n in queries() if n.startswith("op")} == {n for n in queries() if n[2:3].isdigit()} and set(oracle_sql()) <= set(queries())


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with documents and a benchmark: copies, near copies, shared passages, leaks, nulls, empty and long texts, repeated rows."""
    rng = random.Random(41)
    kinds = {"en": "the of and ing tion that wh th er ou", "de": "der die und sch ung ein keit ch lich zu"}
    make = lambda lang, n: " ".join("".join(rng.choice(kinds[lang].split()) for _ in range(rng.randint(2, 4))) for _ in range(n))
    items = [make("en", 30) for _ in range(4)]
    passage = make("en", 70)
    rows = []
    for i in range(70):
        lang = ("en", "de")[i % 4 == 0]
        t = make(lang, rng.randint(5, 60))
        if i % 9 == 0:
            t = f"{t} {passage} {make('en', 9)}"
        if i % 11 == 0:
            t = f"{t} {items[i % 4]} {t[:40]}"
        rows.append((i, t, lang, f"s{i % 3}", len(t)))
    rows += [(100 + i, *rows[i][1:]) for i in range(5)]  # copies
    rows += [(110 + i, rows[i][1] + "  ", *rows[i][2:]) for i in range(3)]  # the same words
    rows += [rows[7], rows[7], (None, rows[20][1], "en", None, 9), (None, make("en", 40), None, "s1", 9), (200, None, "en", "s1", None), (201, "", "de", "s0", 0), (202, "12 34", "en", "s0", 5), (203, make("en", 5000), "en", "s2", 1), (3, make("de", 30), "de", "s1", 1)]
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, items


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def written(spark, df, at):
    df.write.parquet(at)
    return spark.read.parquet(at)


def test_stages_equal_brute_force(spark, small, tmp_path):
    folder, rows, items = small
    names = ("doc_id", "text", "lang", "source", "n_chars")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = lambda df: sorted((tuple(r[c] for c in names) for r in df.collect()), key=key)
    # 5: rejected documents go
    got = written(spark, P.language_id(spark, docs, folder), str(tmp_path / "0"))
    want = sorted((r for r, (_, ok) in zip(rows, brute_language([(r[1], r[2], r[3]) for r in rows])) if ok), key=key)
    assert plain(got) == want and 60 < len(want) < len(rows)
    # 1: the smallest doc_id of each component of fingerprints, nulls last
    prints = [brute_fingerprint(r[1]) for r in want]
    groups = components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    got = written(spark, P.near_dedup(spark, got, folder), str(tmp_path / "1"))
    found = plain(got)
    assert len(found) == len(set(groups))
    by_print = {}
    for r, g in zip(want, groups):
        by_print.setdefault(g, []).append(r)
    ids = sorted((min(((r[0] is None, r[0] or 0) for r in g)) for g in by_print.values()))
    assert sorted((r[0] is None, r[0] or 0) for r in found) == ids and all(any(r in g for g in by_print.values()) for r in found)
    # 8: strings of 200 bytes that stand elsewhere too
    got = written(spark, P.suffix_dedup(spark, got, folder), str(tmp_path / "2"))
    kept = [k.decode("utf-8", "ignore") for _, _, _, k in brute_repeats([r[1] for r in found], 200)]
    want = sorted(((r[0], k, r[2], r[3], len(k)) for r, k in zip(found, kept)), key=key)
    assert plain(got) == want and any(k != r[1] for r, k in zip(found, kept))
    # 7: documents that overlap an item go
    got = written(spark, P.decontamination(spark, got, folder), str(tmp_path / "3"))
    tokens = [t.split() for t in items]
    want = [r for r in want if not any(brute_overlap((r[1] or "").split(), t) for t in tokens if set(t[:30]) & set((r[1] or "").split()))]
    assert plain(got) == want and len(want) < len(kept)
    # 6: the same copies as SQL
    mixed = {(r.doc_id, r.source, r.size, r.taken) for r in P.mixing(spark, got, folder).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", want)
    assert mixed == set(con.sql(f"SELECT doc_id, source, size, taken FROM ({MIX_SQL})").fetchall())
    # run() is the stages one after the other
    assert {(r.doc_id, r.source, r.size, r.taken) for r in P.run(spark, folder).collect()} == mixed


def test_stages_take_empty_tables_and_other_columns(spark, small):
    folder, rows, _ = small
    more = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows[:12]], DOCS + ", language int, overlaps string, posterior double").repartition(2)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, more, folder).columns == list(P.COLUMNS) and stage(spark, more.limit(0), folder).count() == 0
    assert P.mixing(spark, more, folder).count() == 12 and P.mixing(spark, more.limit(0), folder).count() == 0
