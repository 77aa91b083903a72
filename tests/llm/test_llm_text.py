"""Exact dedup, token counts, token files, near duplicates and license scans against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from llm_fixtures import ROWS, docs, near_components, near_copies

from ticklens.llm import exactdedup, licenses, minhash, tokencount, tokenfile, vocab


def key(row):
    return (row[0] is None, row[0] or 0, *map(str, row[1:]))


# ------------------------------------------------------------------ exact dedup (4)

def exact_expected(rows):
    norm = [re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm):
        same = [(j is None, -len(t or ""), j) for (j, t), m in zip(rows, norm) if m == n]
        keep = min(same, key=lambda s: (s[0], s[1], s[2] or 0))[2]
        out.append((i, keep, len(same), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("extra", [False, True])
def test_exact_groups(spark, extra):
    got = exactdedup.exact_groups(docs(spark, extra=extra)).collect()
    assert sorted(map(tuple, got), key=key) == exact_expected(ROWS)


def test_exact_ties_and_repeats(spark):
    rows = [(5, "a b"), (3, "ab"), (4, "a b"), (4, "a b"), (9, "a  b")]
    got = sorted(map(tuple, exactdedup.exact_groups(docs(spark, rows)).collect()), key=key)
    assert got == exact_expected(rows) and {g[1] for g in got} == {9}


def test_exact_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "BROADCAST_HASHES", 0)
    got = exactdedup.exact_groups(docs(spark, extra=True)).collect()
    assert sorted(map(tuple, got), key=key) == exact_expected(ROWS)


def test_exact_shuffles_no_unique_text(spark):
    rows = docs(spark, [(k, f"text number {k} " * 50) for k in range(200)])
    plan = exactdedup.exact_groups(rows)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and "SortMergeJoin" not in plan


def test_exact_collision_is_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(exactdedup.F, "md5", lambda c: F.lit("ab" * 16))
    got = exactdedup.exact_groups(docs(spark)).collect()
    assert sorted(map(tuple, got), key=key) == exact_expected(ROWS)


# ------------------------------------------------------------------ token counts (2)

@pytest.fixture(scope="module")
def byte_level():
    return vocab.load(tokencount.TOKENIZER), tokencount.ByteLevelCounter()


ALPHABET = ["a", "é", "É", " ", "  ", "\n", "\t", "'s", "'LL", "12", "!", "<|endoftext|>", "<|endof", "text|>",
            "<|startoftext|>", "ß", "日本", " ", "\x1c", "\x85", "́", "\U0001f600", "Σ", "İ",
            "ﬁ", "Ɤ", "​", " \n", " x"]


def test_counts_equal_the_library(byte_level):
    library, own = byte_level
    rnd = random.Random(2)
    for _ in range(3000):
        text = "".join(rnd.choices(ALPHABET, k=rnd.randint(0, 60)))
        expected = len(library.encode(text, add_special_tokens=False).ids)
        for chunk, overlap in ((1 << 16, 1 << 10), (8, 2), (20, 3), (33, 16)):
            assert own.count(text, chunk, overlap) == expected, (text, chunk, overlap)


def test_widening_and_pieces_longer_than_a_chunk(byte_level):
    library, own = byte_level
    for text in ("x" * 500 + " y" * 40, " " * 300 + "a", "ab1" * 200, "<|endoftext|>" * 30, "\n" * 257):
        expected = len(library.encode(text, add_special_tokens=False).ids)
        assert [own.count(text, c, o) for c, o in ((16, 4), (64, 2), (100, 50))] == [expected] * 3


def test_count_query_rows(spark, byte_level):
    library, _ = byte_level
    got = tokencount.token_counts(docs(spark, extra=True)).collect()
    expected = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024)
                for i, t in ROWS]
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_cache_is_bounded():
    memo = vocab.Memo(len, limit=3)
    assert [memo[w] for w in ("a", "bb", "ccc", "dddd", "a")] == [1, 2, 3, 4, 1] and len(memo) <= 3


# ------------------------------------------------------------------ token files (7)

def test_ids_equal_the_library():
    library, own = vocab.load(tokenfile.TOKENIZER), tokenfile.WordLevelEncoder()
    rnd = random.Random(3)
    texts = ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 40))) for _ in range(4000)]
    texts += ["a" + chr(k) + "b" for k in range(0x80, 0x600) if not 0xD800 <= k < 0xE000]
    for text in texts:
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == expected, repr(text)


def test_ids_words_share_their_pieces(monkeypatch):
    """Words that differ in case or signs ask the library once for each piece."""
    asked = []
    ids = vocab.Pieces.__call__
    monkeypatch.setattr(vocab.Pieces, "__call__", lambda self, piece: asked.append(piece) or ids(self, piece))
    library, own = vocab.load(tokenfile.TOKENIZER), tokenfile.WordLevelEncoder()
    text = "Stemword stemword STEMWORD stemword, (Stemword's) naïve NAÏVE, stemword***"
    assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert sorted(asked) == sorted(["stemword", ",", "(", "'s", ")", "naïve", "***"])


def test_ids_of_latin_texts_equal_the_library():
    library, own = vocab.load(tokenfile.TOKENIZER), tokenfile.WordLevelEncoder()
    rnd = random.Random(4)
    latin = [chr(k) for k in range(0x250)] + list("'" * 4 + "stmdrevelSTM \t") * 20
    texts = ["".join(rnd.choices(latin, k=rnd.randint(1, 14))) for _ in range(6000)]
    texts += [x for k in range(0x250) for x in (chr(k), f"a{chr(k)}1", f"!{chr(k)}b")]
    for text in texts:
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == expected, repr(text)


def test_token_file_rows(spark):
    rows = [(i, t) for i, t in ROWS]
    got = tokenfile.token_file(docs(spark, rows, extra=True).repartition(3)).collect()
    library = vocab.load(tokenfile.TOKENIZER)
    counts = {}
    expected, at = [], 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in ordered:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        expected.append((i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        counts[i] = counts.get(i, 0) + 1
    assert sorted(((g.doc_id, g.n_tokens, g.ids_crc32) for g in got), key=key) == sorted(expected, key=key)
    # starts: the rows tile the stream in doc_id order (rows of one doc_id in either order)
    for g in sorted(got, key=lambda g: g.start):
        assert g.start == at
        at += g.n_tokens
    assert [g.doc_id for g in sorted(got, key=lambda g: g.start)] == [i for i, _ in ordered]


def test_token_file_prunes_by_doc_id(spark, tmp_dir):
    path = f"{tmp_dir}/ids"
    tokenfile.write_tokens(spark.range(5000).selectExpr("id as doc_id", "cast(id as string) as text"), path)
    rows = spark.read.orc(path).where("doc_id = 17")
    assert rows.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in \
        rows._jdf.queryExecution().toString()


def test_token_file_starts_are_places_in_the_file(spark, tmp_dir):
    """Rows of one doc_id (nulls too) with different texts: start counts the ids before the row as it is written."""
    rnd = random.Random(7)
    rows = [(rnd.choice([None, 5, 5, 6]), " ".join(rnd.choices(["a", "bb", "ccc"], k=rnd.randint(1, 40)))) for _ in range(400)]
    path = f"{tmp_dir}/ids"
    tokenfile.write_tokens(docs(spark, rows).repartition(7), path)
    files = [f.toPandas() for f in (spark.read.orc(p) for p in sorted(spark.read.orc(path).inputFiles()))]
    stream, at = [], 0
    for f in files:                                      # files are named in the order of their partitions
        for i, ids in zip(f.doc_id, f.ids):
            stream.append((None if i != i else int(i), at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
            at += len(ids)
    got = tokenfile.read_tokens(spark, path).collect()
    assert sorted(map(tuple, got), key=key) == sorted(stream, key=key) and len(stream) == len(rows)


def test_token_file_splits_a_hot_doc_id(spark, tmp_dir):
    path = f"{tmp_dir}/ids"
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokenfile.write_tokens(spark.range(2000).selectExpr("cast(null as bigint) as doc_id", "cast(id as string) as text"), path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    sizes = [r["count"] for r in spark.read.orc(path).selectExpr("_metadata.file_path as f").groupBy("f").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 1000


# ------------------------------------------------------------------ near duplicates (3)

def groups(spark, rows, **kw):
    got = minhash.near_groups(docs(spark, rows, **kw)).collect()
    for g in got:
        assert g.kept == (g.doc_id == g.component_id)
    return sorted(((g.doc_id, g.n_shingles, g.component_id) for g in got), key=key)


@pytest.mark.parametrize("extra", [False, True])
def test_near_groups_of_odd_rows(spark, extra):
    assert groups(spark, ROWS, extra=extra) == sorted(near_components(ROWS), key=key)


def test_near_groups_of_chains(spark):
    rows = near_copies()
    assert groups(spark, rows) == sorted(near_components(rows), key=key)


def test_links_beyond_the_hubs(spark, monkeypatch):
    """With no hub rounds at all the complete comparison of buckets alone must find every link."""
    monkeypatch.setattr(minhash, "HUB_ROUNDS", 1)
    rows = near_copies(n_groups=2, copies=25, words=60, seed=5)
    assert groups(spark, rows) == sorted(near_components(rows), key=key)


def test_near_joins_only_texts_of_candidates(spark, monkeypatch):
    """Of texts that are no candidates few reach the join with the candidates' doc_ids, of the others all."""
    some = [None, *range(0, 3000, 100)]
    rows = docs(spark, [(k, f"text number {k}") for k in [None, *range(3000)]])
    ends = spark.createDataFrame([(k,) for k in some], "end bigint")
    met = []
    semi_join = type(rows).join
    monkeypatch.setattr(type(rows), "join", lambda left, *a, **kw: met.append(left) or semi_join(left, *a, **kw))
    sets = minhash._sets_of(ends, rows)
    monkeypatch.undo()
    found = {r.doc_id for r in met[0].collect()}
    assert found >= set(some) and len(found) < 200 and sets.count() == len(some)


def test_a_node_meets_its_component_once(spark, monkeypatch):
    """The join with the components has a row per node, not one per bucket of a node."""
    members = [(key, node, 1, 9) for key in range(1, 21) for node in (1, 2, 3, 4, 9)]
    hubbed = spark.createDataFrame(members + [(99, 2, 1, 9), (99, 3, 1, 9)], "key long, node long, lo long, hi long")
    parts = spark.createDataFrame([(2, 7), (3, 7)], "node long, part long")
    met = []
    join = type(hubbed).join
    monkeypatch.setattr(type(hubbed), "join", lambda left, *a, **kw: met.append(left) or join(left, *a, **kw))
    got = {tuple(r) for r in minhash._unsettled(hubbed, parts).select("key", "node", "part").collect()}
    monkeypatch.undo()
    # bucket 99 lies in one component
    assert got == {(key, node, part) for key in range(1, 21) for node, part in ((2, 7), (3, 7), (4, 4))}
    assert met[0].count() == 3


def test_one_python_step_in_a_task_that_reads_texts(spark, monkeypatch):
    """However few the candidates: their texts are shuffled between the filter of doc_ids and the sets."""
    rows = docs(spark, [(k, f"text number {k}") for k in range(50)])
    kept = {}
    write = minhash.stored
    monkeypatch.setattr(minhash, "stored", lambda df, name: kept.setdefault(name, df) and write(df, name))
    sets = minhash._sets_of(spark.createDataFrame([(3,), (7,)], "end bigint"), rows)
    plan = kept["sets"]._jdf.queryExecution().executedPlan().toString()
    assert sets.count() == 2 and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_signature_estimate_is_corrected(spark):
    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 1 << 62, 3000).astype(np.uint64)
    b = np.concatenate([a[:2400], rnd.integers(0, 1 << 62, 600).astype(np.uint64)])
    from ticklens.llm import shingles
    low = [(shingles.minima(np.sort(x), np.array([0]), minhash._MULTIPLIERS) >> np.uint64(32)) & np.uint64(3) for x in (a, b)]
    words = [minhash.packed(x)[:, 0].view(np.int64).tolist() for x in low]
    frame = [spark.createDataFrame([tuple(w)], minhash.SIGNATURE) for w in words]
    est = frame[0].alias("a").join(frame[1].alias("b")).select(minhash.estimate("a", "b").alias("e")).first().e
    agree = float((low[0] == low[1]).mean())
    assert abs(est - (agree - 0.25) / 0.75) < 1e-12 and abs(est - 2400 / 3600) < 0.2


def test_band_miss_probability():
    miss = (1 - (minhash.PERCENT / 100) ** minhash.ROWS) ** minhash.BANDS
    assert miss < 1e-5


# ------------------------------------------------------------------ licenses (6)

def license_expected(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words))
          if words[k:k + len(phrase.split())] == phrase.split()]
    return (len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None),
            ",".join(sorted({label for _, label in at})))


def test_license_places(spark):
    rnd = random.Random(4)
    pool = ["cc", "by", "CC-BY", "general", "public", "license", "all", "rights", "reserved", "All rights reserved.",
            "GNU General Public License", "é", ",", "nc", "4.0", "xéy"]
    rows = ROWS + [(100 + k, " ".join(rnd.choices(pool, k=rnd.randint(0, 60)))) for k in range(200)]
    got = licenses.licenses(docs(spark, rows, extra=True)).collect()
    assert sorted((tuple(g[:6]) for g in got), key=key) == sorted(((i, *license_expected(t)) for i, t in rows), key=key)
    for g in got:
        assert 0 <= g.score <= 1 and set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(","))


def test_license_notices(spark):
    rows = [(1, "x " * 50 + "Licensed under the Apache License, Version 2.0."), (2, "Licensed under CC BY-NC 4.0."),
            (3, "apache license, no version"), (4, "general license public")]
    got = {g.doc_id: g for g in licenses.licenses(docs(spark, rows)).collect()}
    assert got[1].labels == "apache-2.0" and got[1].score == pytest.approx(1.0)
    assert got[2].labels == "cc-by,cc-by-nc" and got[2].first_word == 2
    assert got[3].labels == "" == got[4].labels and got[3].score == 0


# ------------------------------------------------------------------ empty tables

@pytest.mark.parametrize("operator", [exactdedup.exact_groups, tokencount.token_counts, tokenfile.token_file,
                                      minhash.near_groups, licenses.licenses])
def test_empty_table(spark, operator):
    assert operator(docs(spark, [])).collect() == []


def test_license_anchors_must_agree(spark):
    """A key phrase counts only where another anchor of its notice stands at its place."""
    rows = [(1, "some text mit license here"), (2, "this is licensed under the mit license"), (3, "licensed x under the mit license"),
            (4, "under licensed mit license the"), (5, "mit license " * 3 + "licensed under the mit license")]
    got = {g.doc_id: (g.labels, g.score) for g in licenses.licenses(docs(spark, rows)).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "", 2: "mit-named", 3: "mit-named", 4: "", 5: "mit-named"}
    assert got[2][1] == pytest.approx(1.0) and got[1][1] == 0 and 0 < got[3][1] < 1


def test_memo_keeps_what_is_asked_for_and_no_long_keys():
    asked = []
    memo = vocab.Memo(lambda w: asked.append(w) or len(w), limit=4, length=5)
    for k in range(20):
        assert memo["hot"] == 3 and memo[f"w{k}"] == len(f"w{k}") and memo["longer than five"] == 16
        assert len(memo) + len(memo.old) <= 4 and "longer than five" not in memo
    assert asked.count("hot") == 1
