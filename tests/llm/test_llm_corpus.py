"""Toxicity, decontamination, mixing and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from llm_fixtures import ROWS, docs, shingles

import corpus_pipeline
from ticklens.llm import decontam, minhash, mixing, toxicity
from ticklens.llm.common import read


@pytest.fixture(scope="module")
def corpus(spark):
    """300 clean and 100 toxic labelled documents, and the labels."""
    rnd = random.Random(7)
    words = [f"{a}{b}{c}" for a in "klmnprt" for b in "aeiou" for c in ("ra", "lo", "mi", "ta", "ven")]
    bad = ["zorkish", "grublin", "zorkery"]
    rows, labels = [], []
    for i in range(400):
        text = rnd.choices(words, k=rnd.randint(5, 80))
        if i % 4 == 0:
            for _ in range(1 + len(text) // 15):
                text.insert(rnd.randrange(len(text)), rnd.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 4 == 0)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


# ------------------------------------------------------------------ toxicity (5)

def test_held_out_accuracy(spark, corpus):
    table, labels, _ = corpus
    got = toxicity.toxicity(table, labels).join(labels, "doc_id").collect()
    held = [g for g in got if g.held_out]
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 3 == 1) for g in got)
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.7) for g in got)
    assert np.mean([g.predicted == g.toxic for g in held]) > 0.95


def test_labels_of_held_out_rows_change_nothing(spark, corpus):
    from pyspark.sql import functions as F
    table, labels, _ = corpus
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.learn(table, labels), toxicity.learn(table, flipped)
    assert one == two


def test_disguised_words_and_exceptions():
    found = toxicity.Lexicon({"^idiot": 5.0, "^trash$": 5.0}).automaton()
    measure = lambda t: toxicity.density(toxicity.folded_words(t), found)
    assert measure("an idiot") == measure("an 1d1ot") == measure("an іdiоt") == measure("an IDIOTTTT") > 0
    assert measure("no insult here") == 0 == measure("put it in the trash can") and measure("you trash") > 0
    assert measure("idiot") > measure("idiot " + "word " * 200)


def test_toxicity_of_odd_rows(spark, corpus):
    _, labels, _ = corpus
    got = toxicity.toxicity(docs(spark, extra=True), labels).collect()
    assert len(got) == len(ROWS) and all(g.score is not None and g.predicted == 0 for g in got)
    nothing = spark.createDataFrame([], labels.schema)
    assert toxicity.toxicity(docs(spark), nothing).count() == len(ROWS)
    assert toxicity.toxicity(docs(spark, []), labels).collect() == []


# ------------------------------------------------------------------ decontamination (8)

def containment_expected(rows, items):
    out = set()
    for i, t in rows:
        have = shingles(t)
        for k, q in items:
            want = shingles(q)
            if want and 100 * len(want & have) >= 75 * len(want):
                out.add((i, k, len(want), len(want & have)))
    return out


def test_containment_against_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = [f"v{k}" for k in range(3000)]
    items = [(k, " ".join(rnd.choices(vocabulary, k=rnd.choice((3, 5, 6, 9, 15, 33, 70, 300))))) for k in range(60)]
    items += [(60, items[0][1]), (61, None), (62, "")]
    rows = [(k, t) for k, t in ROWS if k is not None]
    for n in range(150):
        text = rnd.choices(vocabulary, k=rnd.choice((0, 20, 200, 3000)))
        if n % 3 == 0:
            passage = rnd.choice(items[:60])[1].split()
            if n % 2:                                    # one word changed
                passage[rnd.randrange(len(passage))] = "changed"
            at = rnd.randint(0, len(text))
            text = text[:at] + passage + text[at:]
        rows.append((1000 + n, " ".join(text)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contained_items(docs(spark, rows, extra=True), bench)
    expected = containment_expected(rows, items)
    assert {tuple(g[:4]) for g in got.collect()} == expected and len(expected) > 30
    # in passes of few items the result is the same
    again = decontam.contained_items(docs(spark, rows), bench, per_pass=7)
    assert {tuple(g[:4]) for g in again.collect()} == expected


def test_clean_documents_keep_all_columns(spark):
    bench = spark.createDataFrame([(1, ROWS[0][1])], "item_id long, text string")
    table = docs(spark, extra=True)
    kept = decontam.clean_documents(table, bench)
    assert kept.columns == table.columns and kept.count() == len(ROWS) - 3      # rows 1, 2 and the null id
    assert decontam.clean_documents(docs(spark, []), bench).collect() == []
    assert decontam.clean_documents(table, spark.createDataFrame([], bench.schema)).count() == len(ROWS)


# ------------------------------------------------------------------ mixing (1)

def brute_rates(tokens, p, targets, least, steps=5000):
    """Projected gradient in numpy, run to convergence."""
    rate = np.ones(len(tokens))
    weight = np.maximum(tokens @ p, 1e-300)
    for _ in range(steps):
        gap = (targets - (tokens * rate) @ p) / weight
        rate = np.maximum(least, rate + p @ gap)
    return rate


def test_an_unfinished_fit_is_told(spark, monkeypatch):
    rows = spark.createDataFrame([(100, 0.9, 0.1), (50, 0.2, 0.8)], "n_tokens long, p0 double, p1 double")
    monkeypatch.setattr(mixing, "ITERATIONS", 1)
    with pytest.warns(UserWarning, match="after 1 steps"):
        mixing.fitted_rates(rows, [120.0, 90.0])


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_rates_meet_the_targets(spark, least):
    rnd = np.random.default_rng(1)
    n, d = 300, 3
    tokens = rnd.integers(0, 500, n)
    p = rnd.dirichlet([0.2] * d, n)
    rows = spark.createDataFrame([(int(t), *map(float, q)) for t, q in zip(tokens, p)],
                                 "n_tokens long, p0 double, p1 double, p2 double")
    base = tokens @ p
    targets = base * np.array([1.0, 1.8, 1.3])
    got = mixing.fitted_rates(rows, targets.tolist(), least).toPandas()
    reached = (got.n_tokens.values * got.rate.values) @ got[["p0", "p1", "p2"]].values
    assert got.rate.min() >= least
    if least == 0:                      # with a least rate the first domain can't shrink to make room
        assert np.abs(reached / targets - 1).max() < 5e-3
    best = brute_rates(tokens, p, targets, least)
    assert np.abs((tokens * best) @ p - reached).max() / targets.max() < 1e-2


def test_posteriors_against_numpy(spark, corpus):
    table, _, rows = corpus
    labelled = docs(spark, [(i, t) for i, t in rows if i % 3]).selectExpr(
        "text", "case when text like '%zork%' then 'z' else 'n' end as domain")
    model = mixing.Classifier(labelled)
    assert model.domains == ["n", "z"]
    got = model.posteriors(docs(spark, rows[:50])).toPandas().sort_values("doc_id")
    weights = {r.ending: (r.w0, r.w1) for r in model.weights.collect()}
    for (i, t), g in zip(rows[:50], got.itertuples()):
        known = [weights[w[-3:]] for w in t.split() if w[-3:] in weights]
        logs = np.log(model.priors) + np.sum(known, axis=0) * mixing.EVIDENCE / max(len(known), mixing.EVIDENCE)
        p = np.exp(logs - logs.max())
        assert g.doc_id == i and g.n_tokens == len(t.split()) and abs(g.p0 - p[0] / p.sum()) < 1e-9


def test_mixing_of_odd_rows(spark, corpus):
    table, labels, _ = corpus
    model = mixing.labelled_domains(table, labels)
    got = mixing.mix(docs(spark, extra=True), model).collect()
    assert len(got) == len(ROWS) and all(g.rate >= 0 and g.copies in (int(g.rate), int(g.rate) + 1) for g in got)
    again = mixing.repeated(docs(spark, extra=True), model)
    assert again.columns == docs(spark, extra=True).columns and again.count() >= len(ROWS)
    assert mixing.mix(docs(spark, []), model).collect() == []
    unlabelled = mixing.labelled_domains(table, spark.createDataFrame([], labels.schema))
    assert {g.rate for g in mixing.mix(docs(spark), unlabelled).collect()} == {1.0}


def test_unknown_target_domain(spark, corpus):
    table, labels, _ = corpus
    with pytest.raises(ValueError, match="unknown domains"):
        mixing.mix(table, mixing.labelled_domains(table, labels), {"nowhere": 1.0})


# ------------------------------------------------------------------ pipeline

def test_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs_in = read(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs_in.collect()}
    items = [(r.item_id, r.text) for r in read(spark, sf, "benchmark").collect()]
    steps = {}
    current = docs_in
    for name, stage in corpus_pipeline.STAGES:
        steps[name] = current = corpus_pipeline.stored(stage(spark, current, sf), name)
        if name != "token_ids":
            assert current.columns == docs_in.columns
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in steps.items()}
    lexicon = toxicity.learn(docs_in, read(spark, sf, "labels"))
    found = lexicon.automaton()
    density = {i: toxicity.density(toxicity.folded_words(t or ""), found) for i, t in texts.items()}
    clean = {i for i, x in density.items() if 1 / (1 + np.exp(-(lexicon.intercept + lexicon.slope * x))) < 0.7}
    assert set(ids["toxicity"]) == clean
    from llm_fixtures import near_components
    expected = {i for i, _, c in near_components([(i, texts[i]) for i in sorted(clean)]) if i == c}
    assert set(ids["minhash_near_dedup"]) == expected
    leaks = {i for i, *_ in containment_expected([(i, texts[i]) for i in expected], items)}
    assert set(ids["decontamination"]) == expected - leaks
    assert set(ids["mixing"]) == expected - leaks and len(ids["mixing"]) >= len(expected - leaks)
    assert sorted(ids["token_ids"]) == sorted(ids["mixing"])
    assert corpus_pipeline.run(spark, sf).count() == len(ids["token_ids"])


def test_pipeline_of_odd_and_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    for rows in (ROWS, []):
        current = docs(spark, rows, extra=True)
        for name, stage in corpus_pipeline.STAGES:
            current = corpus_pipeline.stored(stage(spark, current, sf), name)
        got = [r.doc_id for r in current.collect()]
        assert (1 in got and 2 not in got and None in got) if rows else got == []


def test_near_dedup_keeps_one_of_each_group(spark):
    assert minhash.PERCENT == 75 and minhash.shingles.WORDS == 5


def test_unlike_labelled_texts_all_count(spark):
    """Only equal texts (but for case and white space) are one; common words shared by all change nothing."""
    import xxhash
    words = sorted((f"w{k}" for k in range(500)), key=xxhash.xxh3_64_intdigest)
    rows = [(i, f"{words[0]} {words[1]} {words[2 + i]} {words[200 + i]}") for i in range(60)]
    copies = [(100 + i, t.upper().replace(" ", " \n")) for i, t in rows]
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows + copies], "doc_id long, quality int, toxic int")
    got = [r.text for r in toxicity.training_rows(docs(spark, rows + copies), labels).collect()]
    learnt = {t.lower().replace("\n", "") for i, t in rows + copies if zlib.crc32(str(i).encode()) % 3 != 1}
    assert {t.lower().replace("\n", "") for t in got} == learnt and len(got) == len(learnt) > 40
    # the representative is the row with the smallest doc_id
    first = {t for i, t in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert first <= set(got)


@pytest.mark.parametrize("text", [
    "an 1dïot", "an іdïot", "an 1diøt", "an !diot", "an idiot!", "an !d!ot!", "an id\u200biot", "an i\u00addi\u00adot",
    "an i\u0336d\u0336i\u0336o\u0336t", "an ｉｄｉｏｔ", "an ＩＤＩＯＴ", "an \U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d", "an @idiot", "an id\u200bïot"])
def test_disguises(text):
    found = toxicity.Lexicon({"^idiot": 5.0}).automaton()
    assert toxicity.density(toxicity.folded_words(text), found) == toxicity.density(["an", "idiot"], found) > 0


def test_signs_at_the_edges_and_foreign_words():
    found = toxicity.Lexicon({"^asshole$": 5.0, "^stupid$": 4.0, "^ass$": 3.0, "^trash$": 2.0}).automaton()
    measure = lambda t: toxicity.density(toxicity.folded_words(t), found) * 51 ** toxicity.LENGTH_POWER
    assert [round(measure(t), 9) for t in ("@sshole", "$tupid", "$tupid!", "a$$", "as$", "stupid!!!")] == [5, 4, 4, 3, 3, 4]
    assert measure("$trash can!") == 0 == measure("100$ @ !!! $5")
    for word in ("naïve", "été", "größe", "мой", "café", "bøde", "çalışıyor"[:3]):
        assert toxicity.folded_words(word) == [word]
    assert toxicity.folded_words("café") == ["café"]
    assert len(toxicity.folded_words("!" * 300_000 + "$@" * 300_000)) == 0


def test_one_block_of_items_is_held_at_a_time(spark, monkeypatch):
    """A benchmark beyond a pass is searched block by block, each within both bounds, each item once."""
    sizes = []
    inner = decontam._searched
    monkeypatch.setattr(decontam, "_searched", lambda part: sizes.append([len(t) for _, t in part]) or inner(part))
    items = [(k, " ".join(f"b{k}x{j}" for j in range(6 + k % 9))) for k in range(50)]
    rows = [(i, f"start {items[i % 50][1]} end {items[(i + 7) % 50][1]}" if i % 2 else "no item in this text") for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    got = decontam.contained_items(docs(spark, rows), bench, per_pass=7)
    assert {tuple(g[:4]) for g in got.collect()} == containment_expected(rows, items) and got.count() == 60
    assert len(sizes) >= 8 and max(map(len, sizes)) <= 7 and sum(map(len, sizes)) == 50
    plan = got._jdf.queryExecution().toString()
    assert "search(" not in plan and "ArrowEvalPython" not in plan          # written results, no pass is left to run
    kept = decontam.clean_documents(docs(spark, rows, extra=True), bench, per_pass=7)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 60, 2)) and kept.columns == docs(spark, extra=True).columns
    total = sum(len(t) for _, t in items)
    n, blocks = decontam._item_blocks(bench, 1000, total // 4)
    blocks = list(blocks)
    assert n == len(blocks) >= 4 and sorted(i for b in blocks for i, _ in b) == list(range(50))
    assert all(sum(len(t) for _, t in b[:-1]) <= total // 4 for b in blocks)


def naive_density(words, weights, exceptions):
    """The rule of ``toxicity.density`` with plain comparisons, for words of one reading."""
    spared = {k + j for p in exceptions for k in range(len(words) - 1) if words[k:k + 2] == p.split() for j in (0, 1)}
    total = 0.0
    for k, word in enumerate(words):
        fits = [w for e, w in weights.items() if (word == e[1:-1] if e.endswith("$") else word.startswith(e[1:]))]
        total += 0.0 if k in spared else max(fits, default=0.0)
    return total / (len(words) + toxicity.LENGTH_PAD) ** toxicity.LENGTH_POWER if words else 0.0


def test_automaton_against_naive_search():
    rnd = random.Random(11)
    words = ["".join(rnd.choices("abc", k=rnd.randint(1, 6))) for _ in range(60)]
    for _ in range(200):
        weights = {e: rnd.uniform(0.5, 5) for e in rnd.sample([f"^{w}" for w in words] + [f"^{w}$" for w in words], 12)}
        exceptions = tuple(f"{rnd.choice(words)} {rnd.choice(words)}" for _ in range(10))
        text = rnd.choices(words, k=rnd.randint(0, 50))
        found = toxicity.Lexicon(weights, exceptions).automaton()
        assert toxicity.density(text, found) == pytest.approx(naive_density(text, weights, exceptions))


def test_lexicon_of_real_rows(spark):
    """Held-out figures over 10,000 documents; every entry is in a larger share of toxic rows than of clean ones."""
    sf = "/root/testdata/sf0.1"
    table, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    lexicon = toxicity.learn(table, labels)
    got = (table.select("doc_id", toxicity.held_out().alias("held"), toxicity.score(toxicity.text_of(), lexicon).alias("s"))
           .join(labels.where("toxic in (0, 1)").select("doc_id", "toxic"), "doc_id").where("held")
           .selectExpr("sum(toxic) toxic", "count_if(s >= 0.7) said", "count_if(s >= 0.7 and toxic = 1) right").first())
    assert got.right >= 0.9 * got.toxic and got.right >= 0.95 * got.said
    share = {0: {}, 1: {}}
    sizes = {0: 0, 1: 0}
    for r in toxicity.training_rows(table, labels).collect():
        sizes[r.toxic] += 1
        for e in {e for w in toxicity.folded_words(r.text) for v in w.split("\n") if v for e in toxicity._entries(v)}:
            share[r.toxic][e] = share[r.toxic].get(e, 0) + 1
    assert 20 < len(lexicon.weights) < 200
    for e in lexicon.weights:
        assert share[1][e] / sizes[1] > 2 * share[0].get(e, 0) / sizes[0]


def test_a_repeated_labelled_id_counts_once(spark):
    rows = [(5, f"text {k} of the same identifier") for k in range(50)] + [(3, "another text"), (6, "third text")]
    labels = spark.createDataFrame([(3, 1, 0), (5, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    usable = [i for i in (3, 5, 6) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert toxicity.training_rows(docs(spark, rows), labels).count() == len(usable)
    assert mixing.labelled_domains(docs(spark, rows), labels).count() == 3


def test_short_items_inside_long_documents(spark):
    """Items of one to four words are found wherever their words stand; longer ones by the shingle rule."""
    rnd = random.Random(9)
    vocabulary = [f"v{k}" for k in range(60)]
    items = [(k, " ".join(rnd.choices(vocabulary, k=1 + k % 7))) for k in range(40)] + [(40, None), (41, " "), (42, "V1 \n v2"), (43, "v1 v2")]
    rows = [(k, t) for k, t in ROWS if k is not None] + [(100 + n, " ".join(rnd.choices(vocabulary, k=rnd.choice((0, 1, 3, 40, 3000)))))
                                                         for n in range(60)]
    expected = {x for x in containment_expected(rows, [(k, q) for k, q in items if len((q or "").split()) >= 5])}
    for i, t in rows:
        have = (t or "").lower().split()
        for k, q in items:
            want = (q or "").lower().split()
            if 0 < len(want) < 5 and any(have[j:j + len(want)] == want for j in range(len(have))):
                expected.add((i, k, 1, 1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for per_pass in (1000, 7):
        got = decontam.all_contained_items(docs(spark, rows, extra=True), bench, per_pass=per_pass).collect()
        assert {tuple(g[:4]) for g in got} == expected and len(got) > 100
    assert decontam.all_contained_items(docs(spark, []), bench).collect() == []
    assert decontam.all_contained_items(docs(spark, rows), bench.where("false")).collect() == []
