"""Cases in which an operator once gave, or could give, a wrong result."""

import json
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bloom, decontamination, language_id, line_dedup, lm_scores, media_chunks, near_dedup, sharding, token_count, toxicity
from corpusloom.operators.graph import similar

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
BIG = (1 << 60) + 1


@pytest.fixture(scope="module")
def toxic_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = docs.join(labels, "doc_id").where("text is not null").collect()
    return toxicity.fit_toxicity(docs, labels), [(r["text"], r["toxic"]) for r in rows]


@needs_data
@pytest.mark.parametrize("size", [1 << 20, 10 << 20])
def test_length_makes_no_text_toxic(toxic_model, size):
    model, rows = toxic_model
    clean = [t for t, y in rows if y == 0 and toxicity.score_text(t, model)[0] < 0.5]
    bad = max((s for t, y in rows if y == 1 for s in [(sc, t[a:b]) for a, b, sc in toxicity.score_text(t, model)[1]]))[1]
    joined = "\n".join(clean)
    joined = (joined + "\n") * (size // len(joined) + 1)
    single = max(clean, key=lambda t: toxicity.score_text(t, model)[0])
    for text in (joined, (single + "\n") * (size // len(single) + 1)):
        assert toxicity.score_text(text, model)[0] < 0.5
        half = len(text) // 2
        score, spans = toxicity.score_text(text[:half] + "\n" + bad + ".\n" + text[half:], model)
        assert score >= 0.5 and any(abs(a - half) < 50 + len(bad) for a, _, _ in spans)


@needs_data
def test_toxicity_against_brute_force(toxic_model, spark):
    model, rows = toxic_model
    rows = rows[:80] + [("", 0), (None, 0), ("...", 0)]
    got = {r["i"]: r["score"] for r in toxicity.score_toxicity(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i long, text string"), model, "i").collect()}
    for i, (text, _) in enumerate(rows):
        z = []
        for _, _, ws in toxicity.sentences(text or ""):
            found = [f for w in set(ws) for f in toxicity.word_features(w, model.bits)]
            z.append(model.bias + sum(model.weights.get(f, 0.0) for f in found))
        z = np.array(z)
        left = np.prod(1 - 1 / (1 + np.exp(-model.slope * z))) * (1 - 0.1 * min(0.5, 1 / (1 + np.exp(-z.max())))) if len(z) else 1.0
        assert got[i] == pytest.approx(1 - left, abs=1e-9)


def test_ids_beyond_doubles_beside_nulls(spark):
    text = "The quick brown fox jumps over the lazy dog near the old stone bridge at noon"
    docs = spark.createDataFrame([(BIG, text), (None, text), (BIG + 1, "other words here"), (BIG + 2, None)], "doc_id long, text string").coalesce(1)
    want = {BIG, None, BIG + 1, BIG + 2}
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    bench = spark.createDataFrame([(BIG, text), (None, "nothing of the kind stands here")], "item_id long, text string").coalesce(1)
    found = decontamination.find_contamination(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(BIG, BIG), (None, BIG)}
    assert ids(lm_scores.score_documents(docs)) == want
    assert ids(line_dedup.dedup_lines(docs)) == want and ids(near_dedup.near_duplicates(docs)) == want
    assert {r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == want
    assert ids(media_chunks.media_features(docs)) == want and ids(sharding.shard_documents(docs, 2)) == want and ids(token_count.count_tokens(docs)) == want
    named = docs.select(F.concat(F.lit("x"), "doc_id").alias("doc_id"), "text")
    assert ids(lm_scores.score_documents(named)) == {f"x{BIG}", None, f"x{BIG + 1}", f"x{BIG + 2}"}


@pytest.mark.parametrize("common", [2, 64])
def test_common_windows_change_no_result(spark, common):
    """Items that share boilerplate, items of boilerplate alone, equal items: the same pairs, however few items make a window common."""
    rng = random.Random(4)
    lead = "the following are multiple choice questions with answers about the history of the river"
    items = {i: f"{lead} {' '.join(''.join(rng.choice('abcdefgh') for _ in range(6)) for _ in range(14))}" for i in range(12)}
    items |= {20: lead, 21: lead, 22: f"{lead} and more", 23: items[0]}
    texts = {i: f"Before it. {items[i]} after it" for i in (0, 3, 22)} | {50: f"So {lead}, it says", 51: " ".join(items[5].split()[8:]), None: items[7], 52: "nothing of the kind"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_contamination(docs, bench, common=common).collect()}
    split = lambda t: t.replace(",", "").replace(".", "").lower().split()
    windows = lambda t: {tuple(split(t)[i : i + 8]) for i in range(len(split(t)) - 7)}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if 2 * len(windows(t) & windows(x)) >= len(windows(x)) or len(windows(t) & windows(x)) >= 13}
    assert got == want and (0, 23) in got


def test_decontamination_stage_keeps_clean_neighbours(spark, tmp_path):
    text = "The quick brown fox jumps over the lazy dog near the old stone bridge at noon"
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(BIG, text), (BIG - 1, "clean words"), (None, text)], "doc_id long, text string")
    assert {r["doc_id"] for r in decontamination.stage(spark, docs, str(tmp_path)).collect()} == {BIG - 1, None}


def test_line_dedup_leaves_callers_columns(spark):
    docs = spark.createDataFrame([(i, f"shared\nown {i}", 777, "x", 5) for i in range(10)], "doc_id long, text string, n_lines long, N_DROPPED string, n_chars int")
    kept = line_dedup.stage(spark, docs, "").collect()
    assert all((r["n_lines"], r["N_DROPPED"], r["text"], r["n_chars"]) == (777, "x", f"own {r['doc_id']}", 5) for r in kept)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines_", "n_dropped_"] and {r["n_dropped_"] for r in out.collect()} == {1}


def _sentence(rng, n, words="w"):
    return [f"{words}{rng.randrange(5000)}" for _ in range(n)]


def test_repeated_ids_are_linked_by_their_own_text(spark):
    rng = random.Random(1)
    base, other = _sentence(rng, 200), _sentence(rng, 200, "o")
    near = lambda k: " ".join(base[:k] + ["changed"] + base[k + 1 :])
    rows = [(1, near(20)), (2, near(150)), (2, " ".join(other)), (3, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(1, 1, True), (2, 1, False), (2, 2, True), (3, 1, False)]
    assert sorted((r["doc_id"], r["text"][:1]) for r in near_dedup.stage(spark, docs, "").collect()) == [(1, "w"), (2, "o")]


def _brute_components(texts, percent=85):
    hashes = near_dedup._WordHashes()
    sets = [near_dedup.shingles(t, hashes) for _, t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            if len(sets[i]) and len(sets[j]) and similar(sets[i], sets[j], percent):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {texts[i][0]: texts[root(i)][0] for i in range(len(texts))}


@pytest.mark.parametrize("most", [1 << 20, 2500])
def test_chains_and_half_similar_groups(spark, most):
    """Chains of near copies, groups whose members are candidates but only partly linked, ties and copies."""
    rng = random.Random(7)
    texts, n = [], 0
    for _ in range(3):  # each text differs from the one before by some words: neighbours are linked, ends are not
        ws = _sentence(rng, 150)
        for _ in range(25):
            for _ in range(2):
                ws[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
            texts.append((n, " ".join(ws)))
            n += 1
    core = _sentence(rng, 150)  # two versions of a text, about 0.7 similar, with near copies each, and outsiders between
    for version in range(2):
        own = core[:130] + _sentence(rng, 20, f"v{version}_")
        for _ in range(20):
            ws = list(own)
            ws[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
            texts.append((n, " ".join(ws)))
            n += 1
    for _ in range(20):
        texts.append((n, " ".join(core[:130] + _sentence(rng, 20, f"u{n}_"))))
        n += 1
    texts.append((n, texts[0][1]))
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), bands=120, rows=5, most=most).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == _brute_components(texts)


def test_a_group_of_five_thousand(spark):
    rng = random.Random(3)
    base = _sentence(rng, 120)
    texts = []
    for i in range(5000):
        ws = list(base)
        ws[rng.randrange(120)] = f"z{i}"
        texts.append((i, " ".join(ws)))
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(8)).collect()
    assert {r["component_id"] for r in got} == {0} and [r["doc_id"] for r in got if r["kept"]] == [0]


@pytest.mark.parametrize("about", [10, 100, 1 << 24])
def test_ranges_hold_all_repeats_whatever_the_guess(spark, about, monkeypatch):
    monkeypatch.setattr(bloom, "_RANGE_KEYS", 1 << 20)
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 64, 30_000, dtype=np.uint64))
    again = keys[:300]
    df = spark.createDataFrame([(int(k),) for k in np.concatenate([keys, again]).view(np.int64)], "k long").repartition(9)
    twice = bloom.repeated(df, lambda p: p["k"].to_numpy(np.int64).view(np.uint64), about)
    assert twice.has(again).all()
    assert about <= 100 or twice.has(keys[300:]).mean() < 0.05 and len(twice.data) < 1 << 14


def test_language_against_brute_force(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der Hund und die Katze", "de")] * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_language_model(language_id.training_rows(docs), bits=12)
    train = [(t, l) for i, t, l in rows if zlib.crc32(str(i).encode()) % 5]
    grams = lambda t, n: [int(h) for h in language_id._hashed(language_id._code_points(t), n, n - 2, 12)]
    tests = ["the dog", "le chien", "die Katze und der Hund", "x", "é", "the\nle", "İ Katze"]
    got = {r["t"]: (r["p"]["lang_pred"], r["p"]["score"]) for r in spark.createDataFrame([(t,) for t in tests], "t string").select("t", language_id.predict_language(spark, model, F.col("t")).alias("p")).collect()}
    langs = sorted({l for _, l in train})
    assert model.languages == tuple(langs)
    counts = {l: {n: np.bincount([g for t, x in train if x == l for g in grams(t.lower() + "\n" * (n - 1), n)], minlength=2 << 12) for n in (2, 3)} for l in langs}
    for text in tests:
        logs = []
        for l in langs:
            total = -np.log(len(langs))
            for n in (2, 3):
                table = counts[l][n][(n - 2) << 12 : (n - 1) << 12] + 0.1
                total += sum(np.log(table[g - ((n - 2) << 12)] / table.sum()) for g in grams(text.lower() + "\n" * (n - 1), n))
            logs.append(total)
        odds = np.exp(np.array(logs) - max(logs))
        assert got[text][0] == langs[int(np.argmax(logs))] and got[text][1] == pytest.approx(odds.max() / odds.sum(), rel=1e-3)


def test_language_scores_in_blocks_are_the_same(spark, monkeypatch):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 6)], "doc_id long, text string, lang string")
    model = language_id.fit_language_model(docs, bits=12)
    texts = ["".join(rng.choice("abc déİ\n") for _ in range(n)) for n in (1, 2, 6, 7, 8, 9, 30, 2, 100)]
    want = [language_id.score_texts([t], model)[0] for t in texts]
    monkeypatch.setattr(language_id, "_BLOCK", 7)
    assert np.allclose(language_id.score_texts(texts, model), want, atol=1e-4)


@pytest.mark.parametrize("dealt", ["as planned", "elsewhere", "split", "at random", "to one"])
def test_lm_counts_come_back_however_rows_are_dealt(spark, monkeypatch, dealt):
    """Small batches; and hashes that are not where the block thinks, so they travel themselves."""
    rng = random.Random(6)
    docs = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(300)))) for i in range(60)]
    monkeypatch.setattr(lm_scores, "_AT_ONCE", 500)
    monkeypatch.setattr(lm_scores, "_BLOCK_BYTES", 9000)
    if dealt == "elsewhere":
        monkeypatch.setattr(lm_scores, "_partition", lambda h, parts: (h % np.uint64(3)).astype(np.int32))
    scored, odd = lm_scores._scored, F.col("h").bitwiseAND(8) == 0
    deal = {
        "split": lambda rows: rows.where(odd).unionAll(rows.where(~odd)),  # two sorted tasks for each partition
        "at random": lambda rows: rows.repartition(7),
        "to one": lambda rows: rows.coalesce(1),
    }.get(dealt, lambda rows: rows)
    monkeypatch.setattr(lm_scores, "_scored", lambda blocks, counted, *more: scored(blocks, deal(counted), *more))
    uni, bi = {}, {}
    for _, t in docs:
        ws = t.split()
        for k, w in enumerate(ws):
            uni[w] = uni.get(w, 0) + 1
            if k:
                bi[ws[k - 1], w] = bi.get((ws[k - 1], w), 0) + 1
    total = sum(uni.values())
    got = {r["doc_id"]: r["score"] for r in lm_scores.score_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    for i, t in docs:
        ws = t.split()
        logs = [np.log(bi[ws[k - 1], w] / uni[ws[k - 1]]) if k and bi[ws[k - 1], w] >= 2 else (np.log(0.4) if k else 0) + np.log(uni[w] / total) for k, w in enumerate(ws)]
        assert got[i] == (pytest.approx(np.mean(logs), abs=1e-9) if ws else None)


def test_stray_labels_are_bounded(spark):
    rows = [(i, "the cat and the dog " * 5, "en") for i in range(20)] + [(100 + i, "un chat", f"stray{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_language_model(docs, bits=10, most_languages=3)
    assert len(model.languages) == 3 and "en" in model.languages


def test_language_stage_uses_its_prediction(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 10)] + [(90, "the dog and the cat", None), (91, "12 34", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["lang"] for r in language_id.stage(spark, docs, "").collect()}
    assert kept[90] == "en" and 91 not in kept and len(kept) == 21
    assert set(r["lang"] for r in language_id.stage(spark, docs, "", ["en"]).collect()) == {"en"}


def test_token_counts_refuse_other_rules(tmp_path):
    with open(token_count.tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as handle:
        spec = json.load(handle)
    changes = [
        {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": None}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}},
        {"model": spec["model"] | {"end_of_word_suffix": "</w>"}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]},
    ]
    for k, change in enumerate(changes):
        (tmp_path / f"{k}.json").write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError, match="not supported"):
            token_count.TokenCounter(str(tmp_path / f"{k}.json"))
    other = spec | {"added_tokens": [spec["added_tokens"][0] | {"content": "[STOP]"}]}
    (tmp_path / "other.json").write_text(json.dumps(other), encoding="utf-8")
    assert token_count.TokenCounter(str(tmp_path / "other.json")).count("a[STOP]b") == 3
