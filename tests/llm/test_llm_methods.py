"""The operators against brute force, exact round trips and held-out accuracy."""

import math
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import bloom, decontamination, language_id, line_dedup, media_chunks, near_dedup, packing, queries, sharding, token_count, toxicity
from corpusloom.operators.graph import links, similar

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab 1'\n\tst<|endoftext|>éß", max_size=60))
def test_counts_are_the_librarys(text):
    from tokenizers import Tokenizer

    path = token_count.tokenizer_path("byte_bpe_50k.json")
    lib = _cached("count", lambda: (Tokenizer.from_file(path), token_count.TokenCounter(path)))
    assert lib[1].count(text) == len(lib[0].encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text(alphabet="abAB 1'\n\tstéßİ", max_size=40), max_size=4))
def test_ids_are_the_librarys(texts):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("word_bpe_49k.json")
    lib = _cached("ids", lambda: (Tokenizer.from_file(path), packing.WordTokenizer(path)))
    want = [np.array(lib[0].encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(lib[1].ids(texts)) == want


_KEPT = {}


def _cached(name, make):
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


@pytest.mark.parametrize("seed", range(4))
def test_patterns_cover_and_are_near_the_bound(seed):
    rng = random.Random(seed)
    demand = Counter(rng.randrange(1, 65) for _ in range(400 * (seed + 1)))
    patterns = packing.solve_patterns(dict(demand), 64)
    have = Counter()
    for p, times in patterns:
        assert sum(c * n for c, n in p.items()) <= 64
        for c, n in p.items():
            have[c] += n * times
    assert all(have[c] >= n for c, n in demand.items())
    assert sum(t for _, t in patterns) <= 1.03 * sum(c * n for c, n in demand.items()) / 64 + 2


def test_chunks_rebuild_and_follow_content():
    rng = random.Random(0)
    data = bytes(rng.randrange(256) for _ in range(60_000))
    a, b = media_chunks.chunk_all([data, b"inserted" + data])
    assert b"".join(a) == data and all(media_chunks.LEAST <= len(c) <= media_chunks.MOST for c in a[:-1])
    assert len(set(a) & set(b)) >= len(a) - 3
    assert media_chunks.chunk_all([data[:100], data])[1] == a and media_chunks.samples(media_chunks.wav(data)) == data


def test_sketch_is_full_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100, 5000):
        s = near_dedup.sketch(np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)), 540)
        assert (s > 0).all()
    x = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    a, b = x[:360], x[40:]
    assert abs((near_dedup.sketch(a, 2000) == near_dedup.sketch(b, 2000)).mean() - 320 / 400) < 0.05


def test_twice_filter_has_all_repeats(spark):
    rng = random.Random(2)
    keys = [rng.getrandbits(63) for _ in range(4000)]
    rows = [(k,) for k in keys + keys[:500]]
    df = spark.createDataFrame(rows, "k long").repartition(7)
    twice = bloom.repeated(df, lambda p: p["k"].to_numpy(np.int64).view(np.uint64), 4000)
    arr = np.array(keys, np.int64).view(np.uint64)
    assert twice.has(arr[:500]).all() and twice.has(arr[500:]).mean() < 0.05


def test_links_span_the_similar_pairs():
    rng = random.Random(4)
    base = [rng.getrandbits(60) for _ in range(80)]
    sets = []
    for _ in range(120):
        s = list(base)
        for k in rng.sample(range(80), rng.randrange(25)):
            s[k] = rng.getrandbits(60)
        sets.append(np.unique(np.array(s, np.uint64)))
    full = [(i, j) for i in range(120) for j in range(i + 1, 120) if similar(sets[i], sets[j], 85)]
    assert _groups(links(sets, 85), 120) == _groups(full, 120) and set(links(sets, 85)) <= set(full)
    cross = [p for p in full if p[0] < 50 <= p[1]]
    assert _groups(links(sets, 85, 50, cross=True), 120) == _groups(cross, 120)


def _groups(pairs, n):
    p = list(range(n))

    def root(i):
        while p[i] != i:
            i = p[i]
        return i

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        p[y] = x
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("most", [1 << 20, 700])
def test_near_dedup_against_brute_force(spark, most):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        ws = list(base) if i % 3 else [f"u{rng.randrange(900)}" for _ in range(120)]
        for _ in range(rng.randrange(4)):
            ws[rng.randrange(120)] = f"X{rng.randrange(99)}"
        texts.append((i, " ".join(ws)))
    hashes = near_dedup._WordHashes()
    sets = [near_dedup.shingles(t, hashes) for _, t in texts]
    want = _groups([(i, j) for i in range(60) for j in range(i + 1, 60) if similar(sets[i], sets[j], 85)], 60)
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), most=most).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want))


def test_templates_catch_changed_numbers_and_names(spark):
    item = "A train leaves Boston at 40 km per hour and after 3 hours it meets another train from Chicago going at 40 km per hour"
    same = item.replace("40", "65").replace("Boston", "Denver").replace("3 hours", "7 hours")
    odd = item.replace("at 40 km per hour and", "at 65 km per hour and")
    plain = "Nothing here has to do with any of the questions but it is a long enough sentence to have windows of its own"
    docs = spark.createDataFrame([(1, "Before. " + same + " after."), (2, plain), (3, item.upper().lower()), (4, odd)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r["doc_id"]: r["reparameterised"] for r in decontamination.find_contamination(docs, bench, literals=4).collect()}
    assert got[1] is True and 2 not in got
    assert 4 not in got or got[4] is False


def test_verbatim_copies_in_upper_case_are_found(spark):
    item = "The die Straße runs past the old mill and the bridge, where nobody has lived since the river rose"
    docs = spark.createDataFrame(
        [(1, "NEWS OF THE DAY " + item.upper() + " AND MORE"), (2, item), (3, "ALL OF THIS IS IN UPPER CASE BUT NOT ONE PASSAGE OF IT IS COPIED")], "doc_id long, text string"
    )
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.find_contamination(docs, bench).collect()}
    assert set(got) == {1, 2} and all(r["windows"] == r["item_windows"] and not r["reparameterised"] for r in got.values())


def test_short_items_and_items_of_few_words_are_found(spark):
    items = {
        1: "What is the capital of France?", 2: "Who wrote Pride and Prejudice?", 3: "Compute 3 + 5 * 7 - 12 / 4 + 8 * 2 - 6 / 3 + 1.",
        4: "Evaluate 45 km / 3 h + 60 km / 4 h in km per hour.", 5: "how far is it to Boston", 6: "Photosynthesis", 7: "...", 8: "", 9: None,
    }
    filler = "a sentence that is long enough to have a number of windows of its own."
    texts = {k: f"Here is {filler} {t} And so on, {filler}" for k, t in items.items() if k < 7}
    texts |= {10: filler, 11: f"So {filler} how far is it to Denver, they asked.", 12: "Paris", 13: "", 14: "PHOTOSYNTHESIS", 15: f"What is the capital of all, {filler}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = decontamination.find_contamination(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (11, 5), (14, 6)]
    assert [r["doc_id"] for r in got if r["reparameterised"]] == [11]


def test_shards_are_near_equal_and_keep_groups(spark):
    rng = random.Random(1)
    texts = [(i, "x" * rng.randrange(1, 400)) for i in range(3000)] + [(5000 + i, "same text " * 9) for i in range(1500)]
    rows = sharding.shard_documents(spark.createDataFrame(texts, "doc_id long, text string"), 24).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 24
    assert len(sizes) == 24 and max(abs(v - mean) for v in sizes.values()) < 0.03 * mean
    assert all(r["text_crc32"] == zlib.crc32(t.encode()) for r, t in zip(sorted(rows, key=lambda r: r["doc_id"]), [t for _, t in texts]))


def test_line_dedup_text_round_trip(spark):
    docs = spark.createDataFrame([(i, f" Shared LINE\t\nown {i}\n\n") for i in range(10)], "doc_id long, text string")
    got = line_dedup.dedup_lines(docs).collect()
    assert all(r["text"] == f"own {r['doc_id']}\n\n" and r["n_dropped"] == 1 for r in got)


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    want = sorted(con.execute(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall(), key=repr)
    assert got == want


@pytest.mark.parametrize("lang", [None, "en"])
def test_language_stage_keeps_letters_without_labels(spark, lang):
    ids = [i for i in range(60) if lang is None or zlib.crc32(str(i).encode()) % 5 == 0]  # all held out where they are labelled
    docs = spark.createDataFrame([(i, t, lang) for i, t in zip(ids, ["some text", "12 34", "", None, "ü"])], "doc_id long, text string, lang string")
    kept = language_id.stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["text"] for r in kept.collect()) == ["some text", "ü"]


@needs_data
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_id_rows(spark)
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    scored = [r for r in queries.QUERIES["op1_toxicity"](spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in scored) >= 0.95 * len(scored)


def language_id_rows(spark):
    return queries.QUERIES["op6_language_id"](spark, SF).collect()


@needs_data
def test_decontamination_against_plain_windows(spark):
    found = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op2_decontamination"](spark, SF).collect()}
    token = decontamination._TOKEN
    split = lambda t: [w.lower() for w in token.findall(t) if w[0].isalnum()]
    items = {r["item_id"]: split(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    where = {}
    for k, ws in items.items():
        for i in range(len(ws) - 7):
            where.setdefault(tuple(ws[i : i + 8]), set()).add(k)
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ws, hits = split(r["text"]), {}
        for i in range(len(ws) - 7):
            for k in where.get(tuple(ws[i : i + 8]), ()):
                hits.setdefault(k, set()).add(tuple(ws[i : i + 8]))
        for k, h in hits.items():
            if len(h) >= 13 or 2 * len(h) >= len({tuple(items[k][i : i + 8]) for i in range(len(items[k]) - 7)}):
                want.add((r["doc_id"], k))
    assert want <= found and len(found - want) <= 0.1 * len(want)


@needs_data
def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline as pipeline

    small = str(tmp_path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(f"{small}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{small}/benchmark.parquet")
    before = docs.collect()
    kept = dict(pipeline.STAGES)["language_id"](spark, docs, small)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")}
    lines = dict(pipeline.STAGES)["line_dedup"](spark, kept, small)
    counts = Counter(k for r in kept.collect() for k in {line_dedup.line_key(x) for x in r["text"].encode().split(b"\n")})
    for r, old in zip(sorted(lines.collect()), sorted(kept.collect())):
        want = b"\n".join(x for x in old["text"].encode().split(b"\n") if not line_dedup.line_key(x) or counts[line_dedup.line_key(x)] < 10).decode()
        assert r["text"] == want and r["n_chars"] == len(want)
    final = pipeline.run(spark, small).collect()
    sequences = {}
    for r in final:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rs in sequences.values():
        assert sum(n for _, n in rs) <= 2048 and all(o == sum(n for p, n in rs if p < o) for o, _ in rs)
    assert {r["doc_id"] for r in final} <= {r["doc_id"] for r in before} and math.isfinite(len(final))
