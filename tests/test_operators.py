import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus, dedup, generation, matching, rag, sampling, scoring, vector_search
from corpusloom.plans import etl, providers


def test_column_choice():
    assert corpus.choose_text_column(["Full Text", "Abstract"], "source_papers_1.parquet") == "Abstract"
    assert corpus.choose_text_column(["Full Text", "Abstract"], "books.parquet") == "Full Text"
    assert corpus.choose_text_column(["x"], "books.parquet") is None


def test_merge_needs_text(spark):
    with pytest.raises(ValueError):
        corpus.merge_corpora(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("w",)], "text string"))


def test_limits_count_usable_texts_in_order(spark):
    src = spark.createDataFrame([("f", i, t) for i, t in enumerate(["short", "long enough text", None, "another long text", "a third long text"])], "source_file string, pos int, text string")
    out = corpus.build_sft_corpus(src, None, 10, 2).orderBy("pos").collect()
    assert [r["pos"] for r in out] == [1, 3]


def test_exact_triples_keep_first(spark, rows):
    df = spark.createDataFrame([(2, " a", "b", "c"), (1, "a", "b ", "c"), (3, "a", " ", "c"), (4, None, "b", "c")], "pos int, instruction string, input string, output string")
    assert rows(dedup.exact_triples(df, ("pos",))) == [(1, "a", "b", "c")]
    assert len(rows(dedup.exact_triples(df, ("pos",), dedup=False))) == 2


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    texts = []
    for i in range(40):
        ws = list(base) if i % 2 else [f"v{rng.randrange(500)}" for _ in range(60)]
        for _ in range(rng.randrange(4)):
            ws[rng.randrange(60)] = f"z{rng.randrange(99)}"
        texts.append((i, " ".join(ws)))
    texts += [(90, texts[1][1]), (91, None), (92, ""), (93, "one two")]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts if t}
    parent = {i: i for i, _ in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (sets[a] or texts) and len(sets[a] | sets[b]) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.75:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r["id"]: r["component"] for r in dedup.near_duplicate_groups(spark.createDataFrame(texts, "id int, text string"), "id", "text").collect()}
    assert got == {i: root(i) for i, _ in texts}


def test_group_cap_takes_experts_first(spark, rows):
    e = spark.createDataFrame([("k", i) for i in range(3)], "key string, pos int")
    g = spark.createDataFrame([("k", i) for i in range(10, 13)], "key string, pos int")
    assert rows(corpus.cap_per_group(e, g, ["key"], ["pos"], 4), "pos") == [(0,), (1,), (10,), (2,)]


def test_top_k_in_blocks_is_the_same(spark, rows):
    rng = random.Random(0)
    v = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(60)], "id long, vector array<double>")
    whole, parts = (vector_search.top_k(v, v, 5, block_bytes=b, digits=9) for b in (1 << 20, 200))
    assert rows(whole) == rows(parts)
    assert sorted(r["rank"] for r in whole.where("query_id = 3").collect()) == [1, 2, 3, 4, 5]
    assert vector_search.top_k(v, v.limit(0), 5).count() == 0


def test_rerank_and_evidence(spark):
    c = spark.createDataFrame([(1, i, i + 1, float(s)) for i, s in enumerate([1, 3, 3])], "query_id int, match_id int, retrieval_rank int, s double")
    r = vector_search.rerank(c, "s", 2, 3)
    got = vector_search.collect_evidence(r, ["match_id", "rerank_rank"]).first()
    assert [d["match_id"] for d in got["reranked_docs"]] == [1, 2] and [d["match_id"] for d in got["retrieved_docs"]] == [0, 1, 2]
    with pytest.raises(ValueError):
        vector_search.rerank(c, "s", 4, 3)


@pytest.mark.parametrize("threshold, shortest, longest", [(90, 5, 50), (90, 0, 9), (95, 0, 130), (75, 1, 30)])
def test_ratio_and_near_titles(spark, threshold, shortest, longest):
    rng = random.Random(5)
    titles = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(shortest, longest))) for _ in range(60)]
    stems = []
    for t in titles[:40]:
        s = list(t)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.randrange(2)] = rng.choice(["", "x", "y"])
        stems.append("".join(s))
    assert matching.ratio("abc", "abc") == 100 and matching.ratio("", "") == 100 and matching.ratio("abcd", "abxd") == 75
    pairs = [("".join(rng.choice("abcé ") for _ in range(rng.randrange(n))) for _ in "ab") for n in (3, 20, 70, 200) for _ in range(40)]
    a, b = zip(*pairs)
    assert np.allclose(matching.ratios(a, b, 16), [matching.ratio(x, y) for x, y in zip(a, b)])
    known = list(dict.fromkeys(titles))
    want = {}
    for s in set(stems):
        best = max(known, key=lambda t: (matching.ratio(s, t), -known.index(t)))
        if matching.ratio(s, best) >= threshold:
            want[s] = best
    got = matching.near_titles(
        spark.createDataFrame([(s,) for s in stems], "stem string"), spark.createDataFrame([(t, i) for i, t in enumerate(known)], "title string, pos int"), float(threshold)
    )
    assert {r["stem"]: r["title"] for r in got.collect()} == want


def test_titles_one_character_off_are_not_compared_by_grams(spark, monkeypatch):
    """Addresses of one site share their grams, so their pairs by grams grow with the square of the addresses."""
    monkeypatch.setattr(matching, "_by_grams", lambda *_: pytest.fail("compared by grams"))
    titles = [f"https://www.example.org/en/{k}\U0001f600" for k in range(1000, 1500)]
    stems = [t + "x" for t in titles[::2]] + [t[:9] + t[10:] for t in titles[1::2]]
    known = spark.createDataFrame([(t, i) for i, t in enumerate(titles)] + [(titles[0], 900)], "title string, pos int")
    got = {r["stem"]: (r["title"], r["score"]) for r in matching.near_titles(spark.createDataFrame([(s,) for s in stems], "stem string"), known).collect()}
    assert got == {s: (t, matching.ratio(s, t)) for s, t in zip(stems, titles[::2] + titles[1::2])}


def test_chunk_ids_and_duplicates(spark):
    def ids(sections):
        df = spark.createDataFrame([("12_x.json", "12_x", i, s, "c") for i, s in enumerate(sections)], "source_file string, stem string, pos int, section_id string, content string")
        return rag.require_unique(rag.chunk_ids(df), "chunk_id")

    assert sorted(r["chunk_id"] for r in ids(["1", "1", "2", " "]).collect()) == ["12.1", "12.1.1", "12.2"]
    with pytest.raises(Exception, match="duplicate"):
        ids(["1", "1", "1.1"]).collect()


def test_long_sections_cover_the_text():
    count = lambda t: len(t.split())
    text = "\n".join(" ".join(f"w{i}_{j}" for j in range(9)) for i in range(40))
    parts = rag.split_text(text, count, rag.SplitPlan(50, 20))
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for (a, b), (c, d) in zip(parts, parts[1:]):
        assert a < c <= b < d and count(text[a:b]) <= 50
    assert rag.split_text("a b", count, rag.SplitPlan()) == [(0, 3)]
    with pytest.raises(ValueError):
        rag.SplitPlan(0)


def test_exam_scoring(spark):
    df = spark.createDataFrame([("Select all", "", "Answer: A|C", "CA"), ("", "单选题 x", "答案：A", "A"), ("", "", "A", "")], "question_type string, prompt string, raw_response string, correct_answer string")
    scored = scoring.score_exam(df)
    assert [r["is_correct"] for r in scored.collect()] == [True, True, False]
    assert scoring.accuracy(scored).first()["correct_answers"] == 2


def test_mersenne_mode_is_pythons(spark):
    df = spark.createDataFrame([("g", i) for i in range(6)], "grp string, pos int")
    got = [r["pos"] for r in sampling.mersenne_types(df, ["grp"], ["pos"], 42).orderBy("shuffled_index").collect()]
    want = list(range(6))
    random.Random(42).shuffle(want)
    assert got == want


def test_generation_resumes_and_fails_at_the_sink(spark):
    items = spark.createDataFrame([("a", "b", "t1"), ("a", "b", "t2")], "major string, sub string, text string")

    def broken():
        def run(prompts):
            raise RuntimeError("down")

        return run

    bad = generation.generate(generation.with_prompts(items), providers.generator(broken, tries=2, wait=lambda n: 0))
    assert all("down" in r["error"] for r in bad.collect())
    with pytest.raises(Exception, match="generation failed"):
        generation.require_complete(bad).collect()
    done = generation.generate(generation.with_prompts(items.limit(1)), providers.generator(providers.echo_teacher))
    assert generation.pending(items, done, ["text"]).count() == 1
    with pytest.raises(Exception, match="another run"):
        generation.require_same_run(spark.createDataFrame([("x",)], "fingerprint string"), "y").collect()


def test_amplify_fills_cells(spark):
    pool = spark.createDataFrame([("c", "s1", "summary question", "i", "n", "o"), ("c", "s2", "summary question", "i2", "n2", "o2")], "cat string, sub string, kind string, instruction string, input string, output string")
    made = generation.amplify(pool.select("cat", "sub", "kind").distinct(), pool, providers.generator(providers.echo_teacher), per_cell=2)
    assert sorted(r["count"] for r in made.groupBy("sub").count().collect()) == [2, 2]


def test_provider_order_and_rerank(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "id int, t string")
    v = df.select("id", providers.embedder(providers.hashed_bag_of_words(8), batch=2)("t").alias("v")).orderBy("id").collect()
    assert len(v) == 5 and abs(sum(x * x for x in v[0]["v"]) - 1) < 1e-6
    s = df.select(providers.reranker(providers.word_overlap_logits)(F.lit("text"), F.col("t")).alias("s")).first()["s"]
    assert 0.5 < s < 1


def test_etl_registry(spark):
    df = spark.createDataFrame([("Abstract\n" + "word " * 700,), ("Abstract\n" + "word " * 700,), (None,)], "`Full Text` string")
    assert etl.run(spark, etl.article_plan(None, None), df).count() == 3
    with pytest.raises(ValueError):
        etl.article_plan(None, None, language_filter=True)


def test_sources_and_sinks(spark, tmp_path, rows):
    from corpusloom.sources import files, sinks

    d = tmp_path / "seeds" / "Major"
    d.mkdir(parents=True)
    (d / "sub.json").write_text(json.dumps([{"text": "a"}, 3]))
    (d / "bad.json").write_text("{oops")
    seeds = files.seed_directory(spark, str(tmp_path / "seeds"), "expert")
    assert rows(seeds, "major", "sub", "source") == [("Major", "sub", "expert")]
    with pytest.raises(Exception):
        files.category_samples(spark, str(tmp_path / "seeds")).collect()
    lines = tmp_path / "web"
    lines.mkdir()
    (lines / "a.jsonl").write_text('{"text": "x"}\n\n[1]\nbroken\n{"text": 5}\n')
    assert rows(files.jsonl_texts(spark, str(lines)), "text") == [("x",), (None,)]
    assert files.list_files(spark, str(tmp_path / "none"), [".json"]) == []
    g = tmp_path / "gen"
    g.mkdir()
    (g / "a_generated.json").write_text(json.dumps([{"instruction": "i", "input": "n", "output": "o"}, {"instruction": 1, "input": "n", "output": "o"}]))
    (g / "a_partial_generated.json").write_text("[]")
    assert rows(files.generated_samples(spark, str(g)), "instruction") == [("i",)]
    (tmp_path / "rag.json").write_text(json.dumps({"data": [{"question": "q"}]}))
    assert files.rag_records(spark, str(tmp_path / "rag.json")).count() == 1
    s = tmp_path / "std"
    s.mkdir()
    (s / "1_a.json").write_text(json.dumps({"title": "t", "sections": [{"id": "1", "content": "c"}]}))
    assert rows(files.standards(spark, str(s)), "section_id", "content") == [("1", "c")]
    p = tmp_path / "pq"
    spark.createDataFrame([("full", "abs")], "`Full Text` string, Abstract string").write.parquet(str(p))
    assert rows(files.parquet_texts(spark, str(p)), "text") == [("full",)]
    out = sinks.write_new(spark.createDataFrame([], "text string"), str(tmp_path / "o.parquet"))
    assert spark.read.parquet(out).schema.names == ["text"]
    with pytest.raises(Exception):
        sinks.write_new(spark.createDataFrame([], "text string"), str(tmp_path / "o.parquet"))
    with pytest.raises(ValueError):
        sinks.write_new(seeds, str(tmp_path / "seeds" / "x.parquet"), inputs=[str(tmp_path / "seeds")])
    with pytest.raises(ValueError):
        sinks.write_nonempty(spark.createDataFrame([], "text string"), str(tmp_path / "e.jsonl"))
    assert sinks.output_format("a/b.txt") == ("a/b.jsonl", "jsonl")

    def service():
        def fetch(doi):
            if doi == "3":
                raise OSError("no net")
            return {"title": "t", "best_oa_location": {"url_for_pdf": "u"} if doi == "1" else None}

        return fetch

    looked = files.open_access_links(spark.createDataFrame([("1",), ("2",), ("3",)], "doi string"), service)
    assert rows(looked, "doi", "status") == [("1", "found"), ("2", "none"), ("3", "failed")]


def test_streaming_ingest(spark, tmp_path):
    from corpusloom.streaming import ingest

    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    spark.createDataFrame([("a long enough text",), ("a long  enough text",), ("short",)], "text string").write.parquet(src)
    for _ in range(2):
        ingest.ingest(spark, src, "text string", out, ck).awaitTermination(60)
    assert spark.read.parquet(out).count() == 1
