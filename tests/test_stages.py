"""Stages that ask a model or a service, and the sources and sinks around them."""

import importlib.util
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.__main__ import main
from corpusloom.operators import generation, inference, lineage, matching, rag
from corpusloom.plans import providers
from corpusloom.sources import files, sinks

TRIPLE = {"instruction": "This is a summary question task.", "input": "n", "output": "o"}


def always(answer):
    def load():
        return lambda prompts: [answer] * len(prompts)

    return load


def test_exam_bench_and_rag_runs(spark, tmp_path):
    p = lambda *parts: str(tmp_path.joinpath(*parts))
    items = [
        {"question_content": "Which?", "question_type": "Select one", "options": {"B": "y", "A": "x"}, "correct_answer": "B"},
        {"prompt": "单选题 own", "question_content": "?", "correct_answer": "A", "question_number": 9}, {"question_content": "All?", "question_type": "Select all", "options": ["x", "y"], "correct_answer": ""},
    ]
    (tmp_path / "exam.json").write_text(json.dumps(items))
    scored = inference.exam_run(files.exam_items(spark, p("exam.json")), providers.generator(always("答案：B\n解析：so")))
    got = scored.orderBy("pos").collect()
    assert [(r["question_number"], r["model_answer"], r["model_analysis"], r["is_correct"]) for r in got] == [(1, "B", "so", True), (9, "B", "so", False), (3, "B", "so", False)]
    assert "A: x\nB: y" in got[0]["prompt"] and got[1]["prompt"] == "单选题 own"
    assert tuple(inference.exam_report(scored, "m").first()) == ("m", 3, 3, 1, pytest.approx(1 / 3))
    main(["infer", "--task", "exam", "--input", p("exam.json"), "--output", p("exam.out")])
    assert spark.read.json(p("exam.jsonl")).count() == 3 and spark.read.json(p("exam.jsonl.report")).first()["total_questions"] == 3
    (tmp_path / "bench.json").write_text(json.dumps([{"instruction": "Do", "input": "this"}, {"input": "that"}]))
    main(["infer", "--task", "bench", "--input", p("bench.json"), "--output", p("bench.out")])
    assert sorted(r["input"] for r in spark.read.json(p("bench.jsonl")).collect()) == ["that", "this"]
    (tmp_path / "rag.jsonl").write_text('{"rag_prompt": "a b c", "query": "q", "correct_answer": "A"}\n{"rag_prompt": "d", "query": "q", "correct_answer": ""}\n')
    rows = spark.read.json(p("rag.jsonl"))
    out = inference.rag_run(rows, providers.generator(always("Answer: A")), providers.token_lengths(providers.white_space_tokens), "m", gold="correct_answer", new_tokens=2, context=5)
    assert sorted((r["input_tokens"], r["output_tokens"], r["is_correct"]) for r in out.collect()) == [(1, 2, None), (3, 2, True)] or {r["is_correct"] for r in out.collect()} == {True, None}
    with pytest.raises(Exception, match="token budget"):
        inference.rag_run(rows, providers.generator(always("A")), providers.token_lengths(providers.white_space_tokens), "m", new_tokens=2, context=4)
    with pytest.raises(Exception, match="the model failed"):
        inference.answered(rows, "query", providers.generator(always(" "), tries=1), "a")
    main(["infer", "--task", "rag", "--input", p("rag.jsonl"), "--output", p("rag.out.jsonl")])
    assert spark.read.json(p("rag.out.jsonl")).count() == 2


def test_generation_from_three_sources(spark, tmp_path):
    p = lambda *parts: str(tmp_path.joinpath(*parts))
    for root, text in (("expert", "one"), ("llm", "two")):
        d = tmp_path / root / "Major"
        d.mkdir(parents=True)
        (d / "sub.json").write_text(json.dumps([{"text": text}, {"text": " "}]))
    records = [{"text": "three", "rank": 3, "major_category": "M", "major categories": "other", "sub_category_name": "S"}, {"text": "four", "rank": 2}, {"text": "five", "rank": "x"}]
    (tmp_path / "top.json").write_text(json.dumps(records))
    groups = generation.seed_groups(
        files.seed_directory(spark, p("expert"), "expert"), files.seed_directory(spark, p("llm"), "llm"), files.retrieved_file(spark, p("top.json"), 3)
    )
    assert sorted(map(tuple, groups.collect())) == [("M", "S", "three", "retrieved"), ("Major", "sub", "one", "expert"), ("Major", "sub", "two", "llm")]
    run = ["generate", "--expert-dir", p("expert"), "--llm-dir", p("llm"), "--retrieved-file", p("top.json"), "--results", p("results")]
    main([*run, "--output", p("sft")])
    assert spark.read.parquet(p("results")).count() == 3 and spark.read.json(p("sft")).where("major = 'M'").count() == 1
    main(run)
    assert spark.read.parquet(p("results")).count() == 3
    with pytest.raises(Exception, match="another run"):
        main([*run, "--seed", "7"])
    with pytest.raises(ValueError):
        generation.seed_groups(None, None)


def test_amplify_stage_reaches_generated_examples(spark, tmp_path):
    d = tmp_path / "in" / "Cat"
    d.mkdir(parents=True)
    (d / "sub_en_en.json").write_text(json.dumps([TRIPLE, {"instruction": "no type", "input": "n", "output": "o"}]))
    main(["amplify", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--samples-per-type", "5"])
    made = spark.read.json(str(tmp_path / "out"))
    assert made.count() == 5 and made.select("instruction").distinct().count() >= 2 and made.first()["sub"] == "sub"


@pytest.mark.skipif(importlib.util.find_spec("openpyxl") is None, reason="needs openpyxl")
def test_excel(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"DOI": ["a", None], "n": [1, 2]}).to_excel(tmp_path / "m.xlsx", index=False)
    assert [r["DOI"] for r in files.excel(spark, str(tmp_path / "m.xlsx"), "DOI").collect()] == ["a", None]


def test_acquisition(spark, tmp_path, monkeypatch):
    p = lambda *parts: str(tmp_path.joinpath(*parts))
    (tmp_path / "pdf").mkdir()
    (tmp_path / "txt").mkdir()
    for name in ("Known title", "A nearly known titlex", "Other"):
        (tmp_path / "pdf" / f"{name}.pdf").write_bytes(name.encode())
    (tmp_path / "txt" / "Other.txt").write_text("old\ntext")
    sheet = [(0, "Known title", "10.1/a", "2001.0"), (1, "A nearly known title", "10.1/b", None), (2, None, "10.1/c", "x")]
    metadata = spark.createDataFrame(sheet, "pos long, `Article Title` string, DOI string, `Publication Year` string")
    monkeypatch.setattr(files, "excel", lambda spark, path, key: metadata)
    monkeypatch.setattr(files, "page_texts", lambda: lambda: lambda content: [f"Page 1 of {content.decode()}", "Page 2"])
    main(["articles", "--pdf-dir", p("pdf"), "--txt-dir", p("txt"), "--metadata", "x", "--output", p("out"), "--failed-report", p("failed")])
    assert (tmp_path / "txt" / "Known title.txt").read_text() == "Page 1 of Known title\nPage 2" and (tmp_path / "txt" / "Other.txt").read_text() == "old\ntext"
    assert [r["value"] for r in spark.read.text(p("failed")).collect()] == ["Other"]
    got = {r["stem"]: r for r in spark.read.parquet(p("out", "parquet")).collect()}
    assert set(got) == {"Known title", "A nearly known titlex"} and got["Known title"]["DOI"] == "10.1/a" and got["A nearly known titlex"]["Publication Year"] == ""
    assert set(matching.ARTICLE_FIELDS) < set(got["Other"].asDict() if "Other" in got else got["Known title"].asDict())
    assert files.pending_pdfs(spark, p("pdf"), p("txt")).count() == 0

    def service():
        def fetch(doi):
            if doi == "10.1/b":
                raise OSError("down")
            return {"title": "T", "best_oa_location": {"url_for_pdf": "u"} if doi == "10.1/a" else None}

        return fetch

    monkeypatch.setattr(files, "open_access_service", lambda email, url: service)
    main(["find-links", "--metadata", "x", "--email", "e", "--output", p("links")])
    read = lambda name: sorted(r["value"] for r in spark.read.text(p("links", name)).collect())
    assert (read("links"), read("success"), read("failed")) == (["u"], ["10.1/a"], ["10.1/b", "10.1/c"])

    def broken():
        def fetch(doi):
            raise KeyError(doi)

        return fetch

    with pytest.raises(Exception, match="KeyError"):
        files.open_access_links(spark.createDataFrame([("d",)], "doi string"), broken).collect()


def test_other_sources_and_sinks(spark, tmp_path, rows):
    p = lambda *parts: str(tmp_path.joinpath(*parts))
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "b.txt").write_text("two\nlines")
    assert rows(files.text_folder(spark, p("t")), "stem", "content") == [("b", "two\nlines")]
    (tmp_path / "amp" / "c").mkdir(parents=True)
    (tmp_path / "amp" / "c" / "x_en_en.json").write_text(json.dumps([TRIPLE]))
    assert rows(files.amplifier_samples(spark, p("amp")), "category", "sub", "key") == [("c", "x", "c_x_en_en")]
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(ValueError):
        files.exam_items(spark, p("e.json"))
    (tmp_path / "w.jsonl").write_text('{"text": "a"}\n{"text": "b", "more": 1}\n')
    assert rows(files.web_corpus(spark, p("w.jsonl")), "text") == [("a",), ("b",)]
    assert rows(files.ordered(spark.createDataFrame([("f", 7), ("f", 3), ("g", 9)], "source_file string, pos int")), "pos", "ordinal") == [(3, 0), (7, 1), (9, 0)]
    assert rows(files.jsonl_texts(spark, str(tmp_path), max_files=1), "text") == []
    empty = spark.createDataFrame([], "a int")
    assert sinks.write_articles(empty, p("none")) is False and not (tmp_path / "none" / "parquet").exists()
    sinks.write_lines(spark.createDataFrame([("x",), (None,)], "c string"), "c", p("lines"))
    assert [r["value"] for r in spark.read.text(p("lines")).collect()] == ["x"]
    df = spark.createDataFrame([("A b", "s", "t", "i")], "major string, sub string, question_type string, instruction string")
    sinks.write_by_category(df, p("cat"))
    assert (tmp_path / "cat" / "major=A_b" / "sub=s" / "question_type=t").is_dir()
    for _ in range(2):
        sinks.append_results(df, p("res"))
    assert files.prior_results(spark, p("res"), df.schema.simpleString()[7:-1].replace(":", " ")).count() == 2
    assert files.prior_results(spark, p("no"), "a int").count() == 0


def test_rows_that_find_no_metadata(spark):
    texts = spark.createDataFrame([("a", "x"), ("zzzz", "y")], "stem string, full_text string")
    out = matching.attach_metadata(texts, spark.createDataFrame([("a", 0)], "`Article Title` string, pos int"))
    assert [r["stem"] for r in matching.unmatched(out).collect()] == ["zzzz"]


def test_token_guards_and_pooling(spark):
    states = np.arange(24.0).reshape(2, 3, 4)
    assert providers.last_token_pool(states, np.array([[1, 1, 0], [1, 1, 1]])).tolist() == [states[0, 1].tolist(), states[1, 2].tolist()]
    assert providers.last_token_pool(states, np.array([[0, 1, 1], [1, 1, 1]])).tolist() == states[:, 2].tolist()
    df = spark.createDataFrame([("a b c",), ("a",)], "t string")
    model = lambda: lambda texts: (np.ones((len(texts), 2, 3)), np.ones((len(texts), 2), int))
    assert df.select(providers.embedder(providers.pooled(model))("t").alias("v")).first()["v"] == pytest.approx([3**-0.5] * 3)
    with pytest.raises(Exception, match="3 tokens"):
        df.select(providers.embedder(providers.hashed_bag_of_words(4), tokenizer=providers.white_space_tokens, most_tokens=2)("t")).collect()
    with pytest.raises(Exception, match="more than 3"):
        df.select(providers.reranker(providers.word_overlap_logits, most_tokens=3)("t", "t")).collect()
    assert sorted(r[0] for r in df.select(providers.token_lengths(providers.white_space_tokens)("t")).collect()) == [1, 3]
    assert rag.counted_by(providers.white_space_tokens)()("a b") == 2
    with pytest.raises(Exception, match="token budget"):
        rag.require_budget(df.withColumn("n", F.lit(9)), "n", 2, 10).collect()


def test_long_texts_split_as_by_plain_search():
    count = lambda t: len(t.split())

    def plain(text, plan):
        parts, at = [], 0
        while True:
            fits = max(e for e in range(at, len(text) + 1) if count(text[at:e]) <= plan.most_tokens)
            if fits < len(text):
                line = text.rfind("\n", at + (fits - at) // 2, fits) + 1
                fits = line if line > 0 else fits
            parts.append((at, fits))
            if fits >= len(text):
                return parts
            at = max(at + 1, fits - min(plan.overlap, (fits - at) // 2))

    text = "\n".join(" ".join("w" * (1 + (i * j) % 7) for j in range(1 + i % 11)) for i in range(40))
    for plan in (rag.SplitPlan(20, 5), rag.SplitPlan(7, 0), rag.SplitPlan(33, 60)):
        assert rag.split_text(text, count, plan) == plain(text, plan)


def test_tables_have_an_owner(spark, tmp_path):
    df = spark.range(3)
    with lineage.scratch(spark) as keep:
        _, gone = lineage.materialise(df, "gone")
        kept, path = lineage.materialise(df, "kept")
        keep(path)
    exists = lambda q: len(files.list_files(spark, q, [".parquet"])) > 0
    assert not exists(gone) and exists(path) and kept.count() == 3
    lineage.discard(spark, path)
    assert not exists(path)


def test_the_shared_folder_is_the_callers(spark, tmp_path, monkeypatch):
    context = spark.sparkContext
    before = context.getCheckpointDir()
    context.setCheckpointDir(str(tmp_path / "mine"))
    assert str(tmp_path / "mine") in lineage.shared_dir(spark)
    if before:
        context.setCheckpointDir(before)

    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://somewhere"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_dir(Cluster)


def test_blanks_cost_linear_time(spark):
    import time

    from corpusloom.functions import text as X

    df = spark.createDataFrame([(" 　x" + " " * 1_000_000 + "y\x85",)], "t string").cache()
    df.count()
    for f in (X.strip, X.words, X.clean_text, X.sentences):
        began = time.time()
        df.select(f(F.col("t"))).collect()
        assert time.time() - began < 2.5
    assert df.select(F.length(X.strip(F.col("t")))).first()[0] == 1_000_002


def test_responses_compile(spark):
    """No query's plan may grow past what can be compiled: its expressions are computed once each."""
    from corpusloom.functions import parsing

    plan = spark.range(1).select(parsing.parse_response(F.col("id").cast("string")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_parse_json") + plan.count("parse_json") <= 2 and len(plan) < 20_000
