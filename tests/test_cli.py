import json

import pytest

from corpusloom.__main__ import main


def test_stages_from_files_to_answers(spark, tmp_path):
    p = lambda *parts: str(tmp_path.joinpath(*parts))
    std = tmp_path / "std"
    std.mkdir()
    sections = [{"id": str(i), "content": f"Slope number {i} needs drains of kind k{i}."} for i in range(6)]
    (std / "1_a.json").write_text(json.dumps({"title": "t", "sections": sections}))
    main(["build-index", "--input", p("std"), "--output", p("index.parquet")])
    (tmp_path / "q.json").write_text(json.dumps([{"question": "Which drains does slope number 3 need?", "options": {"A": "k3", "B": "k9"}}]))
    main(["retrieve", "--input", p("q.json"), "--index", p("index.parquet"), "--output", p("out.jsonl"), "--retrieve-k", "4", "--rerank-k", "2"])
    row = spark.read.json(p("out.jsonl")).first()
    assert len(row["retrieved_docs"]) == 4 and len(row["reranked_docs"]) == 2 and "[Evidence 2]" in row["rag_prompt"]
    gen = tmp_path / "gen"
    gen.mkdir()
    (gen / "x_generated.json").write_text(json.dumps([{"instruction": "i", "input": "n", "output": "o"}] * 2))
    main(["merge-sft", "--input", p("gen"), "--output", p("sft.jsonl"), "--dedup"])
    assert spark.read.json(p("sft.jsonl")).count() == 1
    with pytest.raises(Exception):
        main(["merge-sft", "--input", p("gen"), "--output", p("sft.jsonl")])
    seeds = tmp_path / "seeds" / "M"
    seeds.mkdir(parents=True)
    (seeds / "s.json").write_text(json.dumps([{"text": "drains on slopes", "major categories": "M"}]))
    (tmp_path / "web.jsonl").write_text('{"text": "drains on slopes are good"}\n{"text": "cooking pasta"}\n')
    main(["semantic-filter", "--expert-dir", p("seeds"), "--generated-dir", p("none"), "--corpus", p("web.jsonl"), "--output", p("hits.jsonl"), "--top-k", "1"])
    hit = spark.read.json(p("hits.jsonl")).first()
    assert hit["rank"] == 1 and hit["text"].startswith("drains") and hit["matched_annotation"]["major_category"] == "M"
    for _ in range(2):
        main(["generate", "--input", p("seeds"), "--results", p("results")])
    assert spark.read.parquet(p("results")).count() == 1
