"""Command line: python -m corpusloom STAGE ... ; each stage reads and writes tables or JSON.

Models are named as module:function, a ``load`` function of corpusloom.plans.providers'
kind; without one the deterministic stand-in is used.
"""

from __future__ import annotations

import argparse
import hashlib
import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import parsing, prompts
from .operators import corpus, dedup, generation, inference, matching, rag, scoring, vector_search
from .operators.lineage import cut
from .plans import etl, providers
from .sources import files, sinks


def _load(name: str | None, default):
    if not name:
        return default
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def run_etl(spark: SparkSession, a: argparse.Namespace) -> None:
    predict = providers.language_predictor(_load(a.language_model, providers.stop_word_language)) if a.language_filter else None
    etl.run(spark, etl.article_plan(a.input, a.output, a.column, a.language_filter, predict))


def build_corpus(spark: SparkSession, a: argparse.Namespace) -> None:
    web = files.jsonl_texts(spark, a.web_dir, a.max_web_files) if a.web_dir else None
    out = corpus.build_sft_corpus(files.parquet_texts(spark, a.source_dir), web, a.min_chars, a.max_source_records, a.max_web_records)
    sinks.write_new(out.orderBy("stage", "source_file", "pos").select("text"), a.output, a.format, [a.source_dir, *filter(None, [a.web_dir])])


def merge_corpora(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.write_new(corpus.merge_corpora(spark.read.parquet(a.literature), files.web_corpus(spark, a.web)), a.output, "jsonl")


def _embedded(df: DataFrame, text: str, a: argparse.Namespace) -> DataFrame:
    return df.withColumn("vector", providers.embedder(_load(a.embedder, providers.hashed_bag_of_words()), tokenizer=_load(a.tokenizer, providers.white_space_tokens))(F.col(text)))


def semantic_filter(spark: SparkSession, a: argparse.Namespace) -> None:
    seeds = corpus.cap_per_group(files.category_samples(spark, a.expert_dir), files.category_samples(spark, a.generated_dir), ["key"], ["source_file", "pos"], a.cap)
    seeds = seeds.select(
        F.concat_ws("#", "source_file", "pos").alias("id"), parsing.blank_to_null(parsing.string_field(F.col("record"), "text")).alias("text"),
        F.coalesce(parsing.string_field(F.col("record"), "major categories"), F.lit("Unknown")).alias("major_category"),
        F.coalesce(parsing.string_field(F.col("record"), "sub-categories"), F.lit("Unknown")).alias("sub_category"),
    )
    seeds = seeds.where(F.when(F.col("text").isNull(), F.raise_error(F.lit("a seed has no text")).cast("boolean")).otherwise(True))
    texts = corpus.usable_queries(files.web_corpus(spark, a.corpus)).withColumn("id", F.monotonically_increasing_id())
    found = vector_search.semantic_filter(_embedded(texts, "text", a), _embedded(seeds, "text", a), a.top_k)
    noted = vector_search.attach_annotations(found, seeds, "id", ["text", "major_category", "sub_category"])
    sinks.write_nonempty(noted.join(texts.withColumnRenamed("id", "query_id"), "query_id").drop("query_id", "match_id").orderBy("rank"), a.output)


def find_links(spark: SparkSession, a: argparse.Namespace) -> None:
    dois = corpus.distinct_dois(files.excel(spark, a.metadata, a.doi_column), a.doi_column).where("doi <> ''")
    service = _load(a.service, None) or files.open_access_service(a.email, a.service_url)
    sinks.write_links(cut(files.open_access_links(dois, service)), a.output)


def articles(spark: SparkSession, a: argparse.Namespace) -> None:
    """PDF files that have no text yet become texts; all texts become article records."""
    pending = [r["source_file"] for r in files.pending_pdfs(spark, a.pdf_dir, a.txt_dir).collect()]  # file names only
    read = files.text_folder(spark, a.txt_dir).select("stem", F.col("content").alias("full_text"))
    if pending:
        texts = cut(files.pdf_texts(spark, pending, _load(a.pages, files.page_texts())))
        sinks.write_text_files(texts, "stem", "full_text", a.txt_dir)
        read = read.unionByName(texts)
    metadata = files.excel(spark, a.metadata, "Article Title")
    matched = cut(matching.attach_metadata(read, metadata, threshold=float(a.fuzzy_threshold)))
    sinks.write_lines(matching.unmatched(matched), "stem", a.failed_report)
    sinks.write_articles(cut(matching.article_records(matched, metadata)), a.output)


def generate(spark: SparkSession, a: argparse.Namespace) -> None:
    seeds = [files.seed_directory(spark, path, source) for path, source in ((a.expert_dir, "expert"), (a.llm_dir, "llm")) if path]
    found = files.retrieved_file(spark, a.retrieved_file, a.min_retrieval_rank) if a.retrieved_file else None
    more = files.json_records(spark, files.list_files(spark, a.input, [".json"], recursive=True), tolerant=True) if a.input else None
    items = generation.seed_groups(*seeds, found, more).select("major", "sub", "text").distinct()
    prompted = generation.with_prompts(items, a.seed)
    keys = ["major", "sub", "text", "question_type"]
    schema = "major string, sub string, text string, question_type string, triple struct<instruction:string,input:string,output:string>, fingerprint string"
    run = hashlib.sha256(json.dumps([a.seed, a.teacher, a.min_retrieval_rank]).encode()).hexdigest()
    left = generation.pending(prompted, generation.require_same_run(files.prior_results(spark, a.results, schema), run), keys)
    made = generation.generate(left, providers.generator(_load(a.teacher, providers.echo_teacher)))
    sinks.append_results(generation.require_complete(made).select(*keys, "triple", F.lit(run).alias("fingerprint")), a.results)
    if a.output:
        done = files.prior_results(spark, a.results, schema)
        sinks.write_by_category(done.select("major", "sub", "question_type", "triple.*"), a.output)


def amplify(spark: SparkSession, a: argparse.Namespace) -> None:
    """Samples are told apart by category, file and the question type that their instruction names."""
    samples = files.amplifier_samples(spark, a.input).withColumn("t", parsing.valid_triple(F.col("record"))).where("t is not null")
    kind = prompts.question_type_bucket(F.col("t.instruction"))
    pool = cut(samples.select(F.col("category").alias("cat"), "sub", kind.alias("kind"), "t.*").where("kind is not null"))
    provider = providers.generator(_load(a.teacher, providers.echo_teacher))
    made = generation.amplify(pool.select("cat", "sub", "kind").distinct(), pool, provider, a.samples_per_type, a.seed, a.generated_example_threshold)
    sinks.write_by_category(made, a.output, ("cat", "sub", "kind"))


def infer(spark: SparkSession, a: argparse.Namespace) -> None:
    """exam, bench or rag: a file of items, or of the records that the stage retrieve has written."""
    provider = providers.generator(_load(a.model, providers.digest_student))
    name = a.model or "stand-in"
    if a.task == "rag":
        tokens = providers.token_lengths(_load(a.tokenizer, providers.white_space_tokens))
        rows = spark.read.json(a.input)
        gold = "correct_answer" if "correct_answer" in rows.columns else None
        prompt = "query" if a.no_rag else "rag_prompt"
        out = inference.rag_run(rows, provider, tokens, name, prompt, gold, not a.no_rag, a.max_new_tokens, a.context)
        sinks.write_nonempty(out, a.output)
    elif a.task == "bench":
        out = inference.bench_run(files.exam_items(spark, a.input), provider, a.local)
        sinks.write_nonempty(out.orderBy("pos").drop("pos"), a.output)
    else:
        out = inference.exam_run(files.exam_items(spark, a.input), provider).withColumn("record", F.to_json("record"))
        written = sinks.write_nonempty(out.orderBy("pos"), a.output, "jsonl")
        inference.exam_report(out, name).write.mode("errorifexists").json(f"{written}.report")


def merge_sft(spark: SparkSession, a: argparse.Namespace) -> None:
    merged = dedup.exact_triples(files.generated_samples(spark, a.input), ("source_file", "pos"), a.dedup)
    sinks.write_nonempty(merged.orderBy("source_file", "pos").select(*parsing.TRIPLE), a.output, "jsonl")


def build_index(spark: SparkSession, a: argparse.Namespace) -> None:
    plan = rag.SplitPlan(a.max_chunk_tokens)
    chunks = rag.split_long_sections(rag.chunk_ids(files.standards(spark, a.input)), rag.counted_by(_load(a.tokenizer, providers.white_space_tokens)), plan)
    sinks.write_nonempty(_embedded(rag.require_unique(chunks, "chunk_id"), "content", a), a.output, "parquet")


def retrieve(spark: SparkSession, a: argparse.Namespace) -> None:
    r = files.rag_records(spark, a.input)
    field = lambda name: parsing.string_field(F.col("record"), name)
    by_name = F.transform(F.map_entries(F.try_variant_get("record", "$.options", "map<string,string>")), lambda e: F.struct(e["key"], e["value"]))
    listed = F.transform(F.try_variant_get("record", "$.options", "array<string>"), lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value")))
    query = parsing.retrieval_query(field("retrieval_query"), F.coalesce(field("question"), field("question_content")), F.coalesce(listed, by_name))
    asked = r.select(F.col("pos").alias("id"), query.alias("query"), F.to_json("record").alias("record"))
    index = spark.read.parquet(a.index)
    hits = vector_search.retrieve(
        _embedded(asked.withColumn("asked", prompts.query_text(a.task, F.col("query"))), "asked", a), index, a.retrieve_k, index_id="chunk_id"
    )
    full = hits.join(asked.withColumnRenamed("id", "query_id"), "query_id").join(index.withColumnRenamed("chunk_id", "match_id"), "match_id")
    scored = full.withColumn("rerank_score", providers.reranker(_load(a.reranker, providers.word_overlap_logits), tokenizer=_load(a.tokenizer, providers.white_space_tokens))(F.col("query"), F.col("content")))
    ranked = vector_search.rerank(scored, "rerank_score", a.rerank_k, a.retrieve_k)
    ranked = ranked.withColumn("section", F.col("match_id"))
    fields = ["match_id", "content", "source_file", "section_id", "distance", "retrieval_rank", "rerank_score", "rerank_rank"]
    evidence = vector_search.collect_evidence(ranked, fields)
    out = asked.withColumnRenamed("id", "query_id").join(evidence, "query_id", "left")
    none = F.array().cast(evidence.schema["reranked_docs"].dataType)
    out = out.withColumn("rag_prompt", prompts.evidence_prompt(F.col("query"), F.coalesce("reranked_docs", none)))
    sinks.write_nonempty(out.orderBy("query_id"), a.output)


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    scored = scoring.score_exam(spark.read.json(a.input))
    sinks.write_nonempty(scored, a.output)
    scoring.accuracy(scored).show(truncate=False)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    stages = parser.add_subparsers(dest="stage", required=True)

    def stage(f, *required: str, **optional) -> None:
        p = stages.add_parser(f.__name__.removeprefix("run_").replace("_", "-"))
        for name in required:
            p.add_argument(f"--{name}", required=True)
        for name, default in optional.items():
            flag = "--" + name.replace("_", "-")
            if isinstance(default, bool):
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, default=None if isinstance(default, type) else default, type=default if isinstance(default, type) else type(default))
        p.set_defaults(run=f)

    stage(run_etl, "input", "output", column="Full Text", language_filter=False, language_model=str)
    stage(build_corpus, "source-dir", "output", web_dir=str, format=str, min_chars=10, max_source_records=int, max_web_records=int, max_web_files=int)
    stage(merge_corpora, "literature", "web", "output")
    stage(semantic_filter, "expert-dir", "generated-dir", "corpus", "output", cap=205, top_k=140_180, embedder=str, tokenizer=str)
    stage(find_links, "metadata", "email", "output", doi_column="DOI", service=str, service_url="https://api.unpaywall.org/v2")
    stage(articles, "pdf-dir", "txt-dir", "metadata", "output", "failed-report", fuzzy_threshold=95, pages=str)
    stage(generate, "results", input=str, expert_dir=str, llm_dir=str, retrieved_file=str, min_retrieval_rank=3, output=str, seed=42, teacher=str)
    stage(amplify, "input", "output", samples_per_type=10, generated_example_threshold=3, seed=123, teacher=str)
    stage(infer, "task", "input", "output", model=str, tokenizer=str, max_new_tokens=1024, context=32_768, local=False, no_rag=False)
    stage(merge_sft, "input", "output", dedup=False)
    stage(build_index, "input", "output", max_chunk_tokens=3500, tokenizer=str, embedder=str)
    stage(retrieve, "input", "index", "output", retrieve_k=30, rerank_k=15, embedder=str, tokenizer=str, reranker=str, task="Find sections that answer the question")
    stage(score, "input", "output")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"corpusloom {a.stage}").getOrCreate()
    a.run(spark, a)


if __name__ == "__main__":
    main()
