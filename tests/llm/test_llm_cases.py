"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import json
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, language_id, line_dedup, lm_scores, media_chunks, near_dedup, packing, sharding, token_count, toxicity

SCHEMA = "doc_id long, text string, score double, n long, shard string, id string"
LONG = "lorem ipsum dolor " * 20_000
ROWS = [
    (1, "Some words, and more of them here.\nA line", 0.5, 1, "x", "a"), (2, None, None, None, None, None), (3, "", 0.1, 2, "y", "b"),
    (4, LONG, 0.2, 3, "z", "c"), (5, "one\ntwo", 0.3, 4, "z", None), (5, "one\ntwo", 0.3, 4, "z", None), (None, "no id here at all", 0.1, 1, "q", "d"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_count.tokenizer_path("byte_bpe_50k.json"))
    got = by_id(token_count.count_tokens(docs))
    for doc_id, text, *_ in ROWS:
        want = len(lib.encode(text or "", add_special_tokens=False).ids)
        assert [(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got[doc_id]][0] == (len((text or "").encode()), want, want > 1024)
    assert len(got[5]) == 2 and token_count.count_tokens(empty).count() == 0


def test_language(docs, empty, spark):
    train = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 5)], "doc_id long, text string, lang string")
    model = language_id.fit_language_model(train)
    got = by_id(language_id.identify_languages(docs, model))
    assert got[2][0]["lang_pred"] == got[3][0]["lang_pred"] == "und" and got[2][0]["score"] == 0
    assert got[1][0]["lang_pred"] in ("en", "fr") and 0 <= got[4][0]["score"] <= 1 and len(got[5]) == 2
    none = language_id.fit_language_model(train.limit(0))
    assert {r["lang_pred"] for r in language_id.identify_languages(docs, none).collect()} == {"und"}
    assert language_id.identify_languages(empty, model).count() == 0


def test_toxicity(docs, empty, spark):
    texts = [(i, ("you idiot. " if i % 2 else "") + "a plain text. with sentences here.") for i in range(40)]
    train = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(train, labels)
    got = by_id(toxicity.score_toxicity(docs, model))
    assert got[2][0]["score"] == got[3][0]["score"] == 0 and len(got[5]) == 2
    bad = toxicity.score_toxicity(spark.createDataFrame([(9, "All fine here. What an idiot! Bye.")], "doc_id long, text string"), model).first()
    assert bad["score"] > 0.5 and "idiot" in "All fine here. What an idiot! Bye."[bad["spans"][0]["start"] : bad["spans"][0]["end"]]
    assert toxicity.fit_toxicity(train, labels.where("toxic = 1")).weights == {}
    assert toxicity.score_toxicity(empty, model).count() == 0


def test_media(docs, empty):
    got = by_id(media_chunks.media_features(docs))
    for doc_id, text, *_ in ROWS:
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64) or bytes(64)
        r = got[doc_id][0]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_bytes"] == len(payload) + 44 and r["media_sha256"] == hashlib.sha256(media_chunks.wav(payload)).hexdigest()
    assert len(got[5]) == 2 and got[2][0]["feature"] == got[3][0]["feature"] and media_chunks.media_features(empty).count() == 0


def check_packing(got, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for doc_id, text in texts:
        ids = lib.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            data = b"".join(i.to_bytes(4, "little") for i in ids[at : at + r["length"]])
            assert r["ids_crc32"] == zlib.crc32(data)
            at += r["length"]
        assert at == len(ids)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    return len(sequences), sum(r["length"] for r in got)


def test_packing(docs, empty):
    unique = docs.dropDuplicates(["doc_id"])
    check_packing(packing.pack_documents(unique).collect(), [(r[0], r[1]) for r in ROWS])
    assert packing.pack_documents(docs).where("doc_id = 5").count() == 2
    assert packing.pack_documents(empty).count() == 0


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs, 3).collect()
    assert len(got) == len(ROWS) and {r["shard"] for r in got} <= {0, 1, 2}
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert {r["size"] for r in got if r["doc_id"] in (2, 3)} == {8} and sharding.shard_documents(empty).count() == 0


def test_lm_scores(docs, empty):
    got = by_id(lm_scores.score_documents(docs))
    assert got[2][0]["n_words"] == 0 and got[3][0]["score"] is None and len(got[5]) == 2 and got[4][0]["score"] < 0
    assert got[None][0]["n_words"] == 5 and lm_scores.score_documents(empty).count() == 0


def test_line_dedup(docs, empty, spark):
    got = by_id(line_dedup.dedup_lines(docs, min_docs=1))
    assert got[5][0]["text"] == "" and got[5][0]["n_dropped"] == 2 and got[2][0]["n_lines"] == 1 and got[3][0]["n_dropped"] == 0
    assert got[1][0]["score"] == 0.5 and set(docs.columns) <= set(line_dedup.dedup_lines(docs).columns)
    few = spark.createDataFrame([(i, "Same \n" + str(i)) for i in range(3)], "doc_id long, text string")
    first = by_id(line_dedup.dedup_lines(few, min_docs=3, keep_first=True))
    assert [first[i][0]["text"] for i in range(3)] == ["Same \n0", "1", "2"]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_near_dedup(docs, empty):
    got = by_id(near_dedup.near_duplicates(docs))
    assert got[2][0]["n_shingles"] == got[3][0]["n_shingles"] == 0 and got[2][0]["component_id"] == 2 and got[3][0]["kept"]
    assert len(got[5]) == 2 and got[None][0]["kept"] and got[5][0]["n_shingles"] == 1
    assert near_dedup.near_duplicates(empty).count() == 0


def test_decontamination(docs, empty, spark):
    bench = spark.createDataFrame([(7, "Some words, and more of them here.\nA line"), (8, None), (9, "")], "item_id long, text string")
    got = decontamination.find_contamination(docs, bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 7)]
    assert decontamination.find_contamination(docs, bench.limit(0)).count() == 0 and decontamination.find_contamination(empty, bench).count() == 0
