"""The registered queries of this subpackage, by name, on the supplied tables: against SQL, libraries and brute force."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from tessella.llm import queries, simhash
from tessella.llm.sql import oracle_sql

DATA = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the supplied tables are not here")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def run(spark, name, data=SMALL):
    return queries.queries()[name](spark, data)


@pytest.mark.parametrize("name", ["op8_exact_dedup", "op10_quality_rules", "op13_collocations"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    a, b = run(spark, name, DATA).toPandas(), con.execute(oracle_sql()[name]).df()
    columns = sorted(b.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert a.equals(b)


def test_quality_rules_are_active_and_controlled(spark):
    """Rules reject texts beyond the base checks, catch most of the bad ones and hardly any good one."""
    got = {r["doc_id"]: r for r in run(spark, "op10_quality_rules", DATA).collect()}
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    english = [r for i, r in got.items() if lang[i] == "en" and not r["base_failed"]]
    assert any(not r["kept"] for r in english)
    good, bad = ([r for r in english if marks.get(r["doc_id"]) == q] for q in (1, 0))
    assert sum(not r["kept"] for r in good) <= 0.05 * len(good)
    assert sum(r["kept"] for r in bad) < 0.2 * len(bad)


def test_simhash_query_is_brute_force(spark, documents):
    got = {r["doc_id"]: r for r in run(spark, "op2_simhash_dedup").collect()}
    prints = {i: simhash.fingerprint(r["text"]) for i, r in documents.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    root = {i: i for i in prints}
    for _ in range(len(root)):
        before = dict(root)
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    assert {i: r["component_id"] for i, r in got.items()} == root


def test_token_queries_are_the_libraries(spark, documents):
    import sentencepiece
    from tokenizers import Tokenizer

    word, byte = (Tokenizer.from_file(public_tokenizers.path(x)) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = {i: word.encode(r["text"] or "", add_special_tokens=False).ids for i, r in documents.items()}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    start = 0
    files = {r["doc_id"]: r for r in run(spark, "op7_token_files").collect()}
    for i in sorted(ids):
        assert (files[i]["start"], files[i]["n_tokens"], files[i]["ids_crc32"]) == (start, len(ids[i]) + 1, crc([*ids[i], 1]))
        start += len(ids[i]) + 1
    pieces = run(spark, "op4_packing").collect()
    for r in pieces:
        whole = [*ids[r["doc_id"]], 2]
        assert r["doc_tokens"] == len(whole) and r["ids_crc32"] == crc(whole[r["start"] : r["start"] + r["length"]])
    assert sum(r["length"] for r in pieces) == sum(len(x) + 1 for x in ids.values())
    for r in run(spark, "op6_token_counts").collect():
        text = documents[r["doc_id"]]["text"] or ""
        n = len(byte.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024)
    for r in run(spark, "op3_sentencepiece").collect():
        text = documents[r["doc_id"]]["text"] or ""
        assert r["n_pieces"] == len(piece.encode(text)) and r["round_trip"] == (piece.decode(piece.encode(text)) == text)


def test_models_do_well_on_what_is_held_out(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    said = [r for r in run(spark, "op9_language_id", DATA).collect() if r["held_out"] and docs[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in said]) > 0.98
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    held = [r for r in run(spark, "op5_toxicity", DATA).collect() if r["held_out"] and marks.get(r["doc_id"]) is not None]
    toxic, clean = ([r["predicted"] for r in held if marks[r["doc_id"]] == x] for x in (1, 0))
    assert np.mean(toxic) > 0.7 and np.mean(clean) < 0.02


def test_pipeline_and_passages(spark, documents):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, SMALL).count() > 0
    found = run(spark, "op1_substring_dedup").collect()
    words = {i: (r["text"] or "").lower().split() for i, r in documents.items()}
    for r in found:
        assert r["other"] < r["doc_id"] and r["end"] - r["start"] >= 50 and r["end"] <= len(words[r["doc_id"]])
    exact = {r["doc_id"]: r for r in run(spark, "op8_exact_dedup").collect()}
    lower = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    assert all(r["text_sha256"] == hashlib.sha256(lower(documents[i]["text"])).hexdigest() for i, r in exact.items())
