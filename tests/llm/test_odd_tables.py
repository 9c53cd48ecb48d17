"""Every operator and stage on null ids, repeated rows, null and long texts, empty tables, and columns named like its own."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import collocations, exact, language_id, minmax, packing, production, quality, runs, sentence_pieces, simhash, substring, token_counts, token_files, toxicity
from tessella.storage import new_folder
from tests.llm.fixtures import prose

WORD, BYTE, PIECE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
NAMES = "stays _cut_id _cut_spans score predicted h rank limit who fingerprint text_sha256 digest n_tokens fp node root component_id bucket links salt other stratum level quality toxic row chunk data tie ids decoded sketch bands key first lead side cell n word n_runs start Stays SCORE_"


def odd(spark):
    texts = [None, "", "  ", "word", prose(60, 1), prose(60, 1), prose(80, 2) + " <|endoftext|>", " ".join(prose(500, 10 + k) for k in range(60))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (4, texts[4]), (4, "another text"), (None, None), (None, texts[4]), (None, texts[4]), (None, prose(70, 3))]
    docs = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(7).alias(n) for n in NAMES.split() if n not in ("Stays", "SCORE_")], F.lit("x").alias("Stays_"))


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (4, 0, 1), (5, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "substring": lambda s, d: substring.passages(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "pieces": lambda s, d: sentence_pieces.decode(sentence_pieces.encode(d, PIECE), PIECE),
    "packing": lambda s, d: packing.pack(d, WORD, 2).groupBy("doc_id", "doc_tokens").count(),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit(d, labels(s))),
    "counts": lambda s, d: token_counts.count_tokens(d, BYTE, new_folder(s, "odd")),
    "files": lambda s, d: token_files.read_token_files(s, token_files.write_token_files(d, WORD, 1, new_folder(s, "odd"))),
    "exact": lambda s, d: exact.exact_duplicates(d),
    "language": lambda s, d: language_id.predict(d, language_id.fit(d)),
    "quality": lambda s, d: quality.judge(d, labels(s)),
    "minmax": lambda s, d: minmax.near_duplicates(d),
    "runs": lambda s, d: runs.periodic_runs(d, loops=True),
    "collocations": lambda s, d: collocations.collocations(d, least=2),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_takes_odd_tables(spark, name):
    docs = odd(spark)
    rows = OPERATORS[name](spark, docs).collect()
    if name not in ("substring", "packing", "collocations"):
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in docs.collect())
    elif name == "packing":
        assert sum(r["count"] for r in rows) >= docs.count()
    assert OPERATORS[name](spark, docs.where("false")).count() == 0


STAGES = {
    "toxicity": lambda s, d: toxicity.drop_toxic(d, toxicity.fit(d, labels(s))),
    "no_model": lambda s, d: toxicity.drop_toxic(d, None),
    "exact": lambda s, d: exact.drop_exact_duplicates(d),
    "near": lambda s, d: simhash.drop_near_duplicates(d),
    "cut": lambda s, d: substring.cut_passages(d, substring.passages(d)),
}


@pytest.mark.parametrize("name", STAGES)
def test_stage_keeps_all_columns_as_they_are(spark, name):
    docs = odd(spark)
    kept = STAGES[name](spark, docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    fixed = [c for c in docs.columns if c not in ("text", "n_chars")]
    assert kept.select(fixed).exceptAll(docs.select(fixed)).count() == 0
    assert kept.count() > 3 and STAGES[name](spark, docs.where("false")).count() == 0


def test_packing_stage_and_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "substring_dedup", "packing"]


def test_repeated_ids_do_not_pass_the_bound_of_the_fit(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}", "xx") for i in range(90)], "doc_id long, text string, lang string")
    few = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, few) is not None
    profiles = language_id.fit(docs, fit_rows=2)
    assert profiles.names == ["xx"]
    assert language_id.predict(docs, profiles).count() == 90


def test_pack_pieces_has_the_contract_s_columns(spark):
    got = production.pack_pieces(odd(spark))
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(got.columns)


def test_a_full_cache_moves_no_text(spark, monkeypatch):
    docs, cache = odd(spark), new_folder(spark, "odd")
    want = sorted(map(str, token_counts.count_tokens(docs, BYTE, cache).collect()))
    monkeypatch.setattr(token_counts, "_encode", None)
    assert sorted(map(str, token_counts.count_tokens(docs, BYTE, cache).collect())) == want


@pytest.mark.parametrize("huge", [0, 100, 1 << 30])
def test_chunks_of_huge_texts_are_hashed_apart(spark, huge):
    docs = odd(spark)
    want = {(r["doc_id"], r["text_sha256"], bytes(r["fingerprint"])) for r in exact.fingerprints(docs, chunk=64, huge=1 << 40).collect()}
    got = exact.fingerprints(docs, chunk=64, huge=huge).collect()
    assert {(r["doc_id"], r["text_sha256"], bytes(r["fingerprint"])) for r in got} == want and len(got) == docs.count()


def test_null_ids_are_compared_as_well(spark):
    """With one small prime nearly all fingerprints collide; only comparison tells texts apart."""
    rows = [(None, "abc"), (None, "cab"), (None, "ABC"), (None, "zzz"), (2, "abc"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact.exact_duplicates(docs, (3,), 64).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r["text_sha256"], set()).add((r["group_size"], r["keep_id"]))
    assert sorted(map(str, (x for s in sizes.values() for x in s))) == ["(1, None)", "(1, None)", "(2, None)", "(3, 2)"]
