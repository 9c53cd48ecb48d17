import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import random

from tessella.llm import packing, sentence_pieces, token_counts, token_files
from tessella.llm.wordids import WordEncoder
from tessella.storage import new_folder
from tests.llm.fixtures import frame, odd_texts, prose

WORD, BYTE, PIECE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def texts():
    return odd_texts() + [prose(n, n) + ".\nAnd, so on!!" for n in range(1, 200, 23)]


def library_ids(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("cache", [10, 100_000])
def test_word_encoder_is_the_library(texts, cache):
    flat, counts = WordEncoder(WORD, cache).encode(pa.array(texts))
    at = np.concatenate(([0], np.cumsum(counts)))
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == library_ids(WORD, t)


ODD_CHARACTERS = [*"abzAZ'st.,;:!-<|>/*0129 \t\n\x0b\x1c\x85 ", "\u0130", "\u0131", "ß", "Σ", "ς", "é", "e\u0301", "\u0301", "\u0307", "\u0959", "\u0a36", "\u093c", "ﬁ", "日本", "½", "ª", "\u212a", "\u200d", "🙂"]
ODD_CHARACTERS += ["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "don't", "'LL"]


def test_word_encoder_is_the_library_on_any_characters():
    from tokenizers import Tokenizer

    r, library = random.Random(7), Tokenizer.from_file(WORD)
    planes = [(0x20, 0x250), (0x250, 0x3000), (0xA000, 0xD7FF), (0xF900, 0xFFFF), (0x10000, 0x1FFFF)]
    draw = lambda: r.choice(ODD_CHARACTERS) if r.random() < 0.6 else chr(r.randrange(*r.choice(planes)))
    texts = ["A <|ENDOFTEXT|> b", "aİ.", "\u0959 .", "\u0a36/"] + ["".join(draw() for _ in range(r.randrange(1, 14))) for _ in range(10_000)]
    flat, counts = WordEncoder(WORD, 3000).encode(pa.array(texts))
    at = np.concatenate(([0], np.cumsum(counts)))
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, ascii(t)


def test_word_encoder_looks_each_word_up_once_and_keeps_it(monkeypatch):
    learned, learn = [], WordEncoder._learn
    monkeypatch.setattr(WordEncoder, "_learn", lambda self, parts: (learned.append(set(parts)), learn(self, parts))[1])
    encoder = WordEncoder(WORD, 4)
    texts = ["Élan élan, ÉLAN.", "élan one two", "élan"]
    for t in texts:
        flat, _ = encoder.encode(pa.array([t]))
        assert flat.tolist() == library_ids(WORD, t)
    assert learned[0] == {"élan", ",", "."} and not any("élan" in x for x in learned[1:])
    # texts without white space between them, signs that are no letters, and marks that join what is before
    texts = ["abc", "Ab", "", "x×Y÷z", "É\u0301 E\u0301.", "don't", "ß.A", "aª.", "aª"]
    flat, counts = encoder.encode(pa.array(["dropped", *texts]).slice(1))
    assert flat.tolist() == [i for t in texts for i in library_ids(WORD, t)] and counts.tolist() == [len(library_ids(WORD, t)) for t in texts]


def test_packing_places_each_id_once(spark, texts):
    texts = texts + [prose(4000, 5), prose(9000, 6)]
    docs = frame(spark, texts)
    rows = packing.pack(docs, WORD, 2, pool_tokens=3000).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids, at = library_ids(WORD, t) + [2], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids[at : at + r["length"]]
            at += r["length"]
        assert at == len(ids)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= pieces[0]["tier"] <= 4096
        padding, total = padding + pieces[0]["tier"] - at, total + at
    partitions = docs.rdd.getNumPartitions()
    assert padding <= 4096 * partitions
    assert packing.pack(docs.where("false"), WORD, 2).count() == 0


def test_step_groups_are_balanced():
    tiers = [4096] * 37 + [2048] * 11 + [512] * 29
    groups = packing.step_groups(tiers, 0, 16 * 4096)
    loads = [sum(t for t, g in zip(tiers, groups, strict=True) if g == k) for k in set(groups)]
    assert max(loads) - min(loads) <= 4096


def test_token_files_round_trip(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)][::-1] + [(3, "again"), (None, "no id")]
    files = token_files.write_token_files(frame(spark, rows), WORD, 1, new_folder(spark, "files"), partitions=3)
    got = token_files.read_token_files(spark, files).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    for r in got:
        if r["doc_id"] not in (None, 3):
            assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library_ids(WORD, texts[r["doc_id"]]) + [1]
    empty = token_files.write_token_files(frame(spark, texts).where("false"), WORD, 1, new_folder(spark, "files"))
    assert token_files.read_token_files(spark, empty).count() == 0


def test_token_counts_and_cache(spark, texts):
    docs = frame(spark, texts + texts[:3])
    cache = new_folder(spark, "cache")
    want = sorted((i, len((t or "").encode()), len(library_ids(BYTE, t))) for i, t in enumerate(texts + texts[:3]))
    assert sorted(map(tuple, token_counts.count_tokens(docs, BYTE, cache).collect())) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len(set(t or "" for t in texts))
    assert sorted(map(tuple, token_counts.count_tokens(docs, BYTE, cache).collect())) == want
    assert spark.read.parquet(cache).count() == len(set(t or "" for t in texts))  # nothing was encoded again
    assert token_counts.count_tokens(docs.where("false"), BYTE, cache).count() == 0


def test_part_counter_is_the_library():
    counter = token_counts.PartCounter(BYTE)
    for t in ["a  b\n\n c\t d", "x.\n\n\ny, z.  ", "  lead", "tail  \n", "m²,n ab3c. it's.  x", "\x1c a", "<|endoftext|>"]:
        assert counter.count(t) == len(library_ids(BYTE, t))


def test_pieces_are_the_library_s(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    extra = ["a  b\tc\nd e▁f  ", "def f(x):\n    return  x**2", "<0x41></s><unk>", "🙂🙂", "internationalization" * 100]
    docs = frame(spark, texts + extra).drop("ids")
    coded = sentence_pieces.encode(docs, PIECE)
    assert coded.columns == [*docs.columns, "piece_ids"]
    rows = sentence_pieces.decode(coded, PIECE).collect()
    for r in rows:
        assert r["piece_ids"] == model.encode(r["text"] or "")
        assert r["decoded"] == (r["text"] or "").replace("▁", " ")
    assert sentence_pieces.encode(docs.where("false"), PIECE).count() == 0


def piece_library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def test_streaming_does_not_depend_on_the_chunks():
    encoder, r = sentence_pieces.StreamingEncoder(PIECE), random.Random(3)
    text = "▁" + "".join(r.choice("abcdeorstin▁▁.,()=é\n") for _ in range(3000))
    whole = list(encoder.pieces((text,)))
    assert encoder.vocabulary.text(whole) == text
    want = piece_library().encode(text[1:].replace("▁", " "))
    for n in (1, 40, 900):
        cuts = sorted(r.sample(range(len(text)), n))
        chunks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        assert list(encoder.pieces(chunks)) == whole
        assert np.frombuffer(b"".join(encoder.stream(chunks)), encoder.vocabulary.dtype).tolist() == want


def test_paths_converge_and_little_is_held(monkeypatch):
    """Ids are committed on the way, in texts with and without blanks; the uncommitted stretch stays short."""
    encoder, most, commits = sentence_pieces.StreamingEncoder(PIECE), 0, 0
    commit = sentence_pieces.Window._commit

    def counted(self, cut):
        nonlocal most, commits
        most, commits = max(most, len(self.last)), commits + 1
        return commit(self, cut)

    monkeypatch.setattr(sentence_pieces.Window, "_commit", counted)
    for text in (prose(2000, 5), "abcdefgh" * 3000, "日本語テキスト" * 2000):
        commits = 0
        assert np.frombuffer(encoder.vocabulary.packed(encoder.pieces(("▁" + text.replace(" ", "▁"),))), "<u2").tolist() == piece_library().encode(text)
        assert commits > len(text) // 200
    assert most <= 4 * sentence_pieces.COMMIT_EVERY


def test_long_stretches_run_over_chunks(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "CHUNK", 50)
    encoder, library, r = sentence_pieces.StreamingEncoder(PIECE), piece_library(), random.Random(9)
    texts = [" " * 400 + "end", "ab" * 300 + "\n" + "x" * 170, "🙂" * 400, " " * 49 + "a" * 51 + " " * 120 + "\n\n", "a" + " " * 300]
    texts += ["".join(r.choice(["a", "b", " ", " ", "\n", "é", ".", "the", "ing ", "🙂", " " * 60, "z" * 70]) for _ in range(r.randrange(1, 60))) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), encoder.vocabulary.dtype).tolist() == library.encode(t), ascii(t)


def test_decoder_takes_odd_ids():
    import sentencepiece

    decoder, model = sentence_pieces.Decoder(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert decoder.decode(None) == decoder.decode([]) == ""
    assert decoder.decode_all(np.array([5, 6, 300], np.int64), [0, 0, 2, 3]) == ["", decoder.decode([5, 6]), decoder.decode([300])]
    byte = model.piece_to_id("<0xE2>")
    assert "�" in decoder.decode([byte])
    assert zlib.crc32(decoder.decode(model.encode("plain text")).encode()) == zlib.crc32(b"plain text")
