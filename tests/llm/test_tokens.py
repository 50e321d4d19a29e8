import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as known
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import bpe, token_output
from tidemark.llm.queries import QUERIES

RANKS = known.path("byte_bpe_multi_50k.tiktoken")
FILE = known.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=known.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_on_odd_texts(reference):
    coder, rng = bpe.Bpe(bpe.load_ranks(RANKS), known.PATTERN), random.Random(1)
    parts = ["a", "aa", "the", "ß", " ", "  ", "\n", "é", "日本", "1", "##", "'s", "x", "\t", "😀", " ", ",", "."]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert [np.frombuffer(x, "<i4").tolist() for x in coder.encode([text])] == [reference.encode_ordinary(text)]
    assert not any(coder.low) and not any(coder.mid)


def test_one_queue_for_many_pre_tokens_equals_one_each(reference):
    coder, rng = bpe.Bpe(bpe.load_ranks(RANKS), known.PATTERN), random.Random(4)
    words = ["".join(rng.choice(("a", "aa", "th", "e", "ß", "日", "q", "ing", "\x00")) for _ in range(rng.randint(1, 30))).encode() for _ in range(800)]
    ids, ends = coder.merge_all(words)
    starts = [0, *ends.tolist()]
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [reference._core_bpe.encode_single_piece(w) if w not in coder.ranks else coder.merge_all([w])[0].tolist() for w in words]
    assert not any(coder.low) and not any(coder.mid)


def test_blanks_that_touch_other_white_space_separate_nothing(reference):
    coder = bpe.Bpe(bpe.load_ranks(RANKS), known.PATTERN)
    texts = ["a \u00a0 \u00a0 b", "a\u00a0 b", "a \n\n b", "x \t y z", "one two \u3000 three", " lead", "trail ", "nl\n", " ", "  ", "a 's b", "z \u200b y", "z \x1c y", "q\u180e r"]
    want = [reference.encode_ordinary(t) for t in texts]
    assert [np.frombuffer(x, "<i4").tolist() for x in coder.encode(texts)] == want
    small = bpe.PieceCache(coder._alone, coder._led, 2)
    assert [np.frombuffer(x, "<i4").tolist() for x in small.encode(texts) if x is not None] == want


def test_bpe_long_pre_token_stays_near_linear(reference):
    coder = bpe.Bpe(bpe.load_ranks(RANKS), known.PATTERN)
    assert coder.merge(b"ab" * 5000) == reference.encode_ordinary("ab" * 5000)
    assert len(coder.merge(b"ab" * 200_000)) > 0


def test_encode_and_decode_round_trip(docs, no_docs, reference):
    coded = bpe.encode(docs, RANKS, known.PATTERN)
    assert coded.columns == ["doc_id", "text", "lang", "th", "score", "ids"]
    rows = bpe.decode(coded, RANKS).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r["text"] or ""
        assert r["ids"] == reference.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    both = bpe.encode(docs.withColumn("decoded", docs["lang"]), RANKS, known.PATTERN, decoded="decoded").collect()
    assert sorted(str((r["ids"], bytes(r["decoded"]))) for r in both) == sorted(str((r["ids"], bytes(r["decoded"]))) for r in rows)
    assert bpe.encode(no_docs, RANKS, known.PATTERN).count() == 0


def test_files_give_back_all_ids_in_order(docs, no_docs):
    tok = Tokenizer.from_file(FILE)
    manifest = token_output.write_token_files(docs, FILE)
    rows = token_output.read_token_files(manifest).collect()
    assert len(rows) == docs.count()
    want = sorted(([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()), key=str)
    got = [np.frombuffer(r["ids"], "<u4").tolist() for r in rows]
    assert sorted(got, key=str) == want
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == sorted((r["doc_id"] for r in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in ordered:
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]
    assert token_output.read_token_files(token_output.write_token_files(no_docs, FILE)).count() == 0


def test_one_document_is_read_alone_and_damage_is_seen(docs):
    uri = token_output.write_token_files(docs, FILE).first()["path"]
    reader = token_output.ShardReader(uri)
    k = len(reader.doc_ids) - 1
    assert reader.read(k) == dict(enumerate(raw for _, raw in reader.scan()))[k]
    path = uri.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[int(reader.at[k]) + int(reader.table["packed"][k]) - 1] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception):
        token_output.ShardReader(uri).read(k)


@pytest.mark.parametrize("as_text", [False, True])
def test_pieces_equal_the_whole_text(as_text):
    tok, own, rng = Tokenizer.from_file(FILE), token_output.PieceEncoder(FILE, as_text), random.Random(2)
    tok.encode_special_tokens = as_text
    parts = ["ab", "don't", " ", "  ", "\n", "é", "日本", "12", "<|endoftext|>", "x,", "\t", "😀", " ", "　"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for text, raw in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_special_strings_are_what_the_plain_call_gives(spark):
    text = "a <|endoftext|> b<|endoftext|>c  <|endoftext|> d"
    rows = token_output.read_token_files(token_output.write_token_files(spark.createDataFrame([(1, text)], "doc_id long, text string"), FILE)).collect()
    want = Tokenizer.from_file(FILE).encode(text, add_special_tokens=False).ids
    assert want.count(50256) == 3 and np.frombuffer(rows[0]["ids"], "<u4").tolist() == [*want, 0]


def test_blanks_in_other_white_space_separate_nothing():
    tok, own = Tokenizer.from_file(FILE), token_output.PieceEncoder(FILE)
    texts = ["a \u00a0 \u00a0 b", "a\u00a0 b", "a \n\n b", "x \t y z", "one two \u3000 three", "plain words only", " lead", "trail ", "nl\n", " ", "z \u200b y", "z \x1c y", "q\u180e r"]
    for text, raw in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_the_query_equals_the_library_over_all_documents(spark, sf_dir, reference):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    tok = Tokenizer.from_file(FILE)
    rows = {r["doc_id"]: r for r in QUERIES["op6_byte_bpe"](spark, sf_dir).collect()}
    files = {r["doc_id"]: r for r in QUERIES["op9_token_output"](spark, sf_dir).collect()}
    assert set(rows) == set(files) == set(texts)
    start = 0
    for i in sorted(texts):
        ids = reference.encode_ordinary(texts[i])
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert rows[i]["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest()
        other = [*tok.encode(texts[i], add_special_tokens=False).ids, 0]
        assert (files[i]["start"], files[i]["n_tokens"], files[i]["ids_crc32"]) == (start, len(other), zlib.crc32(np.array(other, "<u4").tobytes()))
        start += len(other)
