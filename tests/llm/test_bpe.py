import hashlib
import time

import public_tokenizers as P
import pytest
import tiktoken

from sheaf.llm import bpe

RANKS = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def known():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


TEXTS = [
    None, "", " ", "a", "Hello world's end, they'll say 12345\n\n\t x", "   wide　blank \x1c\x1d\x85  end ",
    "日本語のテキスト 한국어 العربية", "a" * 5000, " " * 3000, "ab" * 4000 + "é", "<|endoftext|>", "😀👩‍👩‍👧 x́y ½ Ⅷ ²", "\r\n \r\n", "x\x00y",
]


def test_ids_equal_the_public_encoder(spark, known):
    rows = [(i, t, i) for i, t in enumerate(TEXTS + TEXTS[3:6])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    out = bpe.encode(df, RANKS, P.PATTERN)
    got = {r.doc_id: r.ids for r in bpe.decode(out.withColumn("ids", out.ids), RANKS).select("doc_id", bpe.unpack_ids("ids").alias("ids")).collect()}
    assert got == {i: known.encode_ordinary(t or "") for i, t, _ in rows}


def test_report_on_the_smallest_table(spark, sf_dir, known):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    rows = bpe.token_report(df, RANKS, P.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = known.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_table_and_nulls(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.token_report(df, RANKS, P.PATTERN).count() == 0
    df = spark.createDataFrame([(None, None), (None, None)], "doc_id bigint, text string")
    assert [r.n_tokens for r in bpe.token_report(df, RANKS, P.PATTERN).collect()] == [0, 0]


def test_an_idle_worker_lets_pieces_go(monkeypatch):
    monkeypatch.setattr(bpe, "IDLE_SECONDS", 0.05)
    encoder = bpe.Encoder(RANKS, P.PATTERN)
    with encoder:
        first = encoder.encode("some words")
        time.sleep(0.2)
        assert encoder.kept  # still at work
    with encoder:
        pass
    time.sleep(0.3)
    assert not encoder.kept
    with encoder:
        assert encoder.encode("some words") == first
