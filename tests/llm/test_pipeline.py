"""The stages over the smallest tables, each held against what its operator reports or a plain version."""

import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from sheaf.llm import bpe, decontaminate, minhash, toxicity
from sheaf.llm.near import written
from tests.llm.test_decontaminate import plain
from tests.llm.test_near import plain_lines


def test_stages(spark, sf_dir):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], sf_dir), "stage"))
    for df in kept[1:-1]:
        assert df.columns == docs.columns and dict(df.dtypes) == dict(docs.dtypes)
    texts = [{r.doc_id: r.text for r in df.select("doc_id", "text").collect()} for df in kept[:-1]]
    ids = [set(t) for t in texts]
    # Toxic documents go, all others stay as they are.
    toxic = {r.doc_id for r in toxicity.toxicity_report(docs, labels).collect() if r.predicted}
    assert ids[1] == ids[0] - toxic and all(texts[1][d] == texts[0][d] for d in ids[1])
    # Lines: what a plain search keeps.
    stays = {(d, n) for d, n, _, _, keep in plain_lines(list(texts[1].items())) if keep}
    for d, t in texts[1].items():
        left = [x for n, x in enumerate((t or "").split("\n")) if not x.strip(" \t\x0b\f\r") or (d, n) in stays]
        assert texts[2].get(d, "") in ("\n".join(left), "") and (d in ids[2]) == any(x.strip() for x in left)
    # One of each class; no class is left.
    report = minhash.class_report(kept[2]).collect()
    assert ids[3] == {r.doc_id for r in report if r.keep}
    assert all(r.members == 1 for r in minhash.class_report(kept[3]).collect())
    # Contaminated documents go.
    found = plain(list(texts[3].items()), [tuple(r) for r in items.select("item_id", "text").collect()])
    assert ids[4] == {r[0] for r in found if not r[-1]}
    # Tokens are those of the public encoder.
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = {r.doc_id: r for r in kept[5].collect()}
    assert tokens.keys() == ids[4]
    for d, t in texts[4].items():
        packed = b"".join(i.to_bytes(4, "little") for i in known.encode_ordinary(t or ""))
        assert tokens[d].ids_sha256 == hashlib.sha256(packed).hexdigest() and tokens[d].n_tokens == len(packed) // 4
    assert decontaminate.drop_contaminated(kept[4], items).count() == len(ids[4])


def test_run_gives_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
