import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sheaf.llm import mixing
from sheaf.llm.arrays import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def plain_base(rows):
    tokens = {i: [*WORD.findall((t or "").translate(LOW)), None] for i, (_, t) in enumerate(rows)}
    counts = Counter(w for i, (d, _) in enumerate(rows) if not held(d) for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    return sorted(
        (repr(d), held(d), len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[i]), 5))
        for i, (d, _) in enumerate(rows)
    )


def made(seed=1, n=150):
    r = random.Random(seed)
    parts = ["th", "er", "ing", "Ou", "é", "日本", "an", "st"]
    word = lambda: "".join(r.choice(parts) for _ in range(r.choice([1, 1, 2, 3])))
    rows = [(i, r.choice([" ", "\n"]).join(word() for _ in range(r.choice([0, 1, 20, 300])))) for i in range(n)]
    return [*rows, (900, None), (901, ""), (902, " \t "), (None, "the null id"), rows[3], rows[3], (903, "ing ou " * 40_000)]


@pytest.mark.parametrize("block", [1 << 25, 5_000])
def test_base_equals_plain_count(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_BYTES", block)
    rows = made()
    got = mixing.score(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == plain_base(rows)
    assert all(r.score < 0 and r.score == pytest.approx(-r.bits_per_byte * max(1, len((dict(rows)[r.doc_id] or "").encode())) * math.log10(2)) for r in got)


def test_smallest_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = mixing.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == plain_base(rows)
    size = sum(len(t.encode()) for d, t in rows if held(d))
    assert sum(-r.score for r in got if r.held_out) / math.log10(2) / size < 2.8


def model_of(texts):
    counts = np.zeros(257, np.int64)
    (s,) = slices(pa.array(texts))
    counts[:256] = np.bincount(s.lower().data, minlength=256)
    counts[256] = len(texts)
    code = mixing.huffman(counts)
    every = mixing.all_pieces(pa.array(texts))
    held = np.zeros(2 * mixing.SLOTS, np.int64)
    mixing._count(held, every, code)
    model = mixing.Mixer.of(code, held)
    model.learn(every)
    return model


def test_pieces_are_whole_texts_in_order():
    texts = ["ab  cd\n", "", " x", "Ab ab", "é\t"]
    (s,) = slices(pa.array(texts))
    p, row = mixing.pieces(s)
    ends = [*p.start[1:], len(p.symbols)]
    read = [(int(r), "".join(chr(x) if x < 256 else "." for x in p.symbols[a:b])) for r, a, b in zip(row, p.start, ends)]
    assert read[:4] == [(0, "ab "), (0, " "), (0, "cd\n"), (0, ".")] and (1, ".") in read and read.count((3, "ab ")) == 1
    for i, t in enumerate(texts):
        assert "".join(x for r, x in read if r == i)[:-1].encode("latin-1").decode() == "".join(t).lower()
    d, back = mixing.distinct(p, True)
    again = d.part(back)
    assert again.symbols.tolist() == p.symbols.tolist() and d.count.sum() == len(p.start)


def test_next_symbols_are_a_distribution():
    """What a model gives all 257 symbols after one beginning adds up to one."""
    model = model_of(["ab ba ab", "b", "", "aab", "abab ab ab ab"])
    for begin in ([], [97], [97, 98], [99] * 5):
        n = len(begin) + 1
        symbols = np.array([x for last in range(257) for x in [*begin, last]], np.int16)
        h = np.arange(257, dtype=np.uint64)
        p = mixing.Pieces(symbols, np.arange(257) * n, h, h, np.ones(257, np.int64))
        whole = model.bits_of(p)
        assert np.exp2(-whole[:, 2]).sum() == pytest.approx(1, abs=1e-3)
        if not begin:
            assert np.exp2(-whole[:, :2]).sum(axis=0) == pytest.approx(1, abs=1e-3)


def test_contexts_stay_inside_a_piece():
    model = model_of(["ab cd", "zz cd"])
    a, b = (mixing.coded(mixing.pieces(next(slices(pa.array([t]))))[0], model.code) for t in ("ab cd", "zz cd"))
    for x, y in zip(a.slots, b.slots, strict=True):
        assert x[a.piece == 1].tolist() == y[b.piece == 1].tolist()


def test_counts_of_a_large_corpus_stay_finite():
    model = model_of(["ab ba ab", "b", "aab"])
    big = mixing.Mixer.of(model.code, np.stack([model.zeros, model.ones], axis=1).ravel().astype(np.float64) * 1e12)
    every = mixing.all_pieces(pa.array(["ab ba ab", "zz"]))
    every.count = every.count * 10**12
    big.learn(every)
    assert np.isfinite(big.weights).all() and np.isfinite(big.bits_of(every)).all()


def test_empty_table(spark):
    assert mixing.score(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_every_training_piece_teaches_the_mixer(spark, monkeypatch):
    """Refining counts hold each bit of each training piece, however many there are, and weights are those of
    one fit over all of them."""
    monkeypatch.setattr(mixing, "FLUSH", 20_000)
    r = random.Random(5)
    rows = [(i, " ".join(f"{r.randrange(10**9):x}" for _ in range(2000)) + " the end") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).select("doc_id", "text", (mixing.remainder(7) != 2).alias("train"))
    code = mixing.huffman(mixing.code_counts(docs)[0])
    counts, kept = mixing.slot_counts(docs, code)
    model = mixing.Mixer.of(code, counts)
    mixing.learn_all(kept, model)
    every = mixing.all_pieces(pa.array([t for d, t in rows if not held(d)]))
    assert len(every.start) > 60_000
    b = mixing.coded(every, code)
    assert model.refined.sum() == every.count[b.piece].sum()
    plain = mixing.Mixer.of(code, counts)
    plain.learn(every)
    assert np.allclose(model.weights, plain.weights) and np.allclose(model.refined, plain.refined)


def test_pieces_come_back_from_rows():
    texts = ["ab  cd\n", "", " x", "Ab ab", "é\t"]
    p = mixing.all_pieces(pa.array(texts))
    (batch,) = mixing.piece_rows(p)
    got = mixing.read_pieces(batch.column("counts"), batch.column("n"))
    assert [x.tolist() for x in (got.symbols, got.start, got.count)] == [x.tolist() for x in (p.symbols, p.start, p.count)]


def test_weights_have_the_least_loss():
    texts = [" ".join(random.Random(i).choices(["the", "then", "other", "ing", "ou"], k=200)) for i in range(30)]
    model = model_of(texts)
    every = mixing.all_pieces(pa.array(texts))
    start = mixing.Mixer.of(model.code, np.stack([model.zeros, model.ones], axis=1).ravel()).sums(every)
    assert model.sums(every).loss.sum() < start.loss.sum()


def test_texts_are_counted_in_small_batches(spark, monkeypatch):
    """Workers that count get batches of bounded size, and the session keeps its setting."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    sizes, real, before = [], mixing.arrow_batches, spark.conf.get(key)

    def noted(session, size):
        sizes.append(size)
        return real(session, size)

    monkeypatch.setattr(mixing, "arrow_batches", noted)
    docs = spark.createDataFrame([(i, "a b " * 50, True) for i in range(200)], "doc_id bigint, text string, train boolean")
    monkeypatch.setattr(mixing, "BATCH_BYTES", 2_000)
    few = mixing.code_counts(docs)
    counts, kept = mixing.slot_counts(docs, mixing.huffman(few[0]))
    assert sizes == [2_000, 2_000] and spark.conf.get(key) == before
    monkeypatch.undo()
    whole = mixing.code_counts(docs)
    again, kept_again = mixing.slot_counts(docs, mixing.huffman(whole[0]))
    assert few[0].tolist() == whole[0].tolist() and few[1] == whole[1] and np.array_equal(counts, again)
    rows = lambda df: sorted((bytes(r.piece), r.n) for r in df.collect())
    assert rows(kept) == rows(kept_again) and mixing.BATCH_BYTES <= 4 << 20


def test_known_predictions_are_those_of_the_counts():
    """What is looked up for every slot is what counts give, bit by bit, as when bits are left out."""
    model = model_of(["ab ba ab", "b", "aab", "the other then"])
    b = mixing.coded(mixing.all_pieces(pa.array(["ab the zz", "other"])), model.code)
    x, gate = model.inputs(b)
    want = np.zeros(len(b.bit), np.int64)
    for i, slot in enumerate(b.slots):
        ones, zeros = model.ones[slot], model.zeros[slot]
        assert np.array_equal(x[:, i], mixing._stretch(ones, zeros))
        want = want * mixing.TRUST + mixing._trust(ones + zeros)
    assert np.array_equal(gate, want) and np.allclose(model.mix(x, gate), np.clip((model.weights[gate] * x).sum(axis=1), -12, 12))
    assert model.known is model.known  # worked out once


def test_beginnings_that_pieces_share_are_coded_once(monkeypatch):
    texts = ["abcdefgh abcdefghx abcdefghy", "abcdefg bcdefgh"]
    model = model_of(texts)
    every = mixing.all_pieces(pa.array(texts))
    bits = len(mixing.coded(every, model.code).bit)
    begun = {bytes(every.symbols[a : i + 1]) for a, b in zip(every.start, [*every.start[1:], len(every.symbols)]) for i in range(a, b)}
    seen = []
    plain = mixing.Mixer.inputs
    monkeypatch.setattr(mixing.Mixer, "inputs", lambda self, b, *a, **k: seen.append(b) or plain(self, b, *a, **k))
    whole = model.bits_of(every)
    assert sum(len(set(b.piece.tolist())) for b in seen) == len(begun) and sum(len(b.bit) for b in seen) < 0.6 * bits
    for i in range(len(every.start)):  # each piece by itself costs the same
        assert model.bits_of(every.part(np.array([i])))[0] == pytest.approx(whole[i])


def test_sums_are_those_of_every_bit():
    texts = ["abab abac abad ab ab", "b", "", "aab abab"]
    model = model_of(texts)
    every = mixing.all_pieces(pa.array(texts))
    found = model.sums(every)
    b = mixing.coded(every, model.code)
    x, gate = model.inputs(b, without=True)
    q, weight = 1 / (1 + np.exp(-model.mix(x, gate))), every.count[b.piece]
    assert found.seen.sum() == weight.sum()
    assert found.loss.sum() == pytest.approx(-(weight * np.log(np.where(b.bit == 1, q, 1 - q))).sum())
    assert found.slope.sum(axis=0) == pytest.approx((x * (weight * (b.bit - q))[:, None]).sum(axis=0))
    last = model.sums(every, last=True)
    assert (last.loss == found.loss).all() and (last.seen == found.seen).all() and not last.curve.any()


def test_tables_of_powers_do_not_grow_with_a_block(monkeypatch):
    """A worker keeps these tables, so a block of many distinct words must not lengthen them."""
    from sheaf.llm import arrays

    monkeypatch.setattr(arrays, "_powers", {})
    r = np.random.default_rng(5)
    texts = [" ".join(f"{x:016x}" for x in r.integers(0, 1 << 62, 30_000)) for _ in range(3)]
    model = model_of(["ab 0123456789abcdef"])
    none = pa.table({c: pa.array([], pa.int64()) for c in ("h1", "h2", "total")})
    group = pa.table({"doc_id": [1, 2, 3], "text": texts, "train": [True, True, False]})
    out = mixing._scored(group, none, model, 60_002)
    assert out.column("n_tokens").to_pylist() == [30_001] * 3
    assert max(len(x) for x in arrays._powers.values()) < arrays.SLICE_BYTES + 1000


def across_model(texts):
    """``model_of`` with counts across words, and the pieces of ``texts`` in order."""
    model = model_of(texts)
    held = np.zeros(2 * (mixing.SLOTS + mixing.ACROSS), np.int64)
    held[: 2 * mixing.SLOTS] = np.stack([model.zeros, model.ones], axis=1).ravel()
    mixing.all_pieces(pa.array(texts), each=lambda *x: mixing._count_across(held[2 * mixing.SLOTS :], *x, model.code))
    out = mixing.Mixer.of(model.code, held)
    out.weights, out.refined = model.weights, model.refined
    return out


def in_order(texts):
    (s,) = slices(pa.array(texts))
    p, row = mixing.pieces(s)
    own, back = mixing.distinct(p, True)
    return own, back, row


def moved_plainly(model, p, piece, row):
    """Bit by bit over one text after another."""
    b = mixing.coded(p, model.code)
    x, gate = model.inputs(b)
    x, mixed = x.astype(float), model.mix(x, gate)
    tail, out = mixing.tails(p), []
    for text in np.unique(row):
        w, a, slopes, n, before = np.array([1.0, 0, 0, 0]), mixing.START_ACROSS, [], 0, np.uint32(0)
        for k in piece[row == text]:
            cost = 0.0
            for i in np.flatnonzero(b.piece == k):
                slot = mixing.SLOTS + int(mixing.across_slots(b.name[i : i + 1], np.array([before]))[0])
                ones, zeros = float(model.ones[slot]), float(model.zeros[slot])
                say = (ones + zeros) / (ones + zeros + mixing.DOUBT)
                y = say * (math.log(ones + 0.15) - math.log(zeros + 0.15) - mixed[i])
                z = min(max(np.dot(w, [mixed[i], *x[i]]) + a * y, -12), 12)
                q = 1 / (1 + math.exp(-z))
                cost -= math.log2(q if b.bit[i] else 1 - q)
                slopes.append((b.bit[i] - q) * np.array([mixed[i], *x[i], y]))
                n += 1
                if n % mixing.MOVE == 0:
                    step = mixing.RATE * sum(slopes)
                    w, a, slopes = w + step[:4], a + step[4], []
            out.append(cost)
            before = tail[k]
    return out


TEXTS = ["the cat sat on the mat the cat", "", "on the mat sat the cat\n on the mat", "x", "thecatsatonthematthecatsatonthemat " * 3, "the the the the cat cat cat the the the"]


@pytest.mark.parametrize(("lanes", "window"), [(512, 1 << 18), (2, 1), (3, 100)])
def test_weights_move_along_each_text_as_in_a_plain_loop(monkeypatch, lanes, window):
    """Whatever the texts side by side and the stretch in memory."""
    monkeypatch.setattr(mixing, "LANES", lanes)
    monkeypatch.setattr(mixing, "WINDOW_BITS", window)
    model = across_model(["the cat sat on the mat", "a cat on a mat", "thecatsat sat"])
    p, piece, row = in_order(TEXTS)
    got, costs = mixing.moving_bits(model, p, piece, row, len(TEXTS))
    assert got == pytest.approx(moved_plainly(model, p, piece, row), rel=1e-4, abs=1e-4)
    assert costs == pytest.approx(model.bits_of(p))


def test_order_of_words_counts(spark):
    """The same words in an order that training texts have are likelier than in another."""
    r = random.Random(3)
    pairs = [("red", "apple"), ("green", "pear"), ("blue", "plum"), ("black", "grape")]
    made_ = lambda: " ".join(w for _ in range(40) for w in r.choice(pairs))
    ids = [i for i in range(400) if held(i)][:2]
    words = made_().split(" ")
    other = words[:]
    r.shuffle(other)
    rows = [(ids[0], " ".join(words) + " "), (ids[1], " ".join(other) + " "), *((i, made_()) for i in range(1000, 1100))]
    got = {x.doc_id: x for x in mixing.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    a, b = got[ids[0]], got[ids[1]]
    assert a.held_out and b.held_out and a.base_score == pytest.approx(b.base_score) and a.score > b.score + 5


def test_moving_predictions_are_a_distribution():
    """After one beginning, what all 257 next symbols are given adds up to one, weights having moved."""
    model = across_model(["ab ba ab", "b", "", "aab", "abab ab ab ab"])
    begin = np.array([97, 98, 32] * 30, np.int16)
    symbols = np.concatenate([begin[:3], np.arange(257, dtype=np.int16)])
    h = np.arange(258, dtype=np.uint64)
    p = mixing.Pieces(symbols, np.append(0, np.arange(257) + 3), h, h, np.ones(258, np.int64))
    piece = np.concatenate([[*[0] * 30, 1 + k] for k in range(257)])
    row = np.repeat(np.arange(257), 31)
    got, _ = mixing.moving_bits(model, p, piece, row, 257)
    assert np.exp2(-got[30::31]).sum() == pytest.approx(1, abs=1e-3)
    first = got[:31]
    assert first[1] != pytest.approx(first[29])  # the weights moved


def test_every_bit_of_training_texts_is_counted_across_words(spark):
    rows = [(i, f"a bc{i % 3} def ghi\t" * (i % 4)) for i in range(30)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).select("doc_id", "text", (mixing.remainder(7) != 2).alias("train"))
    code = mixing.huffman(mixing.code_counts(docs)[0])
    counts, _ = mixing.slot_counts(docs, code)
    taught = [t or "" for d, t in rows if not held(d)]
    want = np.zeros(2 * mixing.ACROSS, np.int64)
    p, piece, row = in_order(taught)
    b, tail = mixing.coded(p, code), mixing.tails(p)
    for j, k in enumerate(piece):
        of = np.flatnonzero(b.piece == k)
        before = tail[piece[j - 1]] if j and row[j] == row[j - 1] else np.uint32(0)
        np.add.at(want, 2 * mixing.across_slots(b.name[of], np.full(len(of), before)) + b.bit[of], 1)
    assert np.array_equal(counts[2 * mixing.SLOTS :], want) and want.sum() == mixing.bit_counts(p, code)[piece].sum()
