import os
import random

import numpy as np
import pytest

from tallyframe.llm.packing import LOSS, VOCABULARY, fill_containers, pack, pieces, stretches, tokenizer, tokens_in

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
SCHEMA = "doc_id long, piece int, first_token int, n_tokens int, loss_tokens int"


@pytest.mark.parametrize("seed", range(4))
def test_limits_hold_and_little_is_left(seed):
    r = np.random.default_rng(seed)
    n = r.integers(0, 100, 3000)
    demand = np.column_stack([n, np.ones(3000, int), (n * r.random(3000)).astype(int)])
    limits = np.array([100, 7, 99])
    at = pack(demand, limits)
    sums = np.array([[demand[at == k, j].sum() for j in range(3)] for k in range(at.max() + 1)])
    assert (sums <= limits).all() and len(at) == 3000
    need = (demand.sum(axis=0) / limits).max()
    assert at.max() + 1 <= 1.03 * need + 2


def test_each_limit_binds():
    ones = np.ones((10, 3), int)
    assert [pack(ones, np.array(x)).max() + 1 for x in ([5, 99, 99], [99, 2, 99], [99, 99, 1])] == [2, 5, 10]
    assert len(pack(np.zeros((0, 3), int), np.array([1, 1, 1]))) == 0
    with pytest.raises(ValueError):
        pack(np.array([[6, 1, 1]]), np.array([5, 9, 9]))


@needs_vocabulary
def test_pieces(spark):
    rows = [(1, "A short text."), (2, None), (3, ""), (4, "word " * 5000), (5, "Question?\n\nAnswer one two three."), (6, "x" * 250_000), (1, "A short text.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as n_tokens")
    got = [tuple(r) for r in pieces(docs).collect()]
    encode = tokenizer().encode_ordinary
    assert [g for g in got if g[0] in (2, 3)] == [(2, 0, 0, 0, 0), (3, 0, 0, 0, 0)]
    long = sorted(g for g in got if g[0] == 4)
    assert sum(g[3] for g in long) == len(encode("word " * 5000)) and all(g[3] == 2048 for g in long[:-1]) and [g[2] for g in long] == [2048 * i for i in range(len(long))]
    q = next(g for g in got if g[0] == 5)
    assert q[3] == len(encode(rows[4][1])) and q[4] == q[3] - len(encode("Question?"))
    assert sum(g[0] == 1 for g in got) == 2


@needs_vocabulary
def test_long_texts_tokenise_whole():
    r = random.Random(2)
    text = " ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 9))) + r.choice(["", ",", ".", "!\n"]) for _ in range(60_000))
    assert "".join(stretches(text)) == text and len(stretches(text)) > 2
    assert tokens_in(tokenizer().encode_ordinary, text) == len(tokenizer().encode_ordinary(text))


def test_containers(spark):
    r = random.Random(3)
    rows = [(i, 0, 0, n, n // 2) for i in range(2000) for n in [r.randint(0, 2048)]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = fill_containers(df, shard=500).collect()
    assert sorted((g.doc_id, g.n_tokens) for g in got) == sorted((x[0], x[3]) for x in rows)
    load = {}
    for g in got:
        load.setdefault(g.container, []).append(g)
    assert all(sum(g.n_tokens for g in c) <= 2048 and len(c) <= 64 for c in load.values())
    assert sum(x[3] for x in rows) / (2048 * len(load)) > 0.97
    assert fill_containers(df.limit(0)).count() == 0


@needs_vocabulary
@pytest.mark.parametrize("text", ["x" * 210_001, "漢字" * 60_000, ("ab," * 70_000) + " tail of it", "a b  c" * 40_000, "no\n\nblank\n" * 25_000 + "end here"])
def test_texts_without_seams_tokenise_whole(text):
    assert "".join(stretches(text)) == text
    assert tokens_in(tokenizer().encode_ordinary, text) == len(tokenizer().encode_ordinary(text))


def test_loss_limit_binds_and_long_pieces_stay_whole(spark):
    rows = [(i, 0, 0, 500, 500) for i in range(400)] + [(1000 + i, 0, 0, 500, 0) for i in range(100)] + [(5000, 0, 0, 1900, 1900), (5001, 0, 0, 140, 0), (5001, 0, 0, 140, 0)]
    got = fill_containers(spark.createDataFrame(rows, SCHEMA)).collect()
    load = {}
    for g in got:
        load.setdefault(g.container, []).append(g)
    for c in load.values():
        loss = [g.loss_tokens for g in c]
        assert sum(loss) <= LOSS or sum(loss) == max(loss)
    # four pieces of 500 tokens fit by tokens, but only three by loss
    assert max(sum(g.loss_tokens == 500 for g in c) for c in load.values()) == 3
    assert {tuple(sorted(g.n_tokens for g in c)) for c in load.values() if any(g.doc_id == 5000 for g in c)} == {(140, 1900)}


def test_each_shard_has_a_task(spark):
    rows = [(i, 0, 0, 7, 3) for i in range(3000)]
    packed = fill_containers(spark.createDataFrame(rows, SCHEMA), shard=200)
    per = packed.selectExpr("spark_partition_id() as p", "container % 15 as s").distinct().groupBy("p").count().collect()
    assert len(per) == 15 and all(r["count"] == 1 for r in per)
