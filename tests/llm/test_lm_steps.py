"""op1's packed lookups and block steps against plain loops over bits."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearpath.llm import lm_scoring
from wearpath.llm.batches import hashes, mixed


def some_texts():
    rng = random.Random(5)
    words = ["the", "of", "a", "über", "x" * 45, "naïve", "pair", "1", "end."]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))).encode() for _ in range(40)]
    return texts + [b"", b"a", b" ", b"\x00\x00 a", b"\t\n", b"q" * 33, b"q" * 32 + b" " + b"r" * 31, b"no gap" + b"z" * 300, b""]


def counted(texts):
    zeros = np.zeros(len(lm_scoring.ORDERS) * lm_scoring.SLOTS, dtype=np.int32)
    ones = zeros.copy()
    data, owner = lm_scoring.laid_out(texts)
    for _, _, bit, slots in lm_scoring.bits(data, lm_scoring.contexts(data, owner)):
        for s in slots:
            np.add.at(ones, s[bit == 1], 1)
            np.add.at(zeros, s[bit == 0], 1)
    return zeros, ones


def test_contexts_against_their_bytes():
    """Each hash from the bytes it stands for, one place at a time."""
    texts = some_texts()
    data, owner = lm_scoring.laid_out(texts)
    found, at = lm_scoring.contexts(data, owner), 0
    for text in texts:
        word = pair = 0
        for i in range(len(text) + 1):
            if i and text[i - 1] in b" \t\n\x0b\x0c\r":
                word, pair = i, word
            h, wanted = 0, []
            for back in range(1, max(lm_scoring.BYTES) + 1):
                h = (h * 0x2545F4914F6CDD1D + (text[i - back] if back <= i else 0) + 1) % 2**64
                if back in lm_scoring.BYTES:
                    wanted.append(mixed(np.array([(h + back) % 2**64], dtype=np.uint64))[0])
            for k, begin in enumerate((word, pair)):
                span = np.frombuffer(text[max(begin, i - lm_scoring.REACH):i], dtype=np.uint8)
                wanted.append(mixed(hashes(span, np.array([0]), np.array([len(span)])) + np.uint64(1000 + k))[0])
            assert [int(c[at]) for c in found] == [int(w) for w in wanted], (text, i)
            at += 1


def test_a_nibble_is_one_lookup(monkeypatch):
    """A byte takes two words from each predictor's table, not a value per bit; they hold the predictions of its bits."""
    texts = some_texts()
    model, frozen = lm_scoring.Speller(*counted(texts)), lm_scoring.Speller(*counted(texts)).freeze()
    learner = model.learner()
    data, owner = lm_scoring.laid_out(texts)
    ctx = lm_scoring.contexts(data, owner)
    plain = {place: (bit, slots) for place, _, bit, slots in lm_scoring.bits(data, ctx)}
    for half, _, slots in lm_scoring.values(data, ctx):
        for k, row in enumerate(slots):
            for own in (learner, frozen):
                four = own.ways()[k * lm_scoring.SLOTS + row].view(np.int8).reshape(-1, 4)
                for p in range(4):
                    bit, spots = plain[4 * half + p]
                    assert (four[:, p] == (own.without[2 * spots[k] + bit] if own is learner else own.stretched[spots[k]])).all()
    looked, take = [], np.take
    monkeypatch.setattr(lm_scoring.np, "take", lambda a, i, *more, **named: (looked.append(np.size(i)) if a.dtype == np.uint32 else None, take(a, i, *more, **named))[1])
    frozen.log10(texts)
    learner.learn(texts)
    assert 0 < sum(looked) < 2.5 * 2 * len(lm_scoring.ORDERS) * len(data)


def test_steps_against_single_bits():
    """Weights, hits and bits met of online steps, one bit at a time in plain Python."""
    texts = some_texts()
    learner = lm_scoring.Speller(*counted(texts)).learner()
    weights, squares, summed = learner.weights.copy(), learner.squares.copy(), np.zeros_like(learner.weights)
    hits, ones, total = np.zeros(learner.refined.size), np.zeros(learner.refined.size), np.zeros(len(weights))
    met = learner.learn(texts)
    data, owner = lm_scoring.laid_out(texts)
    ctx, gates = lm_scoring.contexts(data, owner), len(lm_scoring.ORDERS) + 1
    at, size = 0, lm_scoring.FIRST_STEP
    while at < len(data):
        piece = slice(at, at + size)
        for place, node, bit, slots in lm_scoring.bits(data[piece], [c[piece] for c in ctx]):
            number, slope = np.zeros(gates), np.zeros((gates, gates - 1))
            for i in range(len(bit)):
                x = np.array([int(learner.without[2 * s[i] + bit[i]]) for s in slots])
                known = int((x != 0).sum())
                dot = lm_scoring.SCALE * float(weights[place * gates + known] @ x)
                spot = (min(max(dot, -7.999), 7.999) + 8) * 2
                cell = node[i] * learner.BUCKETS + int(spot) + (spot - int(spot) > 0.5)
                hits[cell] += 1
                ones[cell] += bit[i]
                number[known] += 1
                slope[known] += (bit[i] - 1 / (1 + math.exp(-dot))) * lm_scoring.SCALE * x
            slope /= np.maximum(number, 1)[:, None]
            mine = slice(place * gates, (place + 1) * gates)
            squares[mine] += slope * slope
            weights[mine] += lm_scoring.RATE * slope / np.sqrt(squares[mine])
            summed[mine] += weights[mine] * number[:, None]
            total[mine] += number
        at, size = at + size, min(size + size // 8, lm_scoring.STEP)
    assert (met == total).all() and met.sum() == 8 * len(data)
    assert learner.weights == pytest.approx(weights, abs=1e-4) and learner.summed == pytest.approx(summed, rel=1e-4, abs=1e-3)
    assert learner.hits.sum() == hits.sum() and np.abs(learner.hits - hits).sum() <= 1e-3 * hits.sum() and np.abs(learner.hit_ones - ones).sum() <= 1e-3 * hits.sum()


def test_each_learner_has_a_task_of_its_own(spark, monkeypatch):
    """With several learners no two share a partition, so that no task learns twice while others have nothing."""
    texts = [f"text number {i} with words {i % 7} and {i % 11}".encode() for i in range(400)]
    learners, written = 16, []
    materialise = lm_scoring.materialise
    monkeypatch.setattr(lm_scoring, "materialise", lambda df, *more: (back := materialise(df, *more), written.append(back))[0])
    fitted = lm_scoring.fit(lm_scoring.Speller(*counted(texts)), spark.createDataFrame([(t,) for t in texts], "word binary").repartition(3), learners)
    by_file = written[0].select("learner", F.input_file_name().alias("file")).distinct().collect()
    assert len(by_file) == len({r.learner for r in by_file}) == len({r.file for r in by_file}) == learners
    assert np.isfinite(fitted.weights).all()
