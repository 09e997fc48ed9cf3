"""The samples of op3 and the pipeline are those of all runs, though few of them are worked out."""

import numpy as np
import pytest

from tablefeed.llm import minhash
from tablefeed.llm.minhash import MIX, ODD, SAMPLES, mixed, read, runs_of, sampled, sampled_together, words_of


def plainly(runs, weight):
    """The run and level of the least value of each sample, among all runs."""

    def uniform(bits, shift):
        return ((bits >> np.uint64(shift) & np.uint64(0x1FFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-21)

    picked = []
    for seed in mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * ODD):
        bits = mixed(runs ^ seed)
        more = (bits ^ (bits >> np.uint64(31))) * MIX
        r = -np.log(uniform(bits, 0) * uniform(bits, 21))
        c = -np.log(uniform(bits, 42) * uniform(more, 0))
        level = np.floor(np.log(weight).astype(np.float32) / r + uniform(more, 21))
        value = np.log(c) - r * (level - uniform(more, 21) + 1)
        at = value.argmin()
        picked.append(mixed(runs[at : at + 1] + level[at : at + 1].astype(np.int64).astype(np.uint64) * ODD)[0])
    return np.array(picked)


def drawn_texts(rng, sizes):
    runs = [np.sort(rng.choice(2**62, n, replace=False).astype(np.uint64)) for n in sizes]
    return runs, [np.exp(rng.normal(size=n) * rng.choice([0.1, 1, 4])) for n in sizes]


@pytest.mark.parametrize("limit", [minhash.LIMIT, 0.5, 1e9])
def test_samples_are_those_of_all_runs(monkeypatch, limit):
    monkeypatch.setattr(minhash, "LIMIT", limit)  # at 0.5 most samples are sought again, at 1e9 nothing is passed over
    runs, weight = drawn_texts(np.random.default_rng(3), [1, 2, 3, 900, 40, 1, 5_000, 300])
    got = sampled_together(np.concatenate(runs), np.concatenate(weight), np.array(list(map(len, runs))))
    for own, w, picked in zip(runs, weight, got):
        assert np.array_equal(picked, plainly(own, w))
        assert np.array_equal(picked, sampled(own, w))


def test_few_runs_are_worked_out(monkeypatch):
    runs, weight = drawn_texts(np.random.default_rng(4), [2_000] * 5)
    worked = []
    raced = minhash._raced
    monkeypatch.setattr(minhash, "_raced", lambda bits, log: worked.append(len(bits)) or raced(bits, log))
    sampled_together(np.concatenate(runs), np.concatenate(weight), np.array([2_000] * 5))
    assert 0 < sum(worked) < 0.05 * 10_000 * SAMPLES


@pytest.mark.parametrize("chars", [1, 40, 1 << 16])
def test_texts_read_together_are_read_as_alone(monkeypatch, chars):
    monkeypatch.setattr(minhash, "READ_CHARS", chars)
    texts = ["one two three four five six", None, "", "a", "a b", "\n", "ΟΔΟΣ", "Σ", "x\ud800y z", "a b c d e f g", "?!", "ende"]
    got = list(read(texts))
    assert len(got) == len(texts)
    for text, (words, runs) in zip(texts, got):
        alone = words_of([text or ""])[0]
        assert np.array_equal(words, alone) and np.array_equal(runs, runs_of(alone))
    assert [len(words) for words, _ in got] == [6, 0, 0, 1, 2, 0, 1, 1, 3, 7, 0, 1]
