"""Operators against plain versions of what they compute, on fixtures made to be hard."""

import itertools
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

from aerolens.llm import langid, line_dedup, minhash, packing


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def similarity(a, b):
    return len(a & b) / max(len(a | b), 1)


def test_near_duplicates_in_a_group_half_similar_to_its_source(spark):
    """Members at 0.5 to 0.75 to one source, a few of them copied again: every link is found."""
    rng = np.random.default_rng(4)
    source = [f"w{i}" for i in range(150)]
    texts = [" ".join(source)]
    for i in range(160):
        w = list(source)
        for at in rng.choice(150, int(rng.integers(3, 10)), replace=False):
            w[at] = f"n{rng.integers(10**9)}"
        if i % 7 == 0:
            del w[: int(rng.integers(0, 30))]
        texts.append(" ".join(w))
        if i % 8 == 0:
            w[int(rng.integers(20, 100))] = "again"
            texts.append(" ".join([*w, "and", "more"]))
    texts = [texts[i] for i in rng.permutation(len(texts))]
    sets = [shingles(t) for t in texts]
    root, odd = list(range(len(sets))), 0
    for a, b in itertools.combinations(range(len(sets)), 2):
        s = similarity(sets[a], sets[b])
        odd += 0.5 <= s < 0.75
        if s >= 0.75:
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    assert odd > 1000 and len(set(root)) > 20
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [out[i] for i in range(len(texts))] == root


def test_minima_and_maxima_estimate_the_similarity_without_bias():
    rng, errors = np.random.default_rng(6), []
    for k in range(60):
        values = minhash._mix(rng.integers(1, 1 << 63, 400, dtype=np.uint64))
        shared = int(rng.integers(100, 300))
        a, b = values[: 200 + shared // 2], values[200 - shared // 2 :]
        true = shared / 400
        errors.append((minhash.min_max(a) == minhash.min_max(b)).mean() - true)
    assert abs(np.mean(errors)) < 3 * np.std(errors) / 60**0.5 + 0.002 and np.std(errors) < 0.06


@pytest.mark.parametrize("long", [512, 6])
def test_line_dedup_of_random_lines(spark, monkeypatch, long):
    monkeypatch.setattr(line_dedup, "LONG", long)
    monkeypatch.setattr(line_dedup, "BLOCK", 3)
    rng = np.random.default_rng(long)
    made = [[f"word{x}" for x in rng.integers(0, 4, rng.integers(1, 11))] for _ in range(60)]
    for w in made[:30]:
        v = list(w)
        at = int(rng.integers(0, len(v)))
        made.append(v[:at] + ([["new"], [], ["word0", v[at]]][int(rng.integers(0, 3))]) + v[at + 1 :])
    made = [made[i] for i in rng.permutation(len(made))]
    gaps = [" ", "  ", "\t", " \x0b"]
    docs = [(i, "\n".join(gaps[(i + j) % 4].join(w) for j, w in enumerate(made[5 * i : 5 * i + 5]))) for i in range(18)]
    cut = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    able = lambda w: len(w) >= 5 or len(w) >= 3 and sum(map(len, w)) >= 20
    near = lambda a, b: a == b or able(a) and able(b) and (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or a in cut(b) or b in cut(a))
    seen, want = [], {}
    for i, t in docs:
        kept = []
        for line in t.split("\n"):
            w = tuple(line.split())
            if not (w and any(near(w, s) for s in seen)):
                kept.append(line)
            seen.append(w)
        want[i] = "\n".join(kept)
    out = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == want


def test_line_dedup_of_very_long_lines(spark):
    long = [f"w{i % 977}x{i}" for i in range(9000)]
    docs = [(1, " ".join(long)), (2, " ".join(long[:4000] + ["new"] + long[4000:])), (3, " ".join(long[:-1])), (4, " ".join(long[2:])), (5, "\n".join(["same line of words here"] * 20_000))]
    out = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {1: docs[0][1], 2: "", 3: "", 4: docs[3][1], 5: "same line of words here"}


def test_first_fit_decreasing_against_a_plain_one():
    rng = np.random.default_rng(2)
    for n in [0, 1, 2, 7, 300]:
        lengths = rng.integers(1, 101, n).tolist()
        bins, want = [], {}
        for i in sorted(range(n), key=lambda i: -lengths[i]):
            b = next((k for k, used in enumerate(bins) if used + lengths[i] <= 100), len(bins))
            if b == len(bins):
                bins.append(0)
            want[i] = (b, bins[b])
            bins[b] += lengths[i]
        assert packing.first_fit_decreasing(lengths, 100) == [want[i] for i in range(n)]


def test_ids_are_those_of_the_library(spark):
    rng = np.random.default_rng(3)
    parts = ["a", "bc", "é", "中", "don't", "12", " ", "  ", "\n", "\n\n", "\n\n\n", "\t", " ", "\x1c", "<|endoftext|>", ".", "!?", " the", "\r\n"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 14)))) for _ in range(600)] + ["long words and more " * 30_000]
    plain = Tokenizer.from_file(packing.vocabulary_path())
    rows = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()
    have = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(have.setdefault(r.doc_id, []))
        have[r.doc_id] += r.ids
    assert have == {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


def test_network_against_naive_convolution_and_numeric_gradient():
    rng = np.random.default_rng(9)
    net = langid.ByteNet(3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (4, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])
    hidden = []
    for w in langid.WIDTHS:
        e = net.p["embedding"][x]
        answers = np.stack([sum(e[:, i + j] @ net.p[f"filter{w}"][j] for j in range(w)) + net.p[f"bias{w}"] for i in range(langid.WINDOW - w + 1)], 1)
        hidden.append(np.maximum(answers, 0).max(1))
    z = np.concatenate(hidden, 1) @ net.p["out"] + net.p["out_bias"]
    want = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    assert np.allclose(net.probabilities(x), want, atol=1e-6)
    loss = lambda: -np.log(net.probabilities(x)[np.arange(4), y]).mean()
    found = net.gradients(x, y)
    for name, value in net.p.items():
        for at in zip(*(rng.integers(0, s, 6) for s in value.shape)):
            if name == "embedding":
                at = (int(x[0, at[0] % langid.WINDOW]), at[1])
            was = value[at]
            value[at] = was + 1e-5
            up = loss()
            value[at] = was - 1e-5
            down = loss()
            value[at] = was
            assert abs((up - down) / 2e-5 - found[name][at]) < 1e-4, name
