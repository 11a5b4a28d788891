"""corpus_pipeline.run() against a plain Python version of its five stages."""

import glob
import hashlib
import itertools
import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from aerolens.llm import common, line_dedup, packing, pii, quality


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def counted(t):
    """n_words, repeated words and the measures of a text."""
    t, w = t or "", words(t)
    chars, lines = sum(map(len, w)), [x for x in t.split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    repeats = len({i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)})
    number = lambda test: sum(map(test, t))
    of = {"symbols": 1000 * number(lambda c: c in "#*$%&|<>") // max(chars, 1), "marks": 1000 * number(lambda c: not c.isalnum() and not c.isspace()) // max(chars, 1)}
    of |= {"capitals": 1000 * number(str.isupper) // max(chars, 1), "dup_lines": 1000 * (len(lines) - len(set(lines))) // max(len(lines), 1)}
    return len(w), repeats, of | {"repeats": 1000 * repeats // max(len(w), 1), "word_length": 100 * chars // max(len(w), 1)}


def python_quality(rows):
    all_ = [counted(r[1]) for r in rows]
    lang = lambda r: "" if r[0] == 5 else "en"  # noqa: E731  the fixture has one source

    def sketch(values, slack):
        x = sorted(v >> max(v.bit_length() - 5, 0) << max(v.bit_length() - 5, 0) for v in values)
        q25, q50, q75 = (x[-(-len(x) * q // 100) - 1] for q in (25, 50, 75))
        return len(x), q50 + max(quality.SPREADS * min(q75 - q25, 2 * (q50 - q25)), slack), q25

    most = {}
    for m, slack in quality.MEASURES.items():
        for own in ("", "en"):
            n2, all_most, _ = sketch([v[m] for n, _, v in all_ if n], slack)
            n, own_most, _ = sketch([v[m] for r, (n, _, v) in zip(rows, all_) if n and lang(r) == own], slack)
            p = quality.PRIOR_DOCS
            most[m, own] = (n * own_most + p * ((n * own_most + p * all_most) // (n + p))) // (n + p)
    gone = {r[0] for r, (n, k, v) in zip(rows, all_) if n < 50 or 100 * k > 50 * n or any(v[m] > most[m, lang(r)] for m in quality.MEASURES)}
    return [r for r in rows if r[0] is None or r[0] not in gone]


def python_lines(rows):
    cut = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    long = lambda w: len(w) >= 5 or len(w) >= line_dedup.NEAR_WORDS and sum(map(len, w)) >= line_dedup.NEAR_CHARS
    near = lambda a, b: a == b or long(a) and long(b) and (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or a in cut(b) or b in cut(a))
    seen, out = [], {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        kept = []
        for line in r[1].split("\n"):
            w = tuple(words(line))
            if not (w and any(near(w, s) for s in seen)):
                kept.append(line)
            seen += [w] if w else []
        out[r[0]] = "\n".join(kept)
    text = lambda r: out.get(r[0], r[1])
    return [(r[0], text(r), r[2] if text(r) == r[1] else len(text(r))) for r in rows if text(r) == r[1] or words(text(r))]


def python_near(rows):
    def shingles(t):
        w = words(t.lower())
        return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    return [r for r in rows if r[0] is None or root[r[0]] == r[0]]


def python_mails(rows):
    """The fixture's only personal data are mail addresses."""

    def one(m):
        digest = hashlib.sha256(f"{pii.DEFAULT_KEY}|mail|{m[0].lower()}".encode()).hexdigest()
        return digest.translate(str.maketrans("0123456789abcdef", "abcdefghijklmnop"))[:16] + "@mail.invalid"

    new = lambda t: re.sub(r"[a-z]+@[a-z]+\.org", one, t)
    return [(i, new(t), n if new(t) == t else len(new(t))) for i, t, n in rows]


def fixture():
    rng = np.random.default_rng(11)
    vocabulary = [f"{a}{b}{c}en" for a in "bdfgk" for b in "aeiou" for c in "lmnr"]
    text = lambda n=80: "\n".join(" ".join(rng.choice(vocabulary, 10)) for _ in range(n // 10))
    rows = [(i, text()) for i in range(40)]
    rows += [(i, text() + f"\nwrite to person{'abc'[i % 3]}@mail{'xy'[i % 2]}.org today") for i in range(40, 46)]
    one = text(120).split("\n")
    rows += [(50, "\n".join(one)), (51, "\n".join(one)), (52, "\n".join(" ".join(x.split()[:9] + ["changed"]) for x in one))]  # lines go: two are empty then
    flat = " ".join(text(100).split())
    rows += [(60, flat), (61, flat + " two more"), (62, text() + "\nAll rights reserved."), (63, "All rights reserved.\n" + text() + "\nAll rights reserved")]
    rows += [(70, None), (71, ""), (72, " \n \n"), (73, "too short"), (74, "again " * 90), (75, " ".join(f"{w}#$%" for w in rng.choice(vocabulary, 70))), (None, text() + "\nnone@nowhere.org"), (-5, text() + "\n\n" + "über été\n")]
    return [(i, t, 7 if i == 3 else None if t is None else len(t)) for i, t in rows]


def test_run_against_plain_python(spark, tmp_path):
    rows = fixture()
    table = [(i, t, None if i == 5 else "en", "s", n) for i, t, n in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    was = set(glob.glob(f"{common.shared_dir(spark).removeprefix('file:')}/pipeline-*/*"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    made = {p.rsplit("/", 1)[1]: p for p in set(glob.glob(f"{common.shared_dir(spark).removeprefix('file:')}/pipeline-*/*")) - was}
    want, sizes, order = rows, [], lambda r: (r[0] is None, r[0] or 0)
    for name, stage in (("0-quality_rules", python_quality), ("1-line_dedup", python_lines), ("2-near_dedup", python_near), ("3-pii", python_mails)):
        want = sorted(stage(want), key=order)
        sizes.append(len(want))
        assert sorted((tuple(r) for r in spark.read.parquet(made[name]).select("doc_id", "text", "n_chars").collect()), key=order) == want, name
    assert len(rows) > sizes[0] > sizes[1] > sizes[2] and all(words(t) for _, t, _ in want)

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t, _ in want}
    assert {p.doc_id for p in out} == set(ids)
    for i, all_ in ids.items():
        parts = sorted((p for p in out if p.doc_id == i), key=lambda p: p.start)
        assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))] and sum(p.length for p in parts) == len(all_)
        assert all(p.doc_tokens == len(all_) and p.ids_crc32 == zlib.crc32(np.array(all_[p.start : p.start + p.length], "<u4").tobytes()) for p in parts)
    for _, group in itertools.groupby(sorted(out, key=lambda p: (p.sequence_id, p.offset)), key=lambda p: p.sequence_id):
        at = 0
        for p in group:
            assert p.offset == at
            at += p.length
        assert at <= packing.CAPACITY
