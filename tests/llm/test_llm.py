"""Text operators on small fixtures: brute force, round trips, and the defined cases."""

import itertools
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from aerolens.llm import ann, chat, langid, line_dedup, minhash, packing, pieces, pii, quality, sentencepiece, token_counts

WORDS = [f"w{i}" for i in range(500)]


def text(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    base = text(rng, 80)
    rows = [(i, text(rng, int(rng.integers(5, 120)))) for i in range(30)]
    rows += [(100 + i, " ".join(base.split()[:70] + [f"x{i}"] * 5)) for i in range(6)] + [(200, base), (201, base), (202, base.upper())]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "one two"), (304, "One TWO"), (305, "z " * 30_000)]
    return spark.createDataFrame([(i, t, "en", "s", i) for i, t in rows], "doc_id long, text string, lang string, source string, kept long")


def empty(docs):
    return docs.where("false")


def test_near_duplicates_against_brute_force(docs):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    have = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert have == {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}
    assert minhash.near_duplicates(empty(docs)).count() == 0


def test_quality_counts_and_defined_cases(docs, spark):
    have = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert have[300].n_words == 0 and have[300].base_failed and not have[300].kept
    assert have[305].n_words == 30_000 == have[305].n_repeat_words and have[305].base_failed
    one = spark.createDataFrame([(1, "a b c\na b c\n \nx#", None, None)], "doc_id long, text string, lang string, source string")
    r = quality.quality(one).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (7, 8, 1, 1, 6)
    assert quality.quality(empty(docs)).count() == 0


def test_line_dedup_against_brute_force(spark):
    rows = [(1, "a b c d e f\nshort line\ng h i j k l"), (2, "a b c d e f\na b X d e f\na b d e f\na b c d e f g h"), (3, None), (4, ""), (5, "short line\nm n o p q r\nm n o p q\nm n Z p q r"), (6, "Q b c d e F")]
    out = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[0][1], 2: "a b c d e f g h", 3: None, 4: "", 5: "m n o p q r", 6: "Q b c d e F"}


def test_pseudonyms_keep_format_and_links(spark):
    rows = [(1, "a@b.co 4111111111111111 4111-1111-1111-1111 10.0.0.1 2020-02-29 123-45-6789 +1 (988) 555-2485"), (2, "4111111111111111 1234567812345678 999.1.1.1 plain"), (3, None), (4, "")]
    out = {r.doc_id: (r.text, r.n) for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), count="n").collect()}
    card = out[1][0].split()[1]
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    assert luhn(card) and card != "4111111111111111" and out[1][0].split()[2].replace("-", "") == card
    assert out[2][0] == f"{card} 1234567812345678 999.1.1.1 plain" and out[2][1] == 1
    assert out[3] == (None, 0) and out[4] == ("", 0) and out[1][1] == 7
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[1][0].split(" ", 6)[6])


def test_digit_permutation_is_one_to_one(spark):
    all_ = spark.range(1000).selectExpr("lpad(id, 3, '0') as d")
    assert all_.select(pii.permute_digits(all_["d"], "k", "t")).distinct().count() == 1000


def test_packing_round_trip(docs):
    rows = packing.pack(docs, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    for r in docs.collect():
        parts = sorted((p for p in rows if p.doc_id == r.doc_id), key=lambda p: p.start)
        ids = [i for p in parts for i in p.ids]
        assert ids == [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in parts)
    for _, group in itertools.groupby(sorted(rows, key=lambda p: (p.sequence_id, p.offset)), key=lambda p: p.sequence_id):
        at = 0
        for p in group:
            assert p.offset == at
            at += p.length
        assert at <= packing.CAPACITY
    assert packing.pack(empty(docs)).count() == 0


def test_pieces_equal_the_library():
    import sentencepiece as library

    sp = library.SentencePieceProcessor(model_file=pieces.model_path())
    texts = ["", " a  b\n\n c ", "日本語 🙂 ▁x", "a" * 200, "<s> <0x41>", "Hello, world. Don't tokenise 12345!", "\t\r\n"]
    raw = sentencepiece.encode_texts(texts, pieces.model_path())
    assert [np.frombuffer(r, "u4").tolist() for r in raw] == sp.encode(texts)
    assert [n for n, _ in token_counts.count_texts(texts, pieces.model_path())] == [len(x) for x in sp.encode(texts)]
    machine = pieces.transducer(pieces.model_path())
    assert [machine.decode(x) for x in sp.encode(texts)] == [sp.decode(x) for x in sp.encode(texts)]


def test_unigram_shortest_path_against_brute_force():
    vocabulary = {"a": -1.0, "b": -2.0, "ab": -2.5, "ba": -1.5, "aba": -4.0}
    machine = pieces.PieceTransducer(pieces.Model([("<unk>", 0.0, 2), *((k, v, 1) for k, v in vocabulary.items())], pieces.UNIGRAM, False))

    def best(t):
        return 0.0 if not t else max(vocabulary[t[:k]] + best(t[k:]) for k in range(1, 4) if t[:k] in vocabulary)

    for n in range(1, 8):
        for t in map("".join, itertools.product("ab", repeat=n)):
            assert np.isclose(sum(machine.score[i] for i in machine.encode(t)), best(t))


def test_chat_round_trip(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|> \\ <|endoftext|><\\\\|im_sep|>", "", None, "\n\n é🙂 <|im_"]
    rows = [(c, t, "assistant" if t % 2 else "user", said[(c + t) % 5]) for c in range(5) for t in range(4)] + [(9, 0, None, "x"), (10, 0, "a\n<|im_sep|>", "y"), (None, 0, "user", "y")]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r.conv_id: r for r in formatted.collect()}
    assert set(out) == {0, 1, 2, 3, 4, 9, 10} and chat.read_back(out[10].formatted) == [("a\n<|im_sep|>", "y")]
    pieces = chat.token_bytes(chat.vocabulary_path())
    for c in range(5):
        turns = [(r, t or "") for i, _, r, t in rows if i == c]
        assert chat.read_back(out[c].formatted) == turns
        runs = [b"".join(pieces[i] for i, _ in g).decode() for m, g in itertools.groupby(zip(out[c].ids, out[c].loss), key=lambda x: x[1]) if m]
        assert [chat.unescape(r) for r in runs] == [t for r, t in turns if r == "assistant" and t]
        assert b"".join(pieces[i] for i in out[c].ids).decode() == out[c].formatted


def test_no_token_of_any_conversation_straddles_the_mask(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    t, seen = chat.tokenizer(chat.vocabulary_path()), 0
    for _, turns in itertools.groupby(sorted((r.conv_id, r.turn, r.role or "", r.text or "") for r in table.collect()), key=lambda x: x[0]):
        text, spans = chat.render([x[2:] for x in turns])
        offsets = np.array(t.encode(text, add_special_tokens=False).offsets).reshape(-1, 2)
        for start, end, role in spans:
            inside = (offsets[:, 1] > start) & (offsets[:, 0] < end)
            assert ((offsets[inside, 0] >= start) & (offsets[inside, 1] <= end)).all()
            seen += role == "assistant"
    assert seen > 100


def test_search_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16))
    x[100:180] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ann.search(frame, lambda c: c % 20 == 0).toPandas()
    x = np.array([[np.float32(a) for a in v] for v in x], float)
    hit = 0
    for q in range(0, 400, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(400), -s))[:20]
        hit += len(set(want) & set(out[out.query_id == q].sort_values("rank").vec_id))
    assert hit >= 0.9 * 20 * 20 and out.vec_id.max() < 400
    assert ann.search(frame.where("false"), lambda c: c % 20 == 0).count() == 0


def test_language_of_whole_texts(spark):
    rng = np.random.default_rng(3)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(60))
    rows = [(i, make("abcde" if i % 2 else "uvwxy"), "aa" if i % 2 else "uu") for i in range(200)] + [(500, None, "aa"), (501, "12 34", "aa")]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert out[500].lang_pred == out[501].lang_pred == "und" and out[500].score == 0
    assert np.mean([out[i].lang_pred == lang for i, _, lang in rows[:200] if out[i].held_out]) > 0.95
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
