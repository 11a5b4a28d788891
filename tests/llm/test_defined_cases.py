"""Every text query over empty tables, and over null, empty and repeated rows with columns of clashing names."""

import pytest

from aerolens.llm import queries

EXTRA = ", n long, words string, kept boolean, key string, at int, first long"
TABLES = {
    "documents": ("doc_id long, text string, lang string, source string, n_chars long", [(None, "no id at all here", None, None, None), (1, None, "en", None, None), (2, "", None, "a", 0), (3, "one two three", "en", "a", 13), (3, "one two three", "en", "a", 13), (4, "\n \n", "de", "b", 3), (5, "a b \U0001f600 " * 3000, "de", "b", 15000)]),
    "embeddings": ("vec_id long, embedding array<float>", [(None, [1.0, 0.0]), (0, None), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [0.5, 0.5]), (5, [0.5, 0.5])]),
    "conversations": ("conv_id long, turn int, role string, text string", [(None, 0, "user", "x"), (1, None, None, None), (1, 0, "assistant", "a"), (1, 0, "assistant", "a")]),
}


@pytest.fixture(scope="module", params=["empty", "odd"])
def folder(spark, tmp_path_factory, request):
    where = tmp_path_factory.mktemp(request.param)
    for name, (schema, rows) in TABLES.items():
        rows = [] if request.param == "empty" else [(*r, 7, "w", None, "k", 1, 2) for r in rows]
        spark.createDataFrame(rows, schema + EXTRA).coalesce(1).write.parquet(str(where / f"{name}.parquet"))
    return request.param, str(where)


def values(rows, key, *names):
    """What the rows of each key hold, sorted."""
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(tuple(r[n] for n in names) if len(names) > 1 else r[names[0]])
    return {k: sorted(v, key=repr) for k, v in out.items()}


LONG = 2 * 3000
WANT = {
    "op1_quality": lambda r: values(r, "doc_id", "n_words", "base_failed") == {None: [(5, True)], 1: [(0, True)], 2: [(0, True)], 3: [(3, True)] * 2, 4: [(0, True)], 5: [(LONG, True)]},
    "op2_minhash": lambda r: values(r, "doc_id", "n_shingles", "component_id", "kept") == {None: [(1, None, True)], 1: [(0, 1, True)], 2: [(0, 2, True)], 3: [(1, 3, True)], 4: [(0, 4, True)], 5: [(2, 5, True)]},
    "op3_ann": lambda r: values(r, "query_id", "rank", "vec_id") == {20: [(1, 1), (2, 5)]},
    "op4_sentencepiece": lambda r: (v := values(r, "doc_id", "n_ids", "round_trip")) and v[1] == [(None, None)] and v[2] == [(0, True)] and len(set(v[3])) == 1 and len(v[3]) == 2 and v[5][0][0] > LONG and all(x[1] for k in (None, 2, 3, 4, 5) for x in v[k]),
    "op5_chat": lambda r: values(r, "conv_id", "n_turns", "loss_chars") == {-1: [(2, 34)], 1: [(3, 2)]},
    "op6_packing": lambda r: (v := values(r, "doc_id", "start", "length", "doc_tokens")) and v[1] == v[2] == [(0, 1, 1)] and len(v[3]) == 2 and len(set(v[3])) == 1 and sum(x[1] for x in v[5]) == v[5][0][2] > LONG and len(v[None]) == 1 and len({(x["sequence_id"], x["offset"]) for x in r}) == len(r),
    "op7_token_counts": lambda r: (v := values(r, "doc_id", "n_tokens", "n_chars_counted")) and v[1] == v[2] == [(0, 0)] and len(v[3]) == 2 and len(set(v[3])) == 1 and v[5][0][1] == 6 * 3000 and v[5][0][0] > LONG,
    "op8_langid": lambda r: (v := values(r, "doc_id", "lang_pred", "score")) and v[1] == v[2] == v[4] == [("und", 0.0)] and len(v[3]) == 2 and len(set(v[3])) == 1 and all(0 <= x["score"] <= 1 for x in r),
    "op9_line_dedup": lambda r: values(r, "doc_id", "n_lines", "text", "n_dropped") == {None: [(1, "no id at all here", 0)], 1: [(0, None, 0)], 2: [(1, "", 0)], 3: [(1, "one two three", 0)] * 2, 4: [(3, "\n \n", 0)], 5: [(1, "a\u00a0b \U0001f600 " * 3000, 0)]},
    "op10_pii": lambda r: values(r, "doc_id", "text", "n_found") == {None: [("no id at all here", 0)], 1: [(None, 0)], 2: [("", 0)], 3: [("one two three", 0)] * 2, 4: [("\n \n", 0)], 5: [("a\u00a0b \U0001f600 " * 3000, 0)]},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_defined_cases(spark, folder, name):
    kind, where = folder
    rows = queries.QUERIES[name](spark, where).collect()
    if kind == "empty":
        assert len(rows) == (1 if name == "op5_chat" else 0)
    else:
        assert WANT[name](rows), rows
