"""Pseudonyms against a plain Python version of the keyed permutations."""

import datetime
import hashlib

import numpy as np

from aerolens.llm import pii


def number(kind, i, half):
    return int(hashlib.sha256(f"{pii.DEFAULT_KEY}|{kind}|{i}|{half}".encode()).hexdigest()[:15], 16)


def feistel(l, r, l_size, r_size, kind):
    for i in range(pii.ROUNDS):
        if i % 2:
            r = (r + number(kind, i, l)) % r_size
        else:
            l = (l + number(kind, i, r)) % l_size
    return l, r


def digits(d, kind):
    a = len(d) // 2
    l, r = feistel(int(d[:a]), int(d[a:]), 10**a, 10 ** (len(d) - a), f"{kind}{len(d)}")
    return f"{l:0{a}d}{r:0{len(d) - a}d}"


def card(d):
    body = digits(d[:-1], "card")
    total = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(body)))
    return body + str(-total % 10)


def ip(text):
    o = [int(x) for x in text.split(".")]
    l, r = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
    return f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"


def date(text):
    first = datetime.date(1800, 1, 1)
    l, r = feistel(*divmod((datetime.date.fromisoformat(text) - first).days, 773), 189, 773, "date")
    return (first + datetime.timedelta(l * 773 + r)).isoformat()


def valid_card(rng):
    d = "4" + "".join(map(str, rng.integers(0, 10, 14)))
    total = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(d)))
    return d + str(-total % 10)


def test_against_plain_python(spark):
    rng = np.random.default_rng(10)
    made = []
    for _ in range(40):
        c, o = valid_card(rng), ".".join(map(str, rng.integers(0, 256, 4)))
        made += [(c, card(c)), (o, ip(o))]
        t = (datetime.date(1800, 1, 1) + datetime.timedelta(int(rng.integers(0, 146097)))).isoformat()
        made.append((t, date(t)))
        s = "".join(map(str, rng.integers(0, 10, 9)))
        p = digits(s, "ssn")
        made.append((f"{s[:3]}-{s[3:5]}-{s[5:]}", f"{p[:3]}-{p[3:5]}-{p[5:]}"))
        n = "".join(map(str, rng.integers(2, 10, 10)))
        q = digits(n, "phone")
        made.append((f"+1 ({n[:3]}) {n[3:6]}-{n[6:]}", f"+1 ({q[:3]}) {q[3:6]}-{q[6:]}"))
    docs = spark.createDataFrame([(i, f"on {a}, and") for i, (a, _) in enumerate(made)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.pseudonymise(docs).collect()}
    assert [out[i] for i in range(len(made))] == [f"on {b}, and" for _, b in made]
