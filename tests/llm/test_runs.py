"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import pytest
from helpers import documents, words

from footfall.llm import periodic_runs as R


def brute_runs(w):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(12, 2 * q):
                best.setdefault((s, i - s + q), q)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def brute(doc_id, text, rewrite):
    w = words(text)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if rewrite and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic(rnd):
    n, k = rnd.choice([0, 1, 11, 12, 13, 40, 90, 200]), rnd.choice([1, 2, 2, 3])
    kind = rnd.randrange(5)
    if kind == 0:
        w = [rnd.randrange(k) for _ in range(n)]
    elif kind == 1:
        w = [rnd.randrange(k) for _ in range(3)] + [rnd.randrange(k) for _ in range(rnd.randrange(1, 20))] * rnd.randrange(1, 9)
    elif kind == 2:                                       # Fibonacci and Thue-Morse words: many runs
        w, rule = [0], rnd.choice([[[0, 1], [0]], [[0, 1], [1, 0]]])
        while len(w) < n:
            w = [y for x in w for y in rule[x]]
        w = w[:n]
    elif kind == 3:
        w, x = [], [rnd.randrange(2) for _ in range(rnd.randrange(1, 6))]
        while len(w) < n:
            w += x * rnd.randrange(1, 8) + [rnd.randrange(3)] * rnd.randrange(0, 3)
    else:                                                 # every 6-gram of the period stands twice in it
        w = ([0] * 10 + [1] * 10 + [0] * 10 + [1] * 11) * rnd.randrange(1, 4)
    return rnd.choice([" ", "\n", "  \t"]).join(f"w{x}" for x in w)


@pytest.mark.parametrize("rewrite", [False, True])
def test_runs_equal_brute_force(spark, rewrite):
    rnd = random.Random(4)
    rows = [(k, periodic(rnd)) for k in range(300)]
    rows += [(k, " ".join(f"v{rnd.randrange(50)}" for _ in range(rnd.randrange(1, 300)))) for k in range(300, 420)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "ein Wort"), (None, "a b " * 30), (5, rows[5][1]), (5, rows[5][1]),
             (1004, "straße über " * 9 + "é"), (1005, "x" * 4000 + " y")]
    got = R.periodic_runs(documents(spark, rows, clash=True, parts=3), rewrite=rewrite).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((brute(d, t, rewrite) for d, t in rows), key=key)
    assert sum(r.n_runs > 3 for r in got) > 20


def test_texts_of_one_word_cost_little_and_one_long_text_is_whole(spark):
    rows = [(1, "spam " * 60000), (2, ("a " * 500 + "b ") * 60), (3, "")]
    got = {r.doc_id: r for r in R.periodic_runs(documents(spark, rows)).collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period) == (1, 0, 60000, 1)
    assert (got[2].length, got[2].period, got[2].n_runs) == (30060, 501, 61)
    assert R.periodic_runs(documents(spark, []).limit(0)).count() == 0
