"""Quality rules, classifier and language model against brute force and held-out data."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import base, documents, words

from footfall.llm import lm, quality_classifier, quality_rules
from footfall.llm.textops import text_bytes


def prose(rnd, n, vocabulary=300):
    return " ".join(f"{rnd.choice('abcdefgh')}{rnd.choice('aeiou')}{rnd.choice('lmnrst')}" * rnd.randrange(1, 3) + rnd.choice(["", "", "", ".", ","]) for _ in range(n))


def test_base_counts_match_brute_force():
    rnd = random.Random(1)
    texts = ["".join(rnd.choices(["a", "b", " ", "\n", "é", "#", "🙂", "\t", "a b c ", "\r\n"], k=rnd.randrange(0, 60))) for _ in range(300)] + [None, "", "\n\n", "x " * 4000]
    got = quality_rules.base_counts(*text_bytes(pa.array(texts, pa.string())))
    assert list(zip(*(got[k].tolist() for k in quality_rules.COUNTS))) == [base(t) for t in texts]


def symbol(c):
    """A character as the model sees it."""
    if c in " \t\n\x0b\x0c\r":
        return " "
    if ord(c) > 0xFFFF:
        return chr(0xE000 + ord(c) % 0x1900)
    return "0" if c.isdigit() else c.lower() if len(c.lower()) == 1 else c


def grams(text):
    """The 4-gram that ends at each character of a text."""
    s = "   " + "".join(map(symbol, text or ""))
    return [tuple(s[k:k + 4]) for k in range(len(s) - 3)]


def packed(gram):
    return sum(ord(c) << 16 * (3 - k) for k, c in enumerate(gram))


def brute_kneser_ney(seen):
    """Interpolated modified Kneser-Ney by dictionaries; (context, symbol) -> probability."""
    order, levels = 4, {4: Counter(seen)}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    discounts, totals, taken = {}, {}, {}
    for n, level in levels.items():
        n1, n2, n3, n4 = (sum(v == k for v in level.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [0, 1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9]
        discounts[n] = [0] + [min(max(x, 0.05), k) for k, x in enumerate(d[1:], 1)]
        totals[n], taken[n] = Counter(), Counter()
        for g, c in level.items():
            totals[n][g[:-1]] += c
            taken[n][g[:-1]] += min(c, discounts[n][min(c, 3)])

    def p(gram):
        if not gram:
            return 1 / (1 << 16)
        n, context = len(gram), gram[:-1]
        if context not in totals[n]:
            return p(gram[1:])
        c = levels[n].get(gram, 0)
        return (c - min(c, discounts[n][min(c, 3)])) / totals[n][context] + taken[n][context] / totals[n][context] * p(gram[1:])

    return p


def test_kneser_ney_matches_brute_force(spark):
    rnd = random.Random(2)
    rows = [(k, prose(rnd, 12)) for k in range(25)] + [(50, "Ünï ΩΣς Ж🙂 9 ٣٤ 中文字 中文 x\x00"), (51, None), (52, "")]
    model = quality_rules.fit(documents(spark, rows, parts=3))
    raw, off = text_bytes(pa.array([r[1] for r in rows]))
    code, begin = quality_rules.codes(raw, off)
    seen = [g for r in rows for g in grams(r[1])]
    assert code.tolist() == [packed(g) for g in seen]
    assert np.diff(begin).tolist() == [len(r[1] or "") for r in rows]
    p = brute_kneser_ney(seen)
    probe = [*seen[::29], ("a", "b", "z", "z"), ("中", "文", "字", "x"), ("q", "q", "q", "q"), ("é", "é", "é", "é")]
    want = [math.log10(p(g)) for g in probe]
    assert np.allclose(model.log10(np.array([packed(g) for g in probe], np.uint64), "en"), want, atol=1e-4)


def test_a_model_of_many_files_holds_every_ngram(spark):
    """Rare n-grams beyond any number of them have their own probability, whatever the files' size."""
    rnd = random.Random(5)
    letters = "".join(chr(0x4E00 + k) for k in range(3000))
    rows = [(k, "".join(rnd.choice(letters) for _ in range(200))) for k in range(30)]
    model = quality_rules.fit(documents(spark, rows, parts=3), part=500)
    bits, files = model.files["en"]
    assert bits > 4 and len(files) == 1 << bits
    seen = [g for r in rows for g in grams(r[1])]
    codes = np.array([packed(g) for g in seen], np.uint64)
    assert model.find(quality_rules.slot(codes, quality_rules.ORDER), "en")[0].all()
    p = brute_kneser_ney(seen)
    assert np.allclose(model.log10(codes[::37], "en"), [math.log10(p(g)) for g in seen[::37]], atol=1e-4)


def test_kept_equals_a_brute_force_model_and_band(spark):
    rnd = random.Random(12)
    rows = [(k, prose(rnd, rnd.randrange(55, 120))) for k in range(80)] + [(100 + k, " ".join("".join(rnd.choice("zqxjvw") for _ in range(6)) for _ in range(60))) for k in range(6)]
    got = {r.doc_id: (r.kept, r.log10_ppl) for r in quality_rules.judge(documents(spark, rows, parts=3))[0].collect()}
    p = brute_kneser_ney([g for r in rows for g in grams(r[1])])
    ppl = {d: -sum(math.log10(p(g)) for g in grams(t)) / len(t) for d, t in rows}
    failed = {d: base(t)[0] < 50 or 100 * base(t)[4] > 50 * base(t)[0] for d, t in rows}
    assert all(abs(got[d][1] - ppl[d]) < 1e-4 for d in ppl)
    cells = np.array(sorted(round(v * quality_rules.STEP) for d, v in ppl.items() if not failed[d]))
    low_median = lambda x: np.sort(x)[(len(x) + 1) // 2 - 1]
    middle = low_median(cells)
    reach = quality_rules.WIDTH * low_median(np.abs(cells - middle)) / quality_rules.STEP + quality_rules.SLACK
    clear = 0
    for d, t in rows:
        edge = abs(abs(ppl[d] - middle / quality_rules.STEP) - reach - quality_rules.SHORT / math.sqrt(len(t)))
        if edge > 0.003:                                   # the histogram's cells are 0.001 wide
            clear += 1
            assert got[d][0] == (not failed[d] and abs(ppl[d] - middle / quality_rules.STEP) <= reach + quality_rules.SHORT / math.sqrt(len(t))), d
    assert clear > 70 and sum(k for k, _ in got.values()) >= 75


SCRIPTS = {"ru": ("абвгдежзиклмнопрстуфхцчшыья", 6), "el": ("αβγδεζηθικλμνξοπρστυφχψω", 6), "zh": ("".join(chr(0x4E00 + 7 * k) for k in range(400)), 2), "en": ("abcdefghijklmnopqrstuvwxyz", 6)}


def test_shuffled_letters_are_rejected_in_every_script(spark):
    """Words of a language in any order are prose; the same letters in any order are not."""
    rnd = random.Random(21)
    rows, junk = [], set()
    for n, (lang, (letters, size)) in enumerate(SCRIPTS.items()):
        vocabulary = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(2, size + 1))) for _ in range(400)]
        for k in range(160):
            text = " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(80, 200)))
            doc_id = 1000 * n + k
            if k >= 150:
                chars = [c for c in text if c != " "]
                rnd.shuffle(chars)
                chars = iter(chars)
                text = "".join(c if c == " " else next(chars) for c in text)
                junk.add(doc_id)
            rows.append((doc_id, text, lang))
    kept = {r.doc_id for r in quality_rules.keep(documents(spark, rows, parts=3)).collect()}
    assert not kept & junk
    assert kept == {r[0] for r in rows} - junk


def test_a_model_beyond_its_capacity_keeps_the_most_frequent_ngrams(spark):
    counts = spark.createDataFrame([("a", k, 1 + (k < 10) + (k < 4)) for k in range(100)] + [("b", 7, 1), ("", 8, 5)], "lang string, code long, n long")
    cut = quality_rules.frequent(counts, 20).collect()
    assert sorted(r.code for r in cut if r.lang == "a") == list(range(10)) and len(cut) == 12
    assert quality_rules.frequent(counts, 1000).count() == 102
    assert sorted(r.code for r in quality_rules.frequent(counts, 4).collect() if r.lang == "a") == [0, 1, 2, 3]


def test_quality_rules(spark):
    rnd = random.Random(3)
    good = [(k, prose(rnd, rnd.randrange(60, 200)), "en") for k in range(200)]
    junk = [(1000 + k, " ".join("".join(rnd.choice("#%&*zqxj0189") for _ in range(7)) for _ in range(80)), "en") for k in range(8)]
    other = [(2000 + k, prose(rnd, 100).upper(), "rare") for k in range(2)]
    edge = [(3000, None, "en"), (3001, "", None), (3002, "a b c", "en"), (3003, "den haag " * 100, "en"), (3004, good[0][1], None), (3004, good[0][1], None)]
    docs = documents(spark, good + junk + other + edge, clash=True, parts=3)
    result, _, _ = quality_rules.judge(docs)
    rows = result.collect()
    assert len(rows) == docs.count()
    text = {r[0]: r[1] for r in good + junk + other + edge}
    for r in rows:
        want = base(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in rows if r.kept}
    assert {r[0] for r in good} <= kept and not kept & ({r[0] for r in junk} | {3000, 3001, 3002, 3003})
    out = quality_rules.keep(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert {r.doc_id for r in out.collect()} == kept
    assert quality_rules.judge(docs.limit(0))[0].count() == 0 and quality_rules.keep(docs.limit(0)).count() == 0


def test_small_languages_are_judged_by_their_own_band(spark):
    """A language's verdicts do not depend on how much of another language there is, or on null languages."""
    rnd = random.Random(13)
    small = [(k, " ".join("".join(rnd.choices("zqxjvw0189", k=5)) for _ in range(70)), "sm") for k in range(9)]
    small += [(9, " ".join("".join(rnd.choices("aeiounst", k=5)) for _ in range(70)), "sm")]
    alone = {r.doc_id: (r.kept, r.log10_ppl) for r in quality_rules.judge(documents(spark, small))[0].collect()}
    assert [alone[k][0] for k in range(9)] == [True] * 9
    for lang in ("en", None):
        docs = documents(spark, small + [(100 + k, prose(rnd, 400), lang) for k in range(420)], parts=3)
        got = {r.doc_id: (r.kept, r.log10_ppl) for r in quality_rules.judge(docs)[0].where("doc_id < 100").collect()}
        assert got == alone
        assert {r.doc_id for r in quality_rules.keep(docs).where("doc_id < 100").collect()} == {k for k, (kept, _) in alone.items() if kept}


def held(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % k == 1


def test_quality_classifier(spark):
    rnd = random.Random(4)
    rows = [(k, prose(rnd, 80) if k % 2 else "\n".join([prose(rnd, 4)] * 20) + "### $$$") for k in range(500)]
    edge = [(1000, None), (1001, ""), (1002, "long " * 40_000), (3, rows[3][1])]
    labels = [(k, k % 2, 0) for k in range(400)] + [(1000, None, 0), (5000, 1, 0), (7, 1, 0), (None, 1, 0)]
    docs, table = documents(spark, rows + edge, clash=True, parts=3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(docs, table, trees=20).collect()
    assert len(out) == len(rows) + len(edge)
    right = [r.predicted == r.doc_id % 2 for r in out if r.doc_id < 500 and held(r.doc_id, 3)]
    assert sum(right) >= 0.97 * len(right)
    assert all(r.held_out == held(r.doc_id, 3) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert len({r.score for r in out if r.doc_id == 3}) == 1
    # held-out labels are never learnt from
    flipped = spark.createDataFrame([(d, 1 - q if d is not None and q is not None and held(d, 3) else q, t) for d, q, t in labels], table.schema)
    again = {r.doc_id: r.score for r in quality_classifier.classify(docs, flipped, trees=20).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in out)
    assert {r.score for r in quality_classifier.classify(docs, table.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(docs.limit(0), table).count() == 0


def test_trees_split_and_flatten():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    trees = quality_classifier.fit_trees(x[:2000], y[:2000], trees=40, depth=4)
    assert ((trees.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.96
    row = x[2500]
    margin = trees.base
    for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):  # one row, node by node
        node = 0
        while node < len(f):
            node = 2 * node + 1 + int(row[f[node]] > t[node])
        margin += leaf[node - len(f)]
    assert abs(margin - trees.margin(x[2500:2501])[0]) < 1e-9


def clustered_text(rnd, n):
    """Nouns follow verbs: class structure that a unigram model cannot see."""
    return " ".join(rnd.choice([f"noun{rnd.randrange(40)}" if k % 2 else f"verb{rnd.randrange(40)}"]) for k in range(n))


def test_language_model_counts_and_held_out_gain(spark):
    rnd = random.Random(6)
    rows = [(k, clustered_text(rnd, rnd.randrange(20, 120))) for k in range(300)] + [(1000, None), (1001, ""), (1002, "Never Seen WORDS"), (1002, "Never Seen WORDS"), (1003, "noun1 " * 5000)]
    docs = documents(spark, rows, clash=True, parts=3)
    for options in ({}, {"slice_bytes": 4000, "part_words": 50}):
        out = lm.lm_score(docs, **options).collect()
        assert len(out) == len(rows)
        count = Counter()
        for doc_id, text in rows:
            if not held(doc_id, 5):
                count.update([*words(text, True), None])
        total, vocabulary = sum(count.values()), len(count)
        text = dict(rows)
        for r in out:
            w = [*words(text[r.doc_id], True), None]
            want = sum(math.log10((count[x] + 0.5) / (total + 0.5 * (vocabulary + 1))) for x in w)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id, 5), len(w), sum(count[x] > 0 for x in w), total)
            assert abs(r.base_score - want) < 1e-6 * abs(want) and r.score < 0
        test = [r for r in out if r.held_out and r.doc_id < 300]
        assert sum(r.score for r in test) > sum(r.base_score for r in test) + 0.2 * sum(r.n_tokens for r in test)
    assert lm.lm_score(docs.limit(0)).count() == 0


def test_exchange_gain_is_the_likelihood_change():
    rng = np.random.default_rng(7)
    n_heads = 12
    units = n_heads + lm.SPELL + 1
    pairs = np.zeros((units, units))
    for _ in range(600):
        pairs[rng.integers(0, n_heads + 3), rng.integers(0, n_heads + 3)] += 1
    classes = np.concatenate([np.arange(n_heads) % 4, lm.CLASSES + np.arange(lm.SPELL), [lm.END]])

    def matrix(classes):
        m = np.zeros((lm.ALL, lm.ALL))
        np.add.at(m, (classes[:, None].repeat(units, 1), classes[None, :].repeat(units, 0)), pairs)
        return m

    def likelihood(m):
        return lm.plogp(m).sum() - lm.plogp(m.sum(axis=0)).sum() - lm.plogp(m.sum(axis=1)).sum()

    for w in range(n_heads):
        left, right = np.zeros(lm.ALL), np.zeros(lm.ALL)
        np.add.at(left, classes, pairs[:, w])
        np.add.at(right, classes, pairs[w])
        to, gain = lm.best_class(matrix(classes), int(classes[w]), left, right, pairs[w, w])
        moved = classes.copy()
        moved[w] = to
        assert abs(likelihood(matrix(moved)) - likelihood(matrix(classes)) - gain) < 1e-6


def fitted(spark, docs, **options):
    """(model, {word hash: class}, {word hash: training count}) as lm_score fits them."""
    slices = lm.by_slice(lm.encode(docs, options.get("slice_bytes", lm.SLICE_BYTES)), lm.work_dir(spark, "slices"))
    n_words, n_docs, distinct = slices.selectExpr("sum(train_tokens)", "sum(train_docs)", "sum(n_distinct)").first()
    parts = 1 << max(0, distinct // options.get("part_words", lm.PART_WORDS)).bit_length()
    answers = lm.saved(lm.exchange_counts(slices, n_words + n_docs, parts, options.get("share", lm.CLUSTER_SHARE)), lm.work_dir(spark, "counts"))
    model, rare = lm.fit(slices, answers, n_words + n_docs, n_docs, parts, lm.ROUNDS, lm.RARE_ROUNDS)
    cls, count, spell = {}, {}, {}
    rows = lm.with_answers(lm.with_answers(slices, answers, "counts").withColumnRenamed("answers", "numbers"), rare, "classes").collect()
    for r in rows:
        h = lm.unpack(r.hashes, np.uint64)
        own = lm.rare_classes(r.answers, len(h))
        n = np.concatenate([lm.unpack(x["counts"], "<i8") for x in r.numbers])
        word_class, _ = model.words(h, np.frombuffer(r.spell, np.uint8), n, own)
        cls.update(zip(h.tolist(), word_class.tolist()))
        count.update(zip(h.tolist(), n.tolist()))
        spell.update(zip(h.tolist(), np.frombuffer(r.spell, np.uint8).tolist()))
    return model, cls, count, spell


def test_whole_vocabulary_is_clustered_and_scores_equal_a_brute_force_class_bigram(spark):
    rnd = random.Random(16)
    rows = [(k, clustered_text(rnd, rnd.randrange(20, 90)) + f" rare{k} noun{rnd.randrange(40)}") for k in range(250)] + [(900, None), (901, "entirely new words"), (902, "verb1 entirely")]
    docs = documents(spark, rows, parts=3)
    options = {"share": 0.012, "slice_bytes": 6000, "part_words": 60}     # most words are rare ones
    model, cls, count, spell = fitted(spark, docs, **options)
    raw, off = text_bytes(pa.array([r[1] for r in rows]))
    hash_of = lambda w: int(lm.hash_spans(*map(np.array, (np.frombuffer(w.encode(), np.uint8), [0], [len(w.encode())])))[0])
    train = Counter(x for d, t in rows if not held(d, 5) for x in words(t, True))
    assert 0 < len(model.head) < len(train) / 2
    assert all(count[hash_of(w)] == n for w, n in train.items()) and all(0 <= c < lm.CLASSES for c in cls.values())
    # verbs and nouns do not share classes
    kinds = {}
    for w, n in train.items():
        if n >= 5:
            kinds.setdefault(cls[hash_of(w)], set()).add(w[:4])
    assert sum(len(k) == 1 for k in kinds.values()) >= 0.9 * len(kinds) and len(kinds) > 5
    # emissions: the words of a class and one half count for unseen ones sum to one
    tokens, distinct = Counter(), Counter()
    for w, n in train.items():
        tokens[cls[hash_of(w)]] += n
        distinct[cls[hash_of(w)]] += 1
    total = {c: tokens[c] + 0.5 * (distinct[c] + 1) for c in range(lm.CLASSES)}
    sums = Counter()
    for w, n in train.items():
        sums[cls[hash_of(w)]] += (n + 0.5) / total[cls[hash_of(w)]]
    for c in sums:
        assert abs(sums[c] + 0.5 / total[c] - 1) < 1e-9 and model.total[c] == total[c]
    # transitions, counted again over the texts
    matrix = np.zeros((lm.ALL, lm.ALL))
    for d, t in rows:
        if not held(d, 5):
            seq = [lm.END, *(cls[hash_of(w)] for w in words(t, True)), lm.END]
            for a, b in zip(seq, seq[1:]):
                matrix[a, b] += 1
    unigram = (matrix.sum(axis=0) + 0.5) / (matrix.sum() + 0.5 * lm.ALL)
    p = (matrix + lm.PRIOR * unigram) / (matrix.sum(axis=1, keepdims=True) + lm.PRIOR)
    assert np.allclose(p.sum(axis=1), 1)
    got = {r.doc_id: r.score for r in lm.lm_score(docs, **options).collect()}
    for d, t in rows:
        at, want = lm.END, 0.0
        for w in words(t, True):
            c = cls[hash_of(w)]
            want += math.log10(p[at, c] * (train[w] + 0.5) / total[c])
            at = c
        want += math.log10(p[at, lm.END])
        assert abs(got[d] - want) < 1e-6 * max(1, abs(want)), d


def test_first_order_scores_are_the_likelihood_change_of_a_rare_word():
    """Against the exact change by ``best_class``, for a word that is small beside its classes."""
    rng = np.random.default_rng(3)
    matrix = rng.integers(200, 5000, (lm.ALL, lm.ALL)).astype(float)
    left, right = np.zeros(lm.ALL), np.zeros(lm.ALL)
    np.add.at(left, rng.integers(0, lm.ALL, 2), 1)
    np.add.at(right, rng.integers(0, lm.ALL, 2), 1)
    by_left, by_right = lm.class_scores(matrix)
    score = left @ by_left + right @ by_right
    a = 7
    matrix[a] += right
    matrix[:, a] += left
    exact, gain = lm.best_class(matrix, a, left, right, 0.0)
    assert score.argmax() == exact and abs(score[exact] - score[a] - gain) < 0.02
