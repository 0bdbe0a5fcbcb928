"""Jaccard join, suffix dedup and components against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, edit_inside, jaccard_components, passages_removed

from footfall.llm import decontaminate, graph, jaccard_join, suffix_dedup
from footfall.llm.textops import text_slices


def near_copies(seed, groups=6, plain=25, vocabulary=400):
    """Groups of copies at all distances, exact copies, shared passages, short and empty texts."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(vocabulary)}"
    texts = []
    line = " ".join(word() for _ in range(30))
    for _ in range(groups):
        base = [word() for _ in range(rnd.choice([4, 12, 60, 200]))]
        for _ in range(rnd.randrange(2, 9)):
            own = list(base)
            for _ in range(rnd.randrange(0, max(1, len(own) // 12) + 1)):
                k = rnd.randrange(len(own))
                own[k:k + 1] = rnd.choice([[word()], [], [own[k], word()]])
            texts.append(" ".join(own).upper() if rnd.random() < 0.2 else " ".join(own))
    texts += [" ".join(word() for _ in range(rnd.randrange(1, 150))) for _ in range(plain)]
    texts += [line + " " + " ".join(word() for _ in range(rnd.randrange(1, 60))) for _ in range(20)]
    texts += ["", None, "a", "A", "a b", " \t\n", "one two three four", "one two three four five", line, line]
    rnd.shuffle(texts)
    return list(zip(rnd.sample(range(10 * len(texts)), len(texts)), texts))


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"slice_bytes": 3000, "part_keys": 500}),
                                          (3, {"slice_bytes": 3000, "part_keys": 500, "region_docs": 2}), (4, {"region_docs": 1, "region_shingles": 300})])
def test_jaccard_join_matches_brute_force(spark, seed, options):
    rows = near_copies(seed)
    got = jaccard_join.join(documents(spark, rows, parts=3), **options).collect()
    assert sorted(tuple(r) for r in got) == sorted(jaccard_components(rows))


def test_jaccard_join_large_region_of_near_copies(spark):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
    rows = []
    for k in range(120):
        own = list(base)
        for _ in range(rnd.randrange(0, 9)):
            own[rnd.randrange(150)] = f"x{rnd.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    got = jaccard_join.join(documents(spark, rows), region_docs=10, region_shingles=2000).collect()
    assert sorted(tuple(r) for r in got) == sorted(jaccard_components(rows))


def test_jaccard_keep_leaves_one_of_each_group_and_all_columns(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "q r s"), (7, None), (8, ""), (None, "z z z z z z z"), (None, "a b c d e f")]
    docs = documents(spark, rows, clash=True)
    kept = jaccard_join.keep(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect() if r.text) == [(False, 3, "a b c d e f"), (False, 9, "q r s"), (True, 0, "z z z z z z z")]
    assert kept.where("text IS NULL OR text = ''").count() == 2
    assert jaccard_join.keep(docs.limit(0)).count() == 0
    assert jaccard_join.join(docs.limit(0)).count() == 0


def test_jaccard_keep_goes_by_components_not_by_ids(spark):
    """Different texts of one id are different components; copies whose ids are all null are one."""
    a, b, c, d = ("a b c d e f g", "h i j k l m n", "o p q r s t u", "v w x y z a b")
    rows = [(3, a), (3, b), (8, b), (3, c), (None, d), (None, d), (None, d.upper()), (None, a)]
    kept = jaccard_join.keep(documents(spark, rows, parts=3)).collect()
    assert sorted((r.doc_id or 0, r.text.lower()) for r in kept) == [(0, d), (3, a), (3, b), (3, c)]


def passage_rows(seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abcdefgh é\n") for _ in range(n))
    shared = [text(rnd.randrange(90, 400)) for _ in range(5)]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rnd.randrange(0, 5)):
            parts.append(rnd.choice([text(rnd.randrange(0, 80)), rnd.choice(shared), rnd.choice(shared)[10:-5], "ab" * rnd.randrange(0, 120), "z" * rnd.randrange(0, 250)]))
        rows.append((rnd.randrange(10**6) * 100 + k, "".join(parts)))
    return rows + [(-1, None), (-2, ""), (-3, shared[0] * 30)]


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"slice_bytes": 1500, "part_keys": 40}), (3, {"slice_bytes": 400, "part_keys": 7})])
def test_suffix_dedup_matches_brute_force(spark, seed, options, monkeypatch):
    rows = passage_rows(seed)
    got = suffix_dedup.dedup(documents(spark, rows, parts=3), digests=True, **options).collect()
    assert sorted(tuple(r) for r in got) == sorted(passages_removed(rows))


def test_sampled_suffixes_do_not_depend_on_blocks(monkeypatch):
    """Every window points to one suffix, and cutting a long text into blocks keeps all windows."""
    rows = [r[1] for r in passage_rows(5)]
    for block in (1 << 20, 256):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        for _, _, raw, off in text_slices(pa.array(rows, pa.string())):
            first, last, *_ = suffix_dedup.sampled(raw, off)
            windows = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
            want = np.concatenate([np.arange(a, b - 99) for a, b in zip(off, off[1:]) if b - a >= 100])
            assert np.array_equal(np.sort(windows), want)


def test_multikey_order_sorts_like_lexsort():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 4, 500).astype(np.uint64) for _ in range(3)] + [rng.integers(0, 50, 500)]
    order = suffix_dedup.multikey_order(columns)
    got = list(zip(*(c[order].tolist() for c in columns)))
    assert got == sorted(got)


def test_suffix_dedup_keeps_columns_and_unchanged_texts(spark):
    p = "the quick brown fox jumps over the lazy dog and runs away " * 3
    docs = documents(spark, [(1, p + "one"), (2, p + "two"), (3, None), (4, "short"), (4, "short")], clash=True)
    out = suffix_dedup.dedup(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    got = sorted((r.doc_id, r.text or "", r.n_chars) for r in out.collect())
    assert [(a, b) for a, b, _ in got if a >= 3] == [(3, ""), (4, "short"), (4, "short")]
    assert len(got[1][1]) < 70 and got[1][2] == len(got[1][1])
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1] or find(x) != x or x in got}


def test_pattern_matches_dynamic_programming():
    rnd = random.Random(4)
    for _ in range(200):
        item = "".join(rnd.choice("abcé ") for _ in range(rnd.randrange(1, 80)))
        text = "".join(rnd.choice("abcé ") for _ in range(rnd.randrange(0, 120)))
        assert decontaminate.Pattern(item).best(text)[0] == edit_inside(item, text)


def test_leaks_are_found_and_clean_documents_stay(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9)))
    items = [(k, " ".join(word() for _ in range(rnd.randrange(14, 60)))) for k in range(40)] + [(100, None), (101, ""), (102, "tiny item here")]
    rows, want = [], set()
    for k in range(300):
        body = [word() for _ in range(rnd.randrange(0, 200))]
        if k % 3 == 0:
            item, text = rnd.choice(items[:40])
            own = text.split()
            if k % 2:
                for _ in range(len(own) // 15):
                    own[rnd.randrange(len(own))] = word()
            at = rnd.randrange(len(body) + 1)
            body[at:at] = [w.upper() for w in own] if k % 4 == 0 else own
            want.add((k, item))
        rows.append((k, "\n ".join(body)))
    rows += [(1000, None), (1001, ""), (1002, "so TINY item here ok"), (3, rows[3][1])]
    want.add((1002, 102))
    docs, table = documents(spark, rows, clash=True), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, table).collect()}
    assert found <= want and len(want - found) <= 1
    exact = {(k, i) for k, i in want if k % 2 == 0}
    assert exact <= found
    blocks = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, table, block_items=15).collect()}
    assert len(blocks ^ found) <= 1
    clean = decontaminate.clean(docs, table)
    assert clean.schema.simpleString() == docs.schema.simpleString()
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {k for k, _ in found}
    assert decontaminate.find_leaks(docs, table.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), table).count() == 0


def test_leaks_with_typos_in_every_other_word_are_found(spark):
    """Letter edits leave no run of whole words, but are far under the limit in characters."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(4, 9)))
    items = [(k, " ".join(word() for _ in range(rnd.randrange(12, 50)))) for k in range(60)] + [(60, "è".join(word() for _ in range(30)))]
    rows, want = [], set()
    for k, (item, text) in enumerate(items):
        own = text.split()
        for w in range(k % 2, len(own), 2):
            at = rnd.randrange(len(own[w]))
            own[w] = own[w][:at] + rnd.choice(["z", "zq", ""]) + own[w][at + 1:]
        rows.append((k, " \n".join([word() for _ in range(rnd.randrange(60))] + own + [word() for _ in range(rnd.randrange(60))])))
        want.add((k, item, edit_inside(text, " ".join(rows[-1][1].split()))))
        assert 0 < edit_inside(text, " ".join(rows[-1][1].split())) <= len(text) // 4
    found = decontaminate.find_leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in found} == want


def test_leak_tables_reach_their_target_for_each_size():
    rnd = random.Random(9)
    items = [(k, " ".join("".join(rnd.choices("etaoinsr", k=rnd.randrange(2, 8))) for _ in range(n))) for k, n in enumerate([1, 2, 4, 9, 18, 40, 90] * 5)]
    index = decontaminate.Index(items, 0.75)
    assert set(index.recalls) == {decontaminate.item_class(p.size) for p in index.patterns} and min(index.recalls.values()) >= 0.99
    with pytest.raises(ValueError):
        decontaminate.Index(items, 0.75, recall=1.01)


@pytest.mark.parametrize("edit", ["random", "even"])
def test_decontamination_recall_at_the_limit_by_size_class(edit):
    """Items with as many characters edited as the match allows, inside other text: at least 0.9 of each
    size class are found (characters replaced at even distances leave no long stretch whole)."""
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnoprstuvwz") for _ in range(rnd.randrange(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(k, prose(size)) for k, size in enumerate([14] * 60 + [30] * 60 + [60] * 60 + [200] * 20)]
    index = decontaminate.Index(items, 0.75)
    assert min(index.recalls.values()) >= 0.99
    draw = np.random.default_rng(3)
    change = decontaminate.edited if edit == "random" else decontaminate.spaced
    texts = []
    for k, _ in items:
        code = decontaminate.code_points(" ".join(decontaminate.normal(items[k][1])))
        changed = change(code, int(0.24 * len(code)), draw).astype("<u4").tobytes().decode("utf-32-le")
        texts.append(prose(40) + " " + changed + " " + prose(40))
    found = {}
    for i, _, raw, off in text_slices(pa.array(texts)):
        got = {(i + t, item) for t, item, _, _ in index.find(raw, off)}
        for k, (_, text) in enumerate(items[i:i + len(off) - 1], i):
            found.setdefault(decontaminate.item_class(len(text)), []).append((k, k) in got)
    assert len(found) >= 3 and all(np.mean(hits) >= 0.9 for hits in found.values()), {c: np.mean(h) for c, h in found.items()}


def test_a_very_long_item_is_indexed_in_bounded_time():
    import time
    rnd = random.Random(2)
    long = " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(4000))
    begin = time.time()
    index = decontaminate.Index([(1, long), (2, long[:90])], 0.75)
    assert time.time() - begin < 30
    text = "x y z " + long[:12000] + " brief change " + long[12000:] + " tail"
    got = {item for _, _, raw, off in text_slices(pa.array([text])) for _, item, _, _ in index.find(raw, off)}
    assert got == {0, 1}


def test_buckets_of_suffixes_follow_the_splitters():
    """Against a loop over tuples, with many equal tokens; many rows on one hot token take no longer."""
    import time
    draw = np.random.default_rng(8)
    for n in (0, 1, 7, 60):
        columns = [draw.integers(0, 4, n).astype(np.uint64) for _ in range(3)]
        order = suffix_dedup.multikey_order(columns)
        columns = [c[order] for c in columns]
        tokens = tuple(draw.integers(0, 5, 500).astype(np.uint64) for _ in range(3))
        got = suffix_dedup.part_of(tokens, (*columns, 1))
        splitters = list(zip(*(c.tolist() for c in columns)))
        assert got.tolist() == [sum(s <= t for s in splitters) for t in zip(*(c.tolist() for c in tokens))]
    hot = [np.full(1500, 7, np.uint64), np.full(1500, 9, np.uint64), np.sort(draw.integers(0, 1 << 40, 1500).astype(np.uint64))]
    tokens = (np.full(200_000, 7, np.uint64), np.full(200_000, 9, np.uint64), draw.integers(0, 1 << 40, 200_000).astype(np.uint64))
    begin = time.time()
    part = suffix_dedup.part_of(tokens, (*hot, 1))
    assert time.time() - begin < 2 and len(np.unique(part)) > 1400


def test_suffixes_are_ordered_by_their_leading_bytes():
    raw, off = (np.frombuffer(bytes(np.random.default_rng(4).integers(97, 101, 4000, dtype=np.uint8)), np.uint8), np.array([0, 4000]))
    start, last, lead, first, second = suffix_dedup.sampled(raw, off)
    text = raw.tobytes()
    for a, b, x in zip(start.tolist(), last.tolist(), lead.tolist()):
        assert any(text[k:k + suffix_dedup.LEAD] == x.to_bytes(suffix_dedup.LEAD, "big") for k in range(b, a + 69))
    order = suffix_dedup.multikey_order([lead, first, second])
    leading = [x.to_bytes(suffix_dedup.LEAD, "big") for x in lead[order].tolist()]
    assert leading == sorted(leading) and len(set(leading)) > 20
