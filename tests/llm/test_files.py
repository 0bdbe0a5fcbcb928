"""Tokens, wavelet files, packing, WARC and chat formatting against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents

from footfall.llm import bpe, chat, packing, queries, warc, wavelet
from footfall.llm.textops import text_bytes

PIECES = ["a", "b ", "  ", "\n", "\t", " ", "é", " ", " ", "　", "\x1c", "\x85", "'s", "1", "<|endoftext|>", "日本", "ß", "\r\n", "the", " The", ".", "…", "\x00", "\x7f", "🙂"]


def texts(seed, n=60):
    rnd = random.Random(seed)
    out = ["".join(rnd.choices(PIECES, k=rnd.randrange(0, 60))) for _ in range(n)]
    return out + [None, "", "word " * 3000, "x" * 5000]


def whole_ids(text):
    return bpe.tokenizer(queries.byte_bpe()).encode(text or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("keep", [10, 10**6])
def test_pieces_give_the_ids_of_whole_texts(monkeypatch, keep):
    monkeypatch.setattr(bpe, "KEEP", keep)
    coder = bpe.PieceIds(queries.byte_bpe())
    for seed in range(20):
        own = texts(seed)
        ids, at = coder.encode(*text_bytes(pa.array(own, pa.string())))
        assert [ids[a:b].tolist() + [0] for a, b in zip(at, at[1:])] == [whole_ids(t) for t in own]


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 3000):
        ids = np.minimum(rng.zipf(1.3, n), 700).astype(np.int64)
        built = wavelet.WaveletMatrix.build(ids, 10)
        matrix, docs, ends = wavelet.from_bytes(wavelet.to_bytes(built, [None, 4], np.array([n // 2, n])))
        assert docs == [None, 4] and ends.tolist() == [n // 2, n]
        assert np.array_equal(matrix.decode(), ids) and np.array_equal(matrix.access(np.arange(n)), ids)
        for token in {0, 1, 2, 5, 700, 999, 5000}:
            places = np.flatnonzero(ids == token)
            assert matrix.count(token) == len(places) and matrix.rank(token, n // 3) == (places < n // 3).sum()
            assert [matrix.select(token, k) for k in range(min(len(places), 5))] == places[:5].tolist()
        with pytest.raises(IndexError):
            matrix.select(701, 0)
        with pytest.raises(IndexError):
            matrix.access(np.array([n]))
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.build(np.array([9]), 3)


def test_token_files_round_trip(spark):
    rows = [(k * 7 - 50, t) for k, t in enumerate(texts(1))] + [(3, "twice"), (3, "twice"), (None, "no id")]
    got = wavelet.token_files(documents(spark, rows, clash=True, parts=3), queries.byte_bpe(), shard_tokens=500).collect()
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = whole_ids(text)
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    assert len({r.shard_file for r in got}) > 3
    assert wavelet.token_files(documents(spark, rows).limit(0), queries.byte_bpe()).count() == 0


@pytest.mark.parametrize("limits", [{}, {"max_tokens": 64, "max_segments": 3}, {"max_tokens": 100, "max_loss": 40, "min_cut": 1}])
def test_packing(spark, limits):
    rows = [(k, t) for k, t in enumerate(texts(2))]
    rows += [rows[7]] * 2
    got = packing.pack(documents(spark, rows, clash=True, parts=3), queries.byte_bpe(), **limits).collect()
    limit = {"max_tokens": 1024, "max_segments": 512, "max_loss": 1024, "min_cut": 8} | limits
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in dict(rows).items():
        ids, times = whole_ids(text), sum(r[0] == doc_id for r in rows)
        own = sorted(pieces[doc_id], key=lambda r: r.start)
        assert sum(r.length for r in own) == times * len(ids) and {r.doc_tokens for r in own} == {len(ids)}
        if times == 1:
            assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    waste = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        total = sum(r.length for r in own)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert total <= limit["max_tokens"] and len(own) <= limit["max_segments"]
        assert sum(r.length - 1 for r in own) <= limit["max_loss"]
        waste += 0 if total & (total - 1) == 0 else limit["max_tokens"] - total
    if not limits:
        assert waste <= 3 * 1024 + 8 * len(sequences)
    assert packing.pack(documents(spark, rows).limit(0), queries.byte_bpe()).count() == 0


def test_packing_counts_loss_of_instruction_rows(spark):
    df = spark.createDataFrame([(k, "word " * 30, 10) for k in range(50)], "doc_id long, text string, loss long")
    got = packing.pack(df, queries.byte_bpe(), max_tokens=200, max_loss=20, loss_col="loss").collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(packing.Packer.loss(r.start, r.length, r.doc_tokens - 10))
    assert max(map(sum, by.values())) <= 20


def test_warc_round_trip(spark):
    rnd = random.Random(1)
    body = ["<p>" + "é" * rnd.randrange(0, 200) + "</p>" for _ in range(15)]
    rows = [(k * 1000 if k % 3 else -k, f"http://x/{k}", rnd.choice(body)) for k in range(200)]
    rows += [(10**12, None, None), (10**12 + 1, "http://a b\r\nWARC-Type: x", ""), (5, "u", "q" * 100), (6, "u", "q" * 100), (5, "v", "q" * 100), (7, "u", "q" * 99), (8, "u", "q" * 99)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, kind string").repartition(4)
    got = warc.archive(df, range_bytes=3000, file_bytes=500).collect()
    first = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100:
            first[data] = min(first.get(data, page_id), page_id)
    want, seen = [], set()
    for page_id, _, html in sorted(rows, key=lambda r: r[0]):
        data = (html or "").encode()
        revisit = data in first and (page_id != first[data] or data in seen)
        seen.add(data)
        want.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[data] if revisit else None, None if revisit else html or ""))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.html) for r in got), key=key) == sorted(want, key=key)
    assert warc.archive(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "u", "q" * 100), (None, "u", "q" * 100)], "page_id long, url string, html string")
    assert [(r.page_id, r.record_type) for r in warc.archive(nulls).collect()] == [(None, "response")] * 2


def test_warc_files_are_deterministic(spark):
    df = spark.createDataFrame([(k, f"u{k}", "x" * (k % 400)) for k in range(500)], "page_id long, url string, html string")
    sums = []
    for parts in (1, 5):
        folder = warc.work_dir(spark, "test")
        sums.append(sorted((r.part, r.number, r.file_sha256) for r in warc.write_warc(df.repartition(parts), folder, file_bytes=2000, range_bytes=20_000).collect()))
    assert sums[0] == sums[1] and len(sums[0]) > 5


def test_chat_round_trip(spark):
    rnd = random.Random(3)
    signs = ["\\", "#", "### ", "<", "</turn>", " </turn>\n", "\n", " ", ":", ": ", "a", "é🙂", "Assistant", "@"]
    some = lambda: "".join(rnd.choices(signs, k=rnd.randrange(0, 9)))
    rows = [(rnd.randrange(40), rnd.randrange(30), rnd.choice(["user", "assistant", "system", some()]), some()) for _ in range(1500)]
    rows += [(-5, None, None, None), (None, 0, "user", "hi"), (None, 1, "assistant", None), (-6, 0, "user", "long " * 50_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, place string").repartition(3)
    got = {r.conv_id: r for r in chat.round_trip(df).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    assert got.keys() == by.keys()
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
    whole = "".join(r.formatted for r in chat.format_chats(df.where("conv_id = 3")).orderBy("place").collect())
    assert [t[:2] for t in chat.parse_turns(whole)] == [t[2:] for t in sorted(by[3])]
    assert chat.round_trip(df.limit(0)).count() == 0


def test_plain_text_is_not_escaped():
    turn, start, length = chat.render("user", "a # b < c: d")
    assert turn == "### User: a # b < c: d </turn>\n" and turn[start:start + length] == "a # b < c: d"
    assert chat.parse_turns("### User: x") == [] and chat.parse_turns("### Nobody: x </turn>\n") == []


def test_every_registered_packing_limit_binds_and_padding_stays_small(spark):
    """Short documents meet the segment limit, long answers the loss limit; prompts of other documents fill
    what the loss limit leaves."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 7)))
    rows = [(k, " ".join(word() for _ in range(rnd.choice([1, 3, 8])))) for k in range(900)]
    rows += [(1000 + k, " ".join(word() for _ in range(rnd.randrange(300, 4000)))) for k in range(30)]
    limits = queries.PACKING
    got = packing.pack(documents(spark, rows), queries.byte_bpe(), **limits).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    segments = {s: len(own) for s, own in sequences.items()}
    loss = {s: sum(packing.Packer.loss(r.start, r.length, r.doc_tokens - int(limits["loss_share"] * r.doc_tokens)) for r in own) for s, own in sequences.items()}
    tokens = {s: sum(r.length for r in own) for s, own in sequences.items()}
    assert max(segments.values()) == limits["max_segments"] and sum(v == limits["max_segments"] for v in segments.values()) > 3
    assert max(loss.values()) == limits["max_loss"] and sum(v == limits["max_loss"] for v in loss.values()) > 3
    assert max(tokens.values()) == limits["max_tokens"]
    full = [s for s in sequences if segments[s] < limits["max_segments"]]
    assert sum(limits["max_tokens"] - tokens[s] for s in full) < 0.03 * limits["max_tokens"] * len(full) + 4 * limits["max_tokens"]


def test_packing_takes_the_item_with_the_largest_dot_product():
    """The choice in a sequence, against the heuristic written out plainly."""
    rnd = random.Random(9)
    packer = packing.Packer(100, 5, 60, 8, 0)
    sizes = [(rnd.randrange(1, 90), rnd.random()) for _ in range(40)]
    for k, (n, share) in enumerate(sizes):
        packer.add(k, np.arange(n, dtype=np.int32), n - int(share * n))
    waiting = [(x[0], x[1], len(x[2]), x[4]) for x in packer.items]
    packer.pack(len(packer.items) - 1)
    first = [(r[0], r[1]) for r in packer.done if r[5] == 0]
    room, want = [100, 5, 60], []
    while True:
        fits = [(w, (w[2], 1, packer.loss(w[1], w[2], w[3]))) for w in waiting]
        fits = [(w, v) for w, v in fits if all(a <= b for a, b in zip(v, room))]
        if not fits:
            break
        w, v = max(fits, key=lambda x: sum(a / c * (b / c) for a, b, c in zip(x[1], room, (100, 5, 60))))
        want.append((w[0], w[1]))
        waiting.remove(w)
        room = [a - b for a, b in zip(room, v)]
    assert first[:len(want)] == want and len(first) - len(want) <= 1


def test_id_ranges_are_refined_until_all_fit(spark, monkeypatch):
    """More full cells than one pass counts again: dense ids beside very sparse ones."""
    monkeypatch.setattr(warc, "REFINED", 3)
    ids = [k if k < 1500 else k * 1_000_003 for k in range(4000)]
    df = spark.createDataFrame([(k, 10) for k in ids] + [(7, 5000)], "page_id long, bytes long")
    bounds = warc.id_ranges(df, 400)
    held = np.bincount(np.searchsorted(np.array(bounds), np.array([*ids, 7]), "left"), [10] * len(ids) + [5000])
    assert bounds == sorted(bounds) and np.sort(held)[-2] <= 400 and held.sum() == 45_000 and len(held) < 250
