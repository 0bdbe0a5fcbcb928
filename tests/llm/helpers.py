"""Small tables and brute-force versions for the llm tests."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# extra columns whose names the operators use inside
CLASH = ["n", "cls", "slice", "place", "file", "label", "region", "state", "start", "score", "statistics", "model", "salt"]


def documents(spark, rows, clash=False, parts=None):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) + (("x",) * len(CLASH) if clash else ()) for r in rows]
    df = spark.createDataFrame(full, DOCS + ("".join(f", `{c}` string" for c in CLASH) if clash else ""))
    return df.repartition(parts) if parts else df


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def shingles(text):
    w = words(text, True)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def jaccard_components(rows):
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= 75 * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return [(r[0], len(sets[k]), least[find(k)]) for k, r in enumerate(rows)]


def passages_removed(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by a dictionary of all substrings."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p:p + length]
            if s in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def edit_inside(item, text):
    """Smallest edit distance of the item to a stretch of the text, by dynamic programming."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for k, d in enumerate(item, 1):
            new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (c != d)))
        row = new
        best = min(best, row[-1])
    return best


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    text = text or ""
    w = words(text)
    windows = {}
    for k in range(len(w) - 2):
        windows.setdefault(tuple(w[k:k + 3]), []).append(k)
    covered = {k + j for places in windows.values() if len(places) > 1 for k in places for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
