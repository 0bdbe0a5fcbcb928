"""Quality rules: base counts and n-gram perplexity bands.

The language model is modified Kneser-Ney over characters of every script: a symbol is a code point in lower
case (digits are one symbol, white space is one, code points beyond the first plane share the private
range), so an order-4 n-gram is exactly 64 bits. Spark counts them over all texts with sums in the tasks
first; every language has a model and a band of its own, whatever its share of the corpus. A model holds
all n-grams of its language, however many. Spark joins and sums give the probabilities and back-off weights
of all orders; they are written as sorted hash arrays in files under the shared folder, a language's files
by ranges of the hash, so that each holds about PART n-grams at most. A task looks up the distinct n-grams of
a slice by binary search in the files of its texts' languages, file after file, and keeps the latest few.

A document is rejected by the base rules, or when the log10 perplexity of a symbol lies outside its
language's band. The band is the median of the documents that pass the base rules, plus and minus
``width`` times the median distance from it, widened for short texts whose mean varies more. A model is
fitted on the texts that it judges, so a language that consists of junk alone has its junk in its band.

Null texts have no words and fail the base rules; a null language counts as the language ''. Ties
and repeated rows are judged alike, row by row. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from footfall.llm.common import Committer, get, owns_worker, relax, saved, work_dir
from footfall.llm.textops import SPACE, hash_spans, mix, per_text, shingle_hashes, slices, text_bytes, words

ORDER, BITS = 4, 16
PART = 1 << 20  # n-grams in a file of a model at most, about
GATHERED = 1 << 21  # distinct n-grams that a task sums before it sends them
HELD = 8  # files of models that a worker keeps, of some 16 MB each at most
UNIFORM = 1.0 / (1 << BITS)
# classes of bytes, for the classifier's statistics
SYMBOL = np.full(256, 31, np.uint8)
SYMBOL[0x21:0x7F] = 29
SYMBOL[[0x20, 9, 10, 11, 12, 13]] = 0
for _k in range(26):
    SYMBOL[[65 + _k, 97 + _k]] = 1 + _k
SYMBOL[48:58] = 27
SYMBOL[[ord(c) for c in ".,;:!?'\"-()"]] = 28
SYMBOL[128:] = 30
MARK = np.zeros(256, bool)
MARK[[ord(c) for c in "#*$%&|<>"]] = True
STEP = 1000  # histogram cells per unit of log10 perplexity


def base_counts(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(off) - 1
    starts, ends, first = words(raw, off)
    visible = ~SPACE[raw]
    out = {"n_words": np.diff(first), "word_chars": per_text(visible & ((raw & 0xC0) != 0x80), off), "n_symbols": per_text(MARK[raw], off)}
    breaks = np.flatnonzero(raw == 10)
    a, b = np.sort(np.concatenate([off[:-1], breaks + 1])), np.sort(np.concatenate([breaks, off[1:]]))
    seen = np.concatenate([[0], np.cumsum(visible)])
    worded = seen[b] > seen[a]
    a, b = a[worded], b[worded]
    text = np.searchsorted(off, a, "right") - 1
    line = mix(hash_spans(raw, a, b) ^ mix(text.astype(np.uint64)))
    _, leader = np.unique(line, return_index=True)
    out["n_dup_lines"] = np.bincount(text, minlength=n) - np.bincount(text[leader], minlength=n)
    window, text = shingle_hashes(hash_spans(raw, starts, ends), first, 3)
    _, inverse, count = np.unique(mix(window ^ mix(text.astype(np.uint64))), return_inverse=True, return_counts=True)
    again = count[inverse] > 1
    covered = np.zeros(len(starts), bool)
    # window k of a text starts at its k-th word
    place = first[text] + np.arange(len(text)) - np.searchsorted(text, np.arange(n))[text]
    for k in range(3):
        covered[place[again] + k] = True
    out["n_repeat_words"] = per_text(covered, first)
    return out


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def _symbol_table() -> np.ndarray:
    """Symbol of each code point of the first plane: lower case, one digit, one white space."""
    out = np.arange(1 << 16, dtype=np.uint16)
    for k in range(1 << 16):
        c = chr(k)
        if k in (0x20, 9, 10, 11, 12, 13):
            out[k] = 0x20
        elif c.isdigit():
            out[k] = 0x30
        elif len(c.lower()) == 1 and ord(c.lower()) < 1 << 16:
            out[k] = ord(c.lower())
    return out


OF_POINT = _symbol_table()


def codes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the packed n-gram that ends at each character, offsets of the texts in characters); before a text's
    first character stands white space."""
    n, pad = len(off) - 1, ORDER - 1
    points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    begin = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off]
    symbol = OF_POINT[np.where(points < 1 << 16, points, 0xE000 + points % 0x1900)]
    place = np.arange(len(points)) + np.repeat(pad * np.arange(1, n + 1), np.diff(begin))
    padded = np.full(len(points) + pad * n, 0x20, np.uint64)
    padded[place] = symbol
    code = padded.copy()
    for k in range(1, ORDER):
        code[k:] |= padded[:-k] << np.uint64(BITS * k)
    return code[place], begin


def by_language(b: pa.RecordBatch, lang: int, text: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(language, row numbers, bytes, offsets) of the texts of each language of each slice of a batch."""
    value = np.array([x or "" for x in b.column(lang).to_pylist()], object)
    for i, j in slices(text_bytes(b.column(text))[1]):
        for x in sorted(set(value[i:j])):
            at = i + np.flatnonzero(value[i:j] == x)
            yield x, at, *text_bytes(b.column(text).take(pa.array(at)))


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of several counted lists, in order, with their sums."""
    code, count = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(code)
    code, count = code[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(count, first) if len(first) else count


def counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = np.sort(code)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.diff(np.append(first, len(code)))


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, code, n) over all texts; a task sends what it has summed whenever that is GATHERED long."""
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_worker("rules")
        held: dict[str, list] = {}

        def rows(lang):
            code, n = summed(held.pop(lang))
            for a in range(0, len(code), 1 << 18):
                own = code[a:a + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.view(np.int64)), pa.array(n[a:a + len(own)].astype(np.int64))], schema=schema)

        for b in batches:
            for lang, _, raw, off in by_language(b, 0, 1):
                parts = held.setdefault(lang, [])
                parts.append(counted(codes(raw, off)[0]))
                if len(parts) == 16:
                    held[lang] = [summed(parts)]
                while sum(len(c) for own in held.values() for c, _ in own) > GATHERED:
                    most = max(held, key=lambda x: sum(len(c) for c, _ in held[x]))
                    yield from rows(most)
            relax()
        for lang in sorted(held):
            yield from rows(lang)

    return (docs.select("lang", "text").mapInArrow(run, "lang string, code long, n long")
            .groupBy("lang", "code").agg(F.sum("n").alias("n")))


def frequent(counts: DataFrame, capacity: int) -> DataFrame:
    """The n-grams of each language, or the most frequent ones where there are more than ``capacity``: those
    met at least as often as the least number that leaves no more. For a look at a corpus: models hold all."""
    steps = counts.groupBy("lang", "n").agg(F.count("*").alias("grams"))     # counts of counts
    more = Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    least = (steps.withColumn("grams", F.sum("grams").over(more)).where(F.col("grams") <= capacity)
             .groupBy(F.col("lang").alias("cut_lang")).agg(F.min("n").alias("least")))
    return counts.join(least, counts["lang"].eqNullSafe(least["cut_lang"])).where(F.col("n") >= F.col("least")).select("lang", "code", "n")


def low_bits(code: np.ndarray, order: int) -> np.ndarray:
    """The last symbols of packed n-grams."""
    return code if order >= ORDER else code & np.uint64((1 << BITS * order) - 1)


def all_orders(counts: DataFrame) -> DataFrame:
    """(lang, size, code, n): the n-grams of all orders; lower orders count distinct left neighbours."""
    level = counts.select("lang", F.lit(ORDER).alias("size"), "code", "n")
    out = level
    for size in range(ORDER - 1, 0, -1):
        low = F.col("code").bitwiseAND((1 << BITS * size) - 1)
        level = level.groupBy("lang", low.alias("code")).agg(F.count(F.lit(1)).alias("n")).select("lang", F.lit(size).alias("size"), "code", "n")
        out = out.unionByName(level)
    return out


def discounts(levels: DataFrame) -> DataFrame:
    """(lang, size, d1, d2, d3): what counts of 1, 2 and at least 3 lose, from the counts of counts."""
    n1, n2, n3, n4 = (F.col(f"n{k}").cast("double") for k in (1, 2, 3, 4))
    y = F.when(n1 > 0, n1 / (n1 + 2 * n2)).otherwise(0.5)
    raw = [F.when(n1 > 0, 1 - 2 * y * n2 / n1).otherwise(0.5), F.when(n2 > 0, 2 - 3 * y * n3 / n2).otherwise(0.75), F.when(n3 > 0, 3 - 4 * y * n4 / n3).otherwise(0.9)]
    return (levels.groupBy("lang", "size").agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)])
            .select("lang", "size", *[F.greatest(F.lit(0.05), F.least(F.lit(float(k)), d)).alias(f"d{k}") for k, d in enumerate(raw, 1)]))


def contexts(levels: DataFrame, cut: DataFrame) -> DataFrame:
    """(lang, size, context, total, gamma): the counts of the n-grams of a size that begin with a context, and
    the share of them that the discounts hand to the order below."""
    n = F.col("n")
    sums = (levels.groupBy("lang", "size", F.shiftrightunsigned("code", BITS).alias("context"))
            .agg(F.sum(n).cast("double").alias("total"), F.count_if(n == 1).alias("_1"), F.count_if(n == 2).alias("_2"), F.count_if(n > 2).alias("_3")))
    taken = F.col("_1") * F.col("d1") + F.col("_2") * F.col("d2") + F.col("_3") * F.col("d3")
    return sums.join(cut, ["lang", "size"]).select("lang", "size", "context", "total", (taken / F.col("total")).alias("gamma"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, size, code, p, weight): n-grams of all orders with their probabilities and back-off weights.

    Lower orders count distinct left neighbours. Each order discounts counts of 1, 2 and at least 3
    by amounts from its counts of counts and hands the rest to the order below; below order 1 stands
    the uniform distribution over all symbols, and size 0 is a symbol that was never seen. Everything is
    joined and summed by n-gram or by context: no task holds a model.
    """
    spark = counts.sparkSession
    levels = saved(all_orders(counts), work_dir(spark, "orders"))
    cut = saved(discounts(levels), work_dir(spark, "discounts"))
    around = saved(contexts(levels, cut), work_dir(spark, "contexts"))
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    own = (levels.join(cut, ["lang", "size"]).withColumn("context", F.shiftrightunsigned("code", BITS))
           .join(around, ["lang", "size", "context"]).select("lang", "size", "code", ((F.col("n") - d) / F.col("total")).alias("p"), "gamma"))
    floor = around.where(F.col("size") == 1).select("lang", F.lit(0).alias("size"), F.lit(0).cast("long").alias("code"), (F.lit(UNIFORM) * F.col("gamma")).alias("p"))
    below, out = None, floor
    for size in range(1, ORDER + 1):
        level = own.where(F.col("size") == size)
        if below is None:
            rest = level.withColumn("_below", F.lit(UNIFORM))
        else:
            base = below.select("lang", F.col("code").alias("_low"), F.col("p").alias("_below"))
            rest = level.withColumn("_low", F.col("code").bitwiseAND((1 << BITS * (size - 1)) - 1)).join(base, ["lang", "_low"])
        below = saved(rest.select("lang", "size", "code", (F.col("p") + F.col("gamma") * F.col("_below")).alias("p")), work_dir(spark, f"order{size}"))
        out = out.unionByName(below)
    weights = around.select("lang", (F.col("size") - 1).alias("size"), F.col("context").alias("code"), F.col("gamma").alias("_gamma")).where(F.col("size") > 0)
    return out.join(weights, ["lang", "size", "code"], "left").select("lang", "size", "code", "p", F.coalesce("_gamma", F.lit(1.0)).alias("weight"))


def slot(code: np.ndarray, order: int) -> np.ndarray:
    """Hash of packed n-grams of one order; n-grams of one order never share a hash."""
    return mix(code ^ np.uint64(0x9E3779B97F4A7C15 * order & (1 << 64) - 1))


_PARTS: dict[tuple[str, str], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # (folder, file) -> part of a model, latest last


def part_of(h: np.ndarray, bits: int) -> np.ndarray:
    """The part of a model that holds each hash: its first bits."""
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


class Model:
    """The files of all languages' models: sorted hashes with their probabilities and back-off weights, a
    file for each range of the hashes."""

    def __init__(self, folder: str, files: dict[str, tuple[int, dict[int, str]]]):
        self.folder, self.files = folder, files  # language -> (bits of a range's number, range -> file)

    def part(self, file: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        name = self.folder, file
        part = _PARTS.pop(name, None)
        if part is None:
            while len(_PARTS) >= HELD:
                _PARTS.pop(next(iter(_PARTS)))
            data = get(*name)
            n = len(data) // 16
            part = np.frombuffer(data, "<u8", n), np.frombuffer(data, "<f4", n, 8 * n), np.frombuffer(data, "<f4", n, 12 * n)
        _PARTS[name] = part
        return part

    def find(self, h: np.ndarray, lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether the model has each hash, its log10 probability, its back-off weight)."""
        bits, files = self.files[lang]
        hit, log_p, weight = np.zeros(len(h), bool), np.zeros(len(h)), np.zeros(len(h))
        part = part_of(h, bits)
        for k in np.unique(part):
            if k in files:
                own = np.flatnonzero(part == k) if bits else slice(None)
                hashes, p, w = self.part(files[k])
                at = np.minimum(np.searchsorted(hashes, h[own]), len(hashes) - 1)
                hit[own], log_p[own], weight[own] = hashes[at] == h[own], p[at], w[at]
        return hit, log_p, weight

    def log10(self, code: np.ndarray, lang: str) -> np.ndarray:
        """log10 probability of the last symbol of each n-gram; unseen ones back off to lower orders."""
        out = np.zeros(len(code))
        if lang not in self.files:
            return out + np.log10(UNIFORM)
        todo = np.arange(len(code))
        for order in range(ORDER, -1, -1):
            low = low_bits(code[todo], order) if order else np.zeros(len(todo), np.uint64)
            hit, log_p, _ = self.find(slot(low, order), lang)
            out[todo[hit]] += log_p[hit]
            todo, low = todo[~hit], low[~hit]
            if not len(todo):
                break
            if order > 1:
                hit, _, weight = self.find(slot(low >> np.uint64(BITS), order - 1), lang)
                out[todo[hit]] += weight[hit]
        return out

    def mean_log10(self, raw: np.ndarray, off: np.ndarray, lang: str) -> tuple[np.ndarray, np.ndarray]:
        """(log10 perplexity of a symbol for each text, NaN where there is none; its symbols)."""
        code, begin = codes(raw, off)
        distinct, inverse = np.unique(code, return_inverse=True)
        value = self.log10(distinct, lang)[inverse]
        total = np.diff(np.concatenate([[0.0], np.cumsum(value)])[begin])
        size = np.diff(begin)
        return np.where(size > 0, -total / np.maximum(size, 1), np.nan), size


def fit(docs: DataFrame, part: int = PART) -> Model:
    """Count n-grams over all texts and build every language's model from all of them, in files of about
    ``part`` n-grams at most."""
    spark = docs.sparkSession
    counts = saved(count_ngrams(docs), work_dir(spark, "ngrams"))
    grams = saved(kneser_ney(counts), work_dir(spark, "grams"))
    folder = work_dir(spark, "models")
    ranges = F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / F.lit(part))))
    bits = saved(grams.groupBy("lang").agg(ranges.cast("int").alias("bits")), work_dir(spark, "ranges"))
    schema = pa.schema([("lang", pa.string()), ("part", pa.int64()), ("hash", pa.int64()), ("p", pa.float32()), ("weight", pa.float32())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, code, p, weight, bits = (b.column(k).to_numpy(zero_copy_only=False) for k in range(1, 6))
            h, part = np.zeros(len(code), np.uint64), np.zeros(len(code), np.int64)
            for k in range(ORDER + 1):
                h[size == k] = slot(code[size == k].view(np.uint64), k)
            for k in np.unique(bits):
                part[bits == k] = part_of(h[bits == k], int(k))
            log_p, log_w = np.log10(p).astype("f4"), np.log10(np.maximum(weight, 1e-12)).astype("f4")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(part), pa.array(h.view(np.int64)), pa.array(log_p), pa.array(log_w)], schema=schema)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        lang, part, hashes = pdf["lang"].iloc[0], int(pdf["part"].iloc[0]), pdf["hash"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        data = hashes[order].astype("<u8").tobytes() + pdf["p"].to_numpy()[order].astype("<f4").tobytes() + pdf["weight"].to_numpy()[order].astype("<f4").tobytes()
        done = Committer(f"{folder}/files").put(f"{hashlib.sha256(lang.encode()).hexdigest()}-{part}", data)
        return pd.DataFrame({"lang": [lang], "part": [part], "file": [done["file"]]})

    dealt = grams.join(bits, "lang").select("lang", "size", "code", "p", "weight", "bits").mapInArrow(deal, "lang string, part long, hash long, p float, weight float")
    files = saved(dealt.groupBy("lang", "part").applyInPandas(build, "lang string, part long, file string"), f"{folder}/manifest")
    parts = {r.lang: (r.bits, {}) for r in bits.collect()}  # one row a language
    for r in files.collect():  # one name a file
        parts[r.lang][1][r.part] = r.file
    return Model(f"{folder}/files", parts)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(b: pa.RecordBatch, lang: int, text: int, model: Model) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Base counts, log10 perplexity and symbols of each row of a batch."""
    counts = {k: np.zeros(b.num_rows, np.int64) for k in COUNTS}
    ppl, size = np.full(b.num_rows, np.nan), np.zeros(b.num_rows, np.int64)
    owns_worker("rules", _PARTS.clear)
    for x, at, raw, off in by_language(b, lang, text):
        for k, v in base_counts(raw, off).items():
            counts[k][at] = v
        ppl[at], size[at] = model.mean_log10(raw, off, x)
    relax()
    return counts, ppl, size


def bands(measured: DataFrame, width: float, slack: float) -> DataFrame:
    """(band_lang, middle, reach) of each language: median and allowed distance from the histogram of
    its own texts that pass the base rules."""
    cell = F.round(F.col("log10_ppl") * STEP).cast("long")
    hist = (measured.where(~F.col("base_failed") & F.col("log10_ppl").isNotNull())
            .groupBy("model_lang", cell.alias("cell")).agg(F.count("*").alias("n")))

    def band(h: pd.DataFrame) -> pd.DataFrame:  # at most a few thousand cells a language
        middle = weighted_median(h["cell"].to_numpy(), h["n"].to_numpy())
        spread = weighted_median(np.abs(h["cell"].to_numpy() - middle), h["n"].to_numpy())
        return pd.DataFrame({"band_lang": [h["model_lang"].iloc[0]], "middle": [middle / STEP], "reach": [width * spread / STEP + slack]})

    return hist.groupBy("model_lang").applyInPandas(band, "band_lang string, middle double, reach double")


def weighted_median(value: np.ndarray, weight: np.ndarray) -> float:
    order = np.argsort(value, kind="stable")
    total = np.cumsum(weight[order])
    return float(value[order][np.searchsorted(total, total[-1] / 2)])


def far(ppl: str, size: str, short: float, prefix: str = ""):
    """Whether a row's log10 perplexity lies outside the band joined to it; without one nothing does."""
    reach = F.col(f"{prefix}reach") + F.lit(float(short)) / F.sqrt(F.greatest(F.col(size), F.lit(1)).cast("double"))
    return F.coalesce(F.abs(F.col(ppl) - F.col(f"{prefix}middle")) > reach, F.lit(False))


WIDTH, SLACK, SHORT = 5.0, 0.02, 0.6


def judge(docs: DataFrame, width: float = WIDTH, slack: float = SLACK, short: float = SHORT) -> tuple[DataFrame, Model, DataFrame]:
    """(one row per document with counts, perplexity and verdict; the model; the bands).

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    log10_ppl.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "lang", "text")
    model = fit(docs)
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", docs_type(docs)), ("lang", pa.string()), *((k, pa.int64()) for k in COUNTS), ("base_failed", pa.bool_()), ("log10_ppl", pa.float64()), ("symbols", pa.int64()), ("model_lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            counts, ppl, size = measure(b, 1, 2, model)
            langs = [x or "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(counts[k]) for k in COUNTS), pa.array(base_failed(counts)), pa.array(ppl, from_pandas=True), pa.array(size), pa.array(langs, pa.string())], schema=schema)

    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = saved(docs.mapInArrow(run, f"doc_id {kind}, lang string, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, log10_ppl double, symbols long, model_lang string"), work_dir(spark, "measured"))
    band = saved(bands(measured, width, slack), work_dir(spark, "bands"))
    result = (measured.join(band, measured["model_lang"] == band["band_lang"], "left")
              .select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~far("log10_ppl", "symbols", short)).alias("kept"), "log10_ppl"))
    return result, model, band


def docs_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(docs.schema["doc_id"].dataType)


def keep(docs: DataFrame, width: float = WIDTH, slack: float = SLACK, short: float = SHORT) -> DataFrame:
    """The documents that the rules keep, with all their columns. Texts are measured once: the rows that
    pass the base rules are written with their perplexity, and the bands of their languages pick from these."""
    spark = docs.sparkSession
    model = fit(docs.select("lang", "text"))
    shared = spark.sparkContext.broadcast(model)
    lang, text = docs.columns.index("lang"), docs.columns.index("text")
    own = [("rules_lang", "string"), ("rules_ppl", "double"), ("rules_symbols", "long")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            counts, ppl, size = measure(b, lang, text, model)
            more = [pa.array([x or "" for x in b.column(lang).to_pylist()], pa.string()), pa.array(ppl, from_pandas=True), pa.array(size)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *(x for x, _ in own)]).filter(pa.array(~base_failed(counts)))

    schema = StructType(list(docs.schema.fields))
    for name, kind in own:
        schema = schema.add(name, kind)
    path = work_dir(spark, "passed")
    docs.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    passed = spark.read.schema(schema).parquet(path)
    measured = passed.select(F.col("rules_lang").alias("model_lang"), F.col("rules_ppl").alias("log10_ppl"), F.lit(False).alias("base_failed"))
    band = saved(bands(measured, width, slack), work_dir(spark, "bands"))
    band = band.select(F.col("band_lang").alias("rules_band"), *(F.col(c).alias(f"rules_{c}") for c in ("middle", "reach")))
    joined = passed.join(band, F.col("rules_lang") == F.col("rules_band"), "left")
    return joined.where(~far("rules_ppl", "rules_symbols", short, "rules_")).drop(*(x for x, _ in own), *band.columns)
