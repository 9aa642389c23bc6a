"""Language ID: script ranges narrow the candidates, then Viterbi over per-word scores labels spans of a text.

A word's score for a language is the sum of its smoothed n-gram log probabilities. Going over to another language costs
SWITCH. The model's counts come from a bounded sample of labelled rows; every text is labelled whole.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaframe.llm.common import NON_LETTER, U, grams, mix, slices, small_batches, tidy, word_hashes

#: About as many labelled rows of each language are learned from, at most.
FIT_ROWS = 3000
BUCKETS = 1 << 16
SWITCH = 14.0
#: A script counts as a language's if so large a part of its letters is in it.
SCRIPT_SHARE = 0.05
#: Words whose scores a worker remembers before it starts anew.
MEMORY = 300_000
#: Words that are scored, or steps that are listed, at a time.
BLOCK = 1 << 15
# First and last code point of the blocks that tell scripts apart.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
_NAMES = [*SCRIPTS, "other"]


def script(word: str) -> int:
    """The script of a word's first letter, as a place in SCRIPTS; the one after the last if in none."""
    c = ord(word[0])
    if c < 128:
        return 0
    return next((i for i, ranges in enumerate(SCRIPTS.values()) if any(a <= c <= b for a, b in ranges)), len(SCRIPTS))


def letters(raw: bytes) -> str:
    """A run of bytes as a lower-case word: its letters only."""
    word = raw.decode("utf-8", "replace").lower()
    return word if word.isalpha() else "".join([c for c in word if c.isalpha()])


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word itself and of its pieces of two to four letters, ends marked; and the word of each bucket, in order."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), np.uint32).astype(U)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word, first = np.repeat(np.arange(len(words)), size), np.cumsum(size) - size
    place = (np.arange(len(points)) - first[word]).astype(U)
    found, whose = [mix(np.add.reduceat(mix(points + (place << U(32))), first))], [np.arange(len(words))]
    for k in (2, 3, 4):
        at = np.flatnonzero(word[: 1 - k] == word[k - 1 :])
        found.append(mix(grams(points, k)[at] + U(k)))
        whose.append(word[at])
    owner = np.concatenate(whose)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(found)[order] % U(BUCKETS)).astype(np.int64), owner[order]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language and bucket; buckets from BUCKETS on count letters by script."""
    sums: dict[str, np.ndarray] = {}
    for piece, texts in slices(batches):
        langs = piece.column(1).to_pylist()
        _, doc, starts, ends, joined = word_hashes(texts, apart=NON_LETTER)
        words: dict[str, dict[bytes, int]] = {}
        for d, s, e in zip(doc.tolist(), starts.tolist(), ends.tolist(), strict=True):
            seen = words.setdefault(langs[d], {})
            raw = joined[s:e]
            seen[raw] = seen.get(raw, 0) + 1
        for lang, seen in words.items():
            total = sums.setdefault(lang, np.zeros(BUCKETS + len(_NAMES), np.int64))
            known = [(word, n) for raw, n in seen.items() if (word := letters(raw))]
            found, owner = features([word for word, _ in known])
            times = np.array([n for _, n in known], np.int64)
            np.add.at(total, found, times[owner])
            for word, n in known:
                total[BUCKETS + script(word)] += n * len(word)
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at])], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probabilities (language, bucket) and whether a script is a language's, from rows with text and lang.

    About fit_rows rows of each language are taken, by a hash of doc_id; the counts have at most BUCKETS rows a language.
    """
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return [], np.zeros((0, BUCKETS)), np.zeros((0, len(_NAMES)), bool)
    part = F.create_map(*[F.lit(x) for k, n in sorted(per.items()) for x in (k, min(1.0, fit_rows / n))])
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < part[F.col("lang")] * 1_000_003)
    found = some.select("text", "lang").mapInArrow(tidy(_count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in found})
    count = np.zeros((len(langs), BUCKETS + len(_NAMES)))
    for r in found:
        count[langs.index(r["lang"]), r["bucket"]] = r["n"]
    grams, scripts = count[:, :BUCKETS], count[:, BUCKETS:]
    used = max(1, int((grams.sum(0) > 0).sum()))
    logp = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * used))
    return langs, logp.astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(1, keepdims=True))


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best labels of a row of words; scores (word, language). Ties go to the earlier language."""
    n, k = scores.shape
    back = array("H", bytes(2 * n * k))  # 0: from the same language; else from that language, counted from 1
    best = scores[0].tolist()
    for start in range(1, n, BLOCK):
        for t, row in enumerate(scores[start : start + BLOCK].tolist(), start):
            high = max(best)
            bar = high - switch
            if min(best) < bar:
                come = best.index(high) + 1
                back[t * k : t * k + k] = array("H", [come if x < bar else 0 for x in best])
                best = [(bar if x < bar else x) + s for x, s in zip(best, row, strict=True)]
            else:
                best = [x + s for x, s in zip(best, row, strict=True)]
    out = np.zeros(n, np.int64)
    now = out[-1] = best.index(max(best))
    end = n
    for t in range(n - 1, 0, -1):
        if come := back[t * k + now]:
            out[t:end] = now
            now, end = come - 1, t
    out[:end] = now
    return out


def constant(scores: np.ndarray, lang: int, switch: float = SWITCH) -> bool:
    """Whether staying with lang, the best by sums, is surely best: no run of words gains as much elsewhere as leaving costs."""
    gain = scores - scores[:, lang : lang + 1]
    gain[:, lang] = -np.inf
    g = np.cumsum(gain.max(1))
    low = np.minimum.accumulate(np.concatenate(([0.0], g[:-1])))
    return bool((g - low).max() < switch)


class Labeller:
    def __init__(self, langs: list[str], logp: np.ndarray, own: np.ndarray):
        self.langs, self.logp, self.own = langs, np.ascontiguousarray(logp.T), own
        self.row: dict[bytes, int] = {}
        self.table = np.zeros((1024, len(langs)))
        self.size = np.zeros(1024, np.int64)

    def score(self, words: list[str]) -> np.ndarray:
        """Scores by word and language, the best 0; a word without letters has 0 for all."""
        out = np.zeros((len(words), len(self.langs)))
        full = [i for i, word in enumerate(words) if word]
        if not full or not self.langs:
            return out
        found, owner = features([words[i] for i in full])
        s = np.add.reduceat(self.logp[found], np.flatnonzero(np.diff(owner, prepend=-1)), axis=0, dtype=float)
        fits = self.own[:, [script(words[i]) for i in full]].T
        s = np.where(fits | ~fits.any(1, keepdims=True), s, s.min(1, keepdims=True) - 50)
        out[full] = s - s.max(1, keepdims=True)
        return out

    def rows(self, raws: list[bytes]) -> np.ndarray:
        if len(self.row) > MEMORY:
            self.row.clear()
        had = len(self.row)
        out = np.fromiter((self.row.setdefault(raw, len(self.row)) for raw in raws), np.int64, len(raws))
        new = [letters(raw) for raw in itertools.islice(self.row, had, None)]
        while len(self.table) < len(self.row):
            self.table, self.size = np.concatenate((self.table, np.zeros_like(self.table))), np.concatenate((self.size, np.zeros_like(self.size)))
        for at in range(0, len(new), BLOCK):
            some = new[at : at + BLOCK]
            self.table[had + at : had + at + len(some)] = self.score(some)
            self.size[had + at : had + at + len(some)] = [len(word) for word in some]
        return out

    def label(self, texts: list[bytes]) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, its part of the letters, and spans (first word, last word, language), of each text."""
        h, doc, starts, ends, joined = word_hashes(texts, apart=NON_LETTER)
        _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        rows = self.rows([joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])[inverse]
        scores, size = self.table[rows], self.size[rows]
        edge = np.searchsorted(doc, np.arange(len(texts) + 1))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            weight = size[a:b]
            total = int(weight.sum())
            if not total or not self.langs:
                yield "und", 0.0, []
                continue
            own = scores[a:b]
            top = int(own.sum(0).argmax())
            if constant(own, top):
                yield self.langs[top], 1.0, [(0, b - a - 1, self.langs[top])]
                continue
            path = viterbi(own)
            part = np.bincount(path, weights=weight, minlength=len(self.langs))
            cut = np.concatenate(([0], np.flatnonzero(path[1:] != path[:-1]) + 1, [b - a]))
            best = int(part.argmax())
            yield self.langs[best], float(part[best] / total), [(int(i), int(j) - 1, self.langs[path[i]]) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _label(model: tuple[list[str], np.ndarray, np.ndarray], spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(*model)
        for piece, texts in slices(batches):
            lang, score, parts = zip(*labeller.label(texts), strict=True)
            cols = [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            names = ["lang_pred", "score"]
            if spans:
                cols.append(pa.array([[{"first_word": a, "last_word": b, "lang": k} for a, b, k in x] for x in parts], pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("lang", pa.string())]))))
                names.append("spans")
            at = piece.schema.get_field_index("text")
            rest = [i for i in range(piece.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([piece.column(i) for i in rest] + cols, names=[piece.schema.names[i] for i in rest] + names)

    return run


def identify(docs: DataFrame, train: DataFrame, spans: bool = True, keep: tuple[str, ...] = ("doc_id",), fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per row of docs: the columns `keep` (text too, if named), lang_pred, score and, with spans, spans of words.

    Words are runs of letters. lang_pred: the language with the most letters in its spans, ties to the first by name;
    score: its part of the letters. Null text and text without a letter: `und`, 0. Words in a script that no learned
    language uses are scored for all. Learned from rows of train with text and lang; without any, all is `und`.
    Repeated rows get equal labels; other columns have no influence. Empty table: no rows.
    """
    small_batches(docs.sparkSession)
    model = fit(train, fit_rows)
    names = [k for k in keep if k != "text"]
    fields = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in names]
    source = docs.select(*[F.col(f"`{k}`") for k in names], "text", *([F.col("text").alias("__text")] if "text" in keep else []))
    schema = ", ".join(fields + ["__text string"] * ("text" in keep) + ["lang_pred string", "score double"])
    if spans:
        schema += ", spans array<struct<first_word: int, last_word: int, lang: string>>"
    out = source.mapInArrow(tidy(_label(model, spans)), schema)
    return out.withColumnRenamed("__text", "text") if "text" in keep else out


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of doc_id as text, mod 4, is 2. Null doc_id: no."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_held_out(docs: DataFrame, spans: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score (and spans) of docs, learned from those that aren't held out and have a doc_id."""
    own = docs.withColumn("held_out", held_out()).select("doc_id", "text", "lang", "held_out")
    return identify(own, own.where("NOT held_out AND doc_id IS NOT NULL"), spans, ("doc_id", "held_out"))
