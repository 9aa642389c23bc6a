"""Substring dedup: candidates at recompression boundaries, whole windows compared by 92-bit hashes.

Two levels of recompression name pairs of tokens; a name is a hash of what it stands for, so it is the same in every
document and needs no dictionary. A level's pairing depends on the tokens beside it only, so equal passages have the same
boundaries inside. In every window of 13 words one place is chosen (the least name of the eight words around it, symbol
boundaries before other places). Places whose name occurs in two documents reveal possible repeats; only windows around
these are then compared, by a hash of all their 13 words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaframe.llm.common import U, grams, materialise, mix, signed, slices, small_batches, tidy, with_ids, word_hashes

WINDOW = 13
#: Words on either side of a boundary that its name covers.
SIDE = 4
#: Bits of a place's name that are kept: names only lead to candidates.
PLACE_BITS = U((1 << 52) - 1)
#: Anchors that a worker gathers before it looks for repeats among them.
CHUNK = 800_000
#: mark: twice the word's number in the document, plus 1 if the row is settled where it was made.
_BOUNDARY = "key long, doc_id long, mark int"
#: ... in the windows' rows, with 28 bits of a second hash above it.
_WINDOW = "key long, doc_id long, mark long"


def anchors(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Positions of the chosen boundaries and names by position, for the words h of the texts doc. See the module text."""
    n = len(h)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, U)
    name = np.full(n, np.iinfo(np.uint64).max, U)
    p = np.arange(SIDE, n - SIDE + 1)
    inside = doc[p - SIDE] == doc[p + SIDE - 1]
    around = grams(h, 2 * SIDE) >> U(1)
    same = h[1:] == h[:-1]
    # Runs: a place with equal neighbours in reach isn't a boundary, as a run can go on beyond the window.
    runs = np.cumsum(np.concatenate(([0], same)))
    run = runs[p + SIDE - 1] - runs[p - SIDE] > 0
    left_set = (h >> U(17)) & U(1) == 0
    pair = left_set[:-1] & ~left_set[1:]
    named = mix(h[:-1] * U(0xD6E8FEB86659FD93) + h[1:])
    x = np.where(pair[p - 2], named[p - 2], h[p - 1])
    q = np.minimum(p, n - 2)
    y = np.where(pair[q], named[q], h[p])
    second = lambda s: (mix(s ^ U(0xA0761D6478BD642F)) >> U(23)) & U(1)
    bound = ~pair[p - 1] & ~((second(x) == 0) & (second(y) == 1)) & ~run
    name[p] = np.where(inside, around | np.where(bound, U(0), U(1) << U(63)), np.iinfo(np.uint64).max)
    starts = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
    places = WINDOW - 2 * SIDE + 1
    least = name[starts + SIDE]
    for j in range(1, places):
        np.minimum(least, name[starts + SIDE + j], out=least)
    chosen, left = np.zeros(n + 1, bool), np.ones(len(starts), bool)
    for j in reversed(range(places)):
        hit = left & (name[starts + SIDE + j] == least)
        chosen[starts[hit] + SIDE + j] = True
        left &= ~hit
    at = np.flatnonzero(chosen[:n])
    return at, name[at]


def _settle(later: bool, key: np.ndarray, ids: np.ndarray, pos: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """Rows of a chunk: those of a hash's smallest document keep it as key; the others are settled here, and dealt out apart.

    Settled rows: their hash has several documents in this chunk or, with later, a smaller one.
    """
    order = np.lexsort((ids, more, key))
    key, ids, pos, more = key[order], ids[order], pos[order], more[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (more[1:] != more[:-1])))
    group = np.cumsum(new) - 1
    first = ids[new][group]
    last = ids[np.concatenate((new[1:], [True]))][group]
    follows = ids != first
    # Settled rows of a document go together, and all rows leave in document order: so they compress well.
    key = np.where(follows, mix(mix(ids.view(U))), key)
    more = np.where(follows, 0, more)
    back = np.argsort(order)
    mark = 2 * pos + (follows if later else first != last)
    mark = (more << 32) + mark if later else mark.astype(np.int32)
    return pa.RecordBatch.from_arrays([signed(key[back]), pa.array(ids[back]), pa.array(mark[back])], names=["key", "doc_id", "mark"])


def _flush(parts: list[tuple[np.ndarray, ...]], later: bool = False) -> Iterator[pa.RecordBatch]:
    if any(len(part[0]) for part in parts):
        yield _settle(later, *(np.concatenate(x) for x in zip(*parts, strict=True)))
    parts.clear()


def _boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, ...]] = []
    size = 0
    for piece, texts in slices(batches):
        ids = piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        h, doc, *_ = word_hashes(texts)
        at, name = anchors(h, doc)
        first = np.searchsorted(doc, np.arange(len(texts)))
        parts.append((name & PLACE_BITS, ids[doc[at]], at - first[doc[at]], np.zeros(len(at), np.int64)))
        if (size := size + len(at)) >= CHUNK:
            yield from _flush(parts)
            size = 0
    yield from _flush(parts)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """13-word hashes of the windows around the given boundaries (column 2) of each document."""
    parts: list[tuple[np.ndarray, ...]] = []
    size = 0
    for piece, texts in slices(batches):
        ids = piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        h, doc, *_ = word_hashes(texts)
        n = len(h)
        if n < WINDOW:
            continue
        first = np.searchsorted(doc, np.arange(len(texts)))
        marks = piece.column(2)
        given = marks.flatten().to_numpy(zero_copy_only=False) + np.repeat(first, pa.compute.list_value_length(marks).to_numpy(zero_copy_only=False))
        wanted = np.zeros(n, bool)
        for j in range(SIDE, WINDOW - SIDE + 1):
            wanted[np.maximum(given - j, 0)] = True
        starts = np.flatnonzero(wanted[: n - WINDOW + 1] & (doc[: n - WINDOW + 1] == doc[WINDOW - 1 :]))
        more = grams(mix(h ^ U(0x6A09E667F3BCC909)), WINDOW)[starts] >> U(36)
        parts.append((grams(h, WINDOW)[starts], ids[doc[starts]], starts - first[doc[starts]], more.astype(np.int64)))
        if (size := size + len(starts)) >= CHUNK:
            yield from _flush(parts, True)
            size = 0
    yield from _flush(parts, True)


def _kept(whole: bool):
    """Counts and the digest (or the text, if whole) of the words that remain. Column 2 lists starts of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            counts, gone, out = [], [], []
            for text, marks in zip(texts, piece.column(2), strict=True):
                words = text.split()
                n = len(words)
                if marks.is_valid and n:
                    cover = np.zeros(n + 1, np.int64)
                    at = np.array(marks.values.to_numpy(zero_copy_only=False))
                    np.add.at(cover, at, 1)
                    np.add.at(cover, np.minimum(at + WINDOW, n), -1)
                    keep = np.cumsum(cover[:n]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                counts.append(n)
                gone.append(n - len(words))
                rest = b" ".join(words)
                out.append((rest if gone[-1] else text) if whole else hashlib.sha256(rest).hexdigest())
            cols = [piece.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.binary()).cast(pa.string()) if whole else pa.array(out, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_text" if whole else "kept_sha256"]
            if whole:
                cols += [piece.column(i) for i in range(3, piece.num_columns)]
                names += [piece.schema.names[i] for i in range(3, piece.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, starts): the first words of 13-word windows that also start in a document with a smaller doc_id.

    Places and starts are written as tables, so that the disk holds the shuffle files of one step at a time.
    """
    own = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    found = own.where("text IS NOT NULL").mapInArrow(tidy(_boundaries), _BOUNDARY)
    shared = found.selectExpr("doc_id", "mark", "(mark & 1) = 1 OR min(doc_id) OVER (PARTITION BY key) < max(doc_id) OVER (PARTITION BY key) AS flag").where("flag")
    marks = materialise(shared.groupBy("doc_id").agg(F.collect_list(F.shiftright("mark", 1)).alias("marks")))
    windows = own.join(marks, "doc_id").mapInArrow(tidy(_windows), _WINDOW)
    split = windows.selectExpr("key", "doc_id", "cast(shiftright(mark, 32) AS int) AS more", "cast(mark & 4294967295 AS int) AS mark")
    least = split.selectExpr("doc_id", "mark", "min(doc_id) OVER (PARTITION BY key, more) AS least")
    return materialise(least.where("least < doc_id OR (mark & 1) = 1").groupBy("doc_id").agg(F.collect_list(F.shiftright("mark", 1)).alias("starts")))


def dedup_substrings(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, and kept_sha256, or with whole kept_text and the other columns.

    Words are runs without ASCII white space. A word goes if a window of 13 words over it also starts in a document with
    a smaller doc_id; windows are judged on the input. Null text has no words. A row with null doc_id is compared with
    nothing. doc_id names a document: repeated rows must be equal, and get equal rows. With whole, a text that loses
    nothing stays as it is (null becomes empty); columns of docs named like one of the result give way to it; else the kept words are joined by one space. Empty table: no rows.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_words", "n_removed", "kept_text")] if whole else []
    small_batches(docs.sparkSession)
    docs = with_ids(docs)
    cols = ["doc_id", "text", *[F.col(f"`{c}`") for c in rest]]
    own = docs.select(*cols).where("doc_id IS NOT NULL").join(repeated_windows(docs).withColumnRenamed("starts", "__starts"), "doc_id", "left")
    lone = docs.select(*cols).where("doc_id IS NULL").withColumn("__starts", F.lit(None).cast("array<int>"))
    both = own.unionByName(lone).select("doc_id", "text", "__starts", *[F.col(f"`{c}`") for c in rest])
    schema = f"doc_id long, n_words long, n_removed long, {'kept_text' if whole else 'kept_sha256'} string"
    for c in rest:
        schema += f", `{c}` {docs.schema[c].dataType.simpleString()}"
    return both.mapInArrow(tidy(_kept(whole)), schema)
