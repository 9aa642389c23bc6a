"""N-gram Jaccard join by universe partition and the pigeonhole principle.

Two sets that link differ in at most H members, where H follows from the larger size. For each band of sizes all
possible members are dealt by hash into segments, which are indexed in pieces of three kinds: a segment alone (missed by
one difference), each two of three segments (missed by two) and a segment with its one-deletion neighbours (missed by
two). Pieces are allotted per band by a cost model so that H + 1 + E differences are needed to miss them all, so pieces
of a weight of E + 1 are found in both sets. E is chosen so that few sets have a greater weight of pieces without
members; two of those may agree in such pieces only, so they are dealt anew by another hash (in the last of several
tries, they index pieces without members), which keeps the search exact. Shingles that many documents share are left
out of the first try, so that a common passage doesn't bring its documents together.

Texts of equal words are one class, named by a SHA-256 of the words; only its smallest document is indexed. A key leads each of its documents to the smallest one
only, not to all pairs; candidates are verified on the words. Where a key's documents then lie in several components,
those outside the largest are held against all of the key's by sizes and parity sketches, in blocks of bounded size,
and components that may link become a family. In each family, again in blocks, sets are held against sets; of these
pairs only links that join components come out of a task, and are verified on the words too.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvaframe.llm.common import FEW, U, grams, materialise, mix, only, signed, slices, small_batches, tidy, with_ids, without, word_hashes

N = 4
#: Links: 100 * intersection >= 85 * union.
SHARE = 85
#: A band's last size over its first.
BAND = 1.5
#: Keys that a worker gathers before it looks for equal ones among them.
CHUNK = 400_000
#: Shingles for each bucket of keys, and the bits by which keys of a bucket are told apart.
BUCKET, KEY_BITS = 1_000_000, 40
LOW = U((1 << KEY_BITS) - 1)
#: Shingles, in all, of the texts that are verified against one other text in a group.
GROUP = 200_000
#: Cost of a candidate's verification, in keys.
VERIFY = 30.0
#: Sets with a greater weight than E of pieces without members are dealt again by another hash, TRIES times in all.
TRIES = 4
#: Shingles that HOT_DOCS of each HOT_OF documents have, of all counted, at most HOT of them, are left out of the first try.
#: Which ones these are changes the cost only: two sets differ no more without them than with them.
HOT_OF, HOT_DOCS, HOT = 20_000, 3, 100_000
#: Such a part of a set is reckoned to be other shingles.
OTHER = 1.0
#: Documents of a key that are held against as many others in one group.
BLOCK = 256
#: Rows of a class are dealt among so many parts before they meet their class.
SALTS = 128
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(_UPPER, _LOWER)


#: Bands worked out so far, by share.
_PLANS: dict[int, list[tuple[int, int, int, int, int, int]]] = {}


def _spare(single: int, triple: int, double: int, members: float) -> int:
    """A weight that the pieces without members of few sets exceed: mean and three deviations."""
    none = math.exp(-members / (single + 3 * triple + double))
    found = ((single, 1, none), (triple, 2, none * none * (3 - 2 * none)), (double, 2, min(1.0, none * (1 + members / (single + 3 * triple + double)))))
    mean = sum(n * w * p for n, w, p in found)
    return math.ceil(mean + 3 * math.sqrt(sum(n * w * w * p * (1 - p) for n, w, p in found)))


def bands(largest: int, share: int = SHARE) -> list[tuple[int, int, int, int, int, int]]:
    """(first size, size after the last, single segments, threes of segments, segments with deletions, E) of each band, up to the size `largest`."""
    out = _PLANS.setdefault(share, [])
    lo = out[-1][1] if out else 1
    while lo <= largest:
        hi = math.floor(lo * max(BAND, 100 / share)) + 1
        apart = 2 * (hi - 1) * (100 - share) // (100 + share)
        least = max(1, math.ceil(lo * share / 100))
        best = (math.inf, 1, 0, 0, 0)
        for triple, double in [(0, 0)] + [(t, 0) for t in (1, 2, 4, 8) if 2 * t <= apart] + [(0, d) for d in (1, 2, 4, 8) if 2 * d <= apart + 1]:
            extra = 0
            for _ in range(8):  # E raises the number of segments, which raises E
                single = max(0, apart + 1 + extra - 2 * (triple + double))
                need = 0 if not apart else _spare(single, triple, double, least * OTHER)
                if need <= extra or need > 2 * apart + 8:
                    break
                extra = need
            parts = single + 3 * triple + double
            mean = least / parts
            # Keys, and candidates by chance: sets share a piece of few members by accident.
            keys = single + 3 * triple + double * (1 + hi / parts)
            chance = single * math.exp(-mean) + 3 * triple * math.exp(-2 * mean) + double * math.exp(1 - mean)
            best = min(best, (keys + VERIFY * chance, single, triple, double, extra))
        out.append((lo, hi, *best[1:]))
        lo = hi
    return [b for b in out if b[0] <= largest]


def shingle_sets(texts: list[bytes], size: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text and the text's number, sorted by both."""
    h, doc, *_ = word_hashes(texts, lower=True)
    if not len(h):
        return np.zeros(0, U), np.zeros(0, np.int64)
    counts = np.bincount(doc, minlength=len(texts))
    g = grams(h, size)
    at = np.flatnonzero(doc[: len(g)] == doc[size - 1 :]) if len(g) else np.zeros(0, np.int64)
    parts, owners = [g[at]], [doc[at]]
    firsts = np.cumsum(counts) - counts
    for short in range(1, size):
        those = np.flatnonzero(counts == short)
        if len(those):
            whole = grams(h, short)[firsts[those]]
            parts.append(mix(whole + U(short)))
            owners.append(those)
    g, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])))
    return g[new], owner[new]


#: Columns of a set's parity sketch.
SKETCH = tuple(f"s{i}" for i in range(8))


def odd(g: np.ndarray, owner: np.ndarray, n_texts: int) -> list[pa.Array]:
    """512 parities of each set's members by bucket. Two sets differ in at least as many members as parities."""
    bits = 64 * len(SKETCH)
    count = np.bincount(owner * bits + (mix(g ^ U(0x2545F4914F6CDD1D)) % U(bits)).astype(np.int64), minlength=n_texts * bits)
    packed = np.packbits((count & 1).astype(np.uint8).reshape(n_texts, bits), axis=1).view(np.int64)
    return [pa.array(np.ascontiguousarray(packed[:, i])) for i in range(len(SKETCH))]


def can_link(x: str, y: str, share: int) -> str:
    """SQL: whether the sizes and sketches of x and y (prefixes of columns) allow a link. It never denies one that exists."""
    apart = " + ".join(f"bit_count({x}{c} ^ {y}{c})" for c in SKETCH)
    return f"100 * least({x}n, {y}n) >= {share} * greatest({x}n, {y}n) AND ({apart}) * {100 + share} <= ({x}n + {y}n) * {100 - share}"


def _folded(text: bytes) -> bytes:
    """The text's words in lower case (A-Z), joined by one space."""
    return b" ".join(text.translate(_FOLD).split())


def _sizes(words: int):
    """doc_id, set size, the SHA-256 of the folded words, parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            g, owner = shingle_sets(texts, words)
            n = np.bincount(owner, minlength=len(texts))
            names = pa.array([hashlib.sha256(_folded(t)).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n), names, *odd(g, owner, len(texts))], names=["doc_id", "n", "name", *SKETCH])

    return run


def set_keys(g: np.ndarray, owner: np.ndarray, n_texts: int, share: int = SHARE, hot: np.ndarray | None = None, buckets: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sets and the text of each key."""
    n = np.bincount(owner, minlength=n_texts)
    keys, whose = [], []
    plan = bands(int(n.max(initial=0) * 100 / share) + 1, share)
    lows, ends, alone, threes, doubles, spare = (np.array(x) for x in zip(*plan, (1 << 60, 1 << 60, 1, 0, 0, 0), strict=True))
    band = np.searchsorted(ends, n, side="right")
    rare = np.ones(len(g), bool)
    if hot is not None and len(hot):
        low = g % span(buckets)
        rare = hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] != low
    # A set meets larger ones in its own band or the next, as no band is narrower than the sizes that can link.
    for step in (0, 1):
        k = np.minimum(band + step, len(plan))
        takes = (n > 0) & (n * 100 >= lows[k] * share)
        for again in range(TRIES):
            m = np.where(takes, alone[k] + 3 * threes[k] + doubles[k], 0)
            total = int(m.sum())
            if not total:
                break
            member = takes[owner] & (rare | (again > 0))
            mine, x = owner[member], g[member]
            first = np.cumsum(m) - m
            seg = first[mine] + (mix(x ^ U(0x8EBC6AF09C88C6E3 + again)) % m[mine].astype(U)).astype(np.int64)
            order = np.argsort(seg, kind="stable")
            sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(x[order]))))
            size = np.bincount(seg, minlength=total)
            to = np.cumsum(size)
            content = sums[to] - sums[to - size]
            text = np.repeat(np.arange(n_texts), m)
            number = np.arange(total) - first[text]
            # A set's segments: first those with deletions, then threes, then single ones.
            double = number < doubles[k][text]
            three = ~double & (number < (doubles + 3 * threes)[k][text])
            lead = np.flatnonzero(three & ((number - doubles[k][text]) % 3 == 0))
            tag = mix(((k[text] * TRIES + again).astype(U) << U(32)) + number.astype(U))
            # Weak sets may agree with others in pieces without members (or, with deletions, of one) alone.
            lacks = np.where(double, 2 * (size <= 1), size == 0) * ~three
            lacks[lead] = 2 * ((size[lead] == 0).astype(int) + (size[lead + 1] == 0) + (size[lead + 2] == 0) >= 2)
            weak = takes & (np.bincount(text, weights=lacks, minlength=n_texts) > spare[k])
            rescue = weak & (again == TRIES - 1)
            keys.append(mix(content ^ tag)[use := ~three & ((size > 0) | rescue[text])])
            whose.append(text[use])
            for i, j in ((0, 1), (0, 2), (1, 2)):
                two = lead[(size[lead + i] + size[lead + j] > 0) | rescue[text[lead]]]
                keys.append(mix(mix(content[two + i] ^ tag[two + i]) + U(2) * mix(content[two + j] ^ tag[two + j])))
                whose.append(text[two])
            cut = double[seg] & ((size[seg] > 1) | rescue[mine])
            keys.append(mix((content[seg[cut]] - mix(x[cut])) ^ tag[seg[cut]]))
            whose.append(mine[cut])
            takes = weak
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(whose)


def _index(share: int, words: int, hot: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for piece, texts in slices(batches):
            ids = piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            key, text = set_keys(*shingle_sets(texts, words), len(texts), share, hot, buckets)
            parts.append((key, ids[text]))
            if (size := size + len(key)) >= CHUNK:
                yield _settle(parts, buckets)
                size = 0
        if parts:
            yield _settle(parts, buckets)

    return run


def _members(words: int, buckets: int):
    """Rows (bucket, rows) of how many of a chunk's documents each shingle is in, by the low bits of the shingles."""

    def told(parts: list[np.ndarray]) -> pa.RecordBatch:
        g, n = np.unique(np.concatenate(parts), return_counts=True)
        rows = [(b, _packed(k, x & LOW)) for b, k, x in _by_part((g >> U(KEY_BITS)).astype(np.int64), n, g)]
        at, packed = zip(*rows, strict=True) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for _, texts in slices(batches):
            parts.append(shingle_sets(texts, words)[0] % span(buckets))
            if sum(map(len, parts)) >= CHUNK:
                yield told(parts)
                parts = []
        if parts:
            yield told(parts)

    return run


def _totals(least: int):
    """(g, n): the shingles that at least so many documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _held(batches):
            n, low = (np.concatenate(x) for x in zip(*map(_unpacked, blobs), strict=True))
            order = np.argsort(low, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], low[order][1:] != low[order][:-1])))
            total, g = np.add.reduceat(n[order], first), low[order][first] | U(bucket << KEY_BITS)
            yield pa.RecordBatch.from_arrays([signed(g[total >= least]), pa.array(total[total >= least])], names=["g", "n"])

    return run


def span(buckets: int) -> U:
    """How many keys or shingles the buckets tell apart."""
    return U(buckets) << U(KEY_BITS)


def hot_shingles(docs: DataFrame, total: int, words: int, buckets: int) -> np.ndarray:
    """Common shingles modulo span(buckets), in order: those of all the docs are counted, and the HOT commonest are taken."""
    least = max(HOT_DOCS, -(-total * HOT_DOCS // HOT_OF))
    own = docs.mapInArrow(tidy(_members(words, buckets)), "bucket int, rows binary").repartition("bucket").sortWithinPartitions("bucket")
    found = materialise(own.mapInArrow(tidy(_totals(least)), "g long, n long"))
    return np.sort(np.array([r["g"] for r in found.orderBy(F.desc("n"), "g").limit(HOT).collect()], np.int64).view(U))


def _packed(ids: np.ndarray, low: np.ndarray) -> bytes:
    """Ids in order as their steps, in as few bytes as the widest takes, and the KEY_BITS low bits of the keys: small, so that little is shuffled."""
    step = np.diff(ids.view(U), prepend=ids[:1].view(U))
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(step.max()) < 1 << 8 * w)
    head = np.array([len(ids), width, ids[0]], np.int64).tobytes()
    return head + low.view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].tobytes() + step.astype(f"<u{width}").tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the low bits of the keys that _packed was given."""
    n, width, first = np.frombuffer(blob, np.int64, 3).tolist()
    wide = KEY_BITS // 8
    low = np.zeros((n, 8), np.uint8)
    low[:, :wide] = np.frombuffer(blob, np.uint8, n * wide, 24).reshape(n, wide)
    step = np.frombuffer(blob, f"<u{width}", n, 24 + n * wide).astype(U)
    return (np.cumsum(step) + np.array([first]).view(U)).view(np.int64), low.reshape(-1).view(U)


def _by_part(part: np.ndarray, *rest: np.ndarray) -> Iterator[tuple]:
    """Each part's number and its pieces of the columns, in the order of the first of these."""
    order = np.lexsort((rest[0], part))
    part, cols = part[order], [x[order] for x in rest]
    cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        if e > s:
            yield int(part[s]), *[x[s:e] for x in cols]


def _settle(parts: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """Rows (bucket, rows) of a chunk's keys: below `buckets` a key's smallest document, by key; from there on the others with it, dealt out by document.

    Keys are cut to KEY_BITS bits in a bucket. Two that fall together lead to a candidate more, not to a link.
    """
    key, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    key = key % span(buckets)
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
    fresh = new | np.concatenate(([True], ids[1:] != ids[:-1]))[: len(key)]
    first = ids[new][np.cumsum(new) - 1]
    key, ids, first = key[fresh], ids[fresh], first[fresh]
    follows = first != ids
    head = [(b, _packed(i, k & LOW)) for b, i, k in _by_part((key[~follows] >> U(KEY_BITS)).astype(np.int64), ids[~follows], key[~follows])]
    dealt_out = buckets + (mix(ids[follows].view(U)) % U(buckets)).astype(np.int64)
    rest = [(b, np.concatenate((k.view(np.int64), i, f)).tobytes()) for b, i, k, f in _by_part(dealt_out, ids[follows], key[follows], first[follows])]
    at, rows = zip(*head, *rest, strict=True) if head or rest else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "rows"])


def _star(bucket: int, blobs: list[bytes], buckets: int) -> pa.RecordBatch:
    """Edges from a bucket's documents to the smallest one of their key, or those that _settle has found."""
    if bucket < buckets:
        ids, low = (np.concatenate(x) for x in zip(*map(_unpacked, blobs), strict=True))
        key = (low | U(bucket << KEY_BITS)).view(np.int64)
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = ids[new][np.cumsum(new) - 1]
    else:
        key, ids, first = np.concatenate([np.frombuffer(x, np.int64).reshape(3, -1) for x in blobs], axis=1)
        order = np.lexsort((first, ids, key))
        key, ids, first = key[order], ids[order], first[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]) | (first[1:] != first[:-1]))) & (first != ids)
    return pa.RecordBatch.from_arrays([pa.array(x[fresh]) for x in (key, ids, first)], names=["key", "doc_id", "first"])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Each bucket and its rows, of batches (bucket, rows) sorted by bucket."""
    held: list[bytes] = []
    last = -1
    for batch in batches:
        for now, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and now != last:
                yield last, held
                held = []
            last = now
            held.append(blob)
    if held:
        yield last, held


def _stars(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _held(batches):
            yield _star(bucket, blobs, buckets)

    return run


def _shingles(text: bytes, size: int = N) -> set:
    words = text.translate(_FOLD).split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def _verify(share: int, words: int):
    def run(group):
        import pandas as pd

        ids = []
        own = group[group["other"].isna()]
        if len(own):
            mine = _shingles(own["text"].iloc[0].encode(), words)
            for i, text in group.loc[group["other"].notna(), ["other", "text"]].itertuples(index=False):
                other = _shingles(text.encode(), words)
                both = len(mine & other)
                if both and 100 * both >= share * (len(mine) + len(other) - both):
                    ids.append(int(i))
        return pd.DataFrame({"a": pd.Series([group["a"].iloc[0]] * len(ids), dtype="int64"), "b": pd.Series(ids, dtype="int64")})

    return run


def verified(docs: DataFrame, pairs: DataFrame, share: int, words: int) -> DataFrame:
    """Those of the distinct pairs (a, b, n2) whose sets link; n2: b's size. Texts go to a's side once, in groups of about GROUP shingles."""
    own = only(docs.select("doc_id", "text"), materialise(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()))
    per = materialise(pairs.groupBy("a").agg(F.sum("n2").alias("n")))
    groups = f"cast(ceil(n / {GROUP}) as int)"
    right = pairs.join(per, "a").selectExpr("b AS doc_id", "a", f"pmod(xxhash64(b), {groups}) AS salt", "b AS other")
    left = per.selectExpr("a AS doc_id", "a", f"explode(sequence(0L, cast({groups} - 1 AS long))) AS salt", "cast(NULL AS long) AS other")
    return own.join(right.union(left), "doc_id").select("a", "salt", "other", "text").groupBy("a", "salt").applyInPandas(_verify(share, words), "a long, b long")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over the edges (a, b). Smallest neighbours and pointer jumping, to a fixed point."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    label = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a AS id", "least(a, m) AS component")
    label = materialise(label)
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        step = label.join(near.withColumnRenamed("a", "id"), "id").selectExpr("id", "least(component, m) AS component", "component AS was")
        jump = step.select(F.col("id").alias("t"), F.col("component").alias("up"))
        new = materialise(step.join(jump, F.col("component") == F.col("t")).selectExpr("id", "least(component, up) AS component", "was"))
        done = new.where("component <> was").limit(1).count() == 0
        label = new.select("id", "component")
        if done:
            return label


def _short(words: int, seed: int):
    """doc_id and the document's set as 32-bit hashes, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            g, owner = shingle_sets(texts, words)
            cut = np.searchsorted(owner, np.arange(len(texts) + 1))
            h = (mix(g ^ U(seed)) & U(0xFFFFFFFF)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([np.sort(h[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["d", "members"])

    return run


def _parities(sets: list[np.ndarray]) -> np.ndarray:
    bits = 64 * len(SKETCH)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    count = np.bincount(owner * bits + np.concatenate(sets).astype(np.int64) % bits, minlength=len(sets) * bits)
    return np.packbits((count & 1).astype(np.uint8).reshape(len(sets), bits), axis=1).view(U)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each group (columns grp, block, chunk), of batches that are sorted by these."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
        cut = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            now = tuple(marks[:, a].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _candidates(batch: pa.RecordBatch, n: np.ndarray, odds: np.ndarray, comp: np.ndarray, share: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each guest of a group with the hosts that sizes and sketches allow, and that are in other components as it is reached."""
    guest = _numbers(batch, "guest").astype(bool)
    hosts = np.flatnonzero(~guest)
    n_hosts, odd_hosts = n[hosts], odds[hosts]
    for i in np.flatnonzero(guest).tolist() if len(hosts) else []:
        sizes = 100 * np.minimum(n_hosts, n[i]) >= share * np.maximum(n_hosts, n[i])
        apart = np.bitwise_count(odd_hosts ^ odds[i]).sum(1, dtype=np.int64)
        left = hosts[sizes & (comp[hosts] != comp[i]) & (apart * (100 + share) <= (n_hosts + n[i]) * (100 - share))]
        if len(left):
            yield i, left


def _may(share: int):
    """Components (a, b) of a group that may link, as many as join these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches):
            comp = _numbers(batch, "c").astype(np.int64)
            now, out = comp.copy(), []
            odds = np.stack([_numbers(batch, c).astype(np.int64) for c in SKETCH], axis=1).view(U)
            for i, left in _candidates(batch, _numbers(batch, "n").astype(np.int64), odds, now, share):
                for j in left.tolist():
                    if now[j] != now[i]:
                        out.append((comp[i], comp[j]))
                        now[now == now[j]] = now[i]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    return run


def _cross(share: int):
    """Links (a, b, n2) between documents of a group in different components, as many as join these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches):
            ids, comp = _numbers(batch, "d").astype(np.int64), _numbers(batch, "c").astype(np.int64).copy()
            sets = [np.frombuffer(x, np.uint32) for x in batch.column(batch.schema.get_field_index("members")).to_pylist()]
            n, out = np.array([len(x) for x in sets], np.int64), []
            for i, left in _candidates(batch, n, _parities(sets), comp, share):
                while len(left):
                    some, left = left[:32], left[32:]
                    flat = np.concatenate([sets[j] for j in some])
                    at = np.minimum(np.searchsorted(sets[i], flat), n[i] - 1)
                    both = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.cumsum(n[some]) - n[some])
                    for j in some[100 * both >= share * (n[i] + n[some] - both)].tolist():
                        if comp[j] != comp[i]:
                            out.append((min(ids[i], ids[j]), max(ids[i], ids[j]), n[i] if ids[i] > ids[j] else n[j]))
                            comp[comp == comp[j]] = comp[i]
                    left = left[comp[left] != comp[i]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b", "n2"])

    return run


def dealt(rows: DataFrame, *rest: str) -> DataFrame:
    """Blocks of the groups `grp` of documents d in components c: grp, block, chunk, d, c, guest and the columns `rest`.

    Every two documents of a group in different components meet in a block, one of them as a guest; a block has about BLOCK
    hosts and as many guests at most. Guests are those outside the group's largest component.
    """
    sizes = rows.groupBy("grp", "c").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.max("n").alias("n"), F.sum("n").alias("g"))
    plan = materialise(sizes.where("g > n").selectExpr("grp", "main", f"cast(ceil(g / {BLOCK}) AS int) AS blocks", f"cast(ceil((g - n) / {BLOCK}) AS int) AS chunks"))
    both = rows.join(plan, "grp")
    hosts = both.select("grp", F.expr("cast(pmod(xxhash64(d), blocks) AS int) AS block"), F.expr("explode(sequence(0, chunks - 1)) AS chunk"), "d", "c", F.lit(False).alias("guest"), *rest)
    guests = both.where("c <> main").select("grp", F.expr("explode(sequence(0, blocks - 1)) AS block"), F.expr("cast(pmod(xxhash64(d), chunks) AS int) AS chunk"), "d", "c", F.lit(True).alias("guest"), *rest)
    return hosts.union(guests).repartition("grp", "block", "chunk").sortWithinPartitions("grp", "block", "chunk")


def joining(docs: DataFrame, mapped: DataFrame, size: DataFrame, label: DataFrame, share: int, words: int, seed: int) -> DataFrame:
    """Candidate pairs (a, b, n2) that join components, by 32-bit hashes, from keys (key, a, b) whose documents lie in several.

    Each link that there is between documents of one key is among them or joins what they have joined. Keys with the same
    documents (by a 128-bit signature) are looked at once. A key with two documents has been tried as a pair.
    """
    spread = mapped.select("key", F.explode(F.array("a", "b")).alias("d")).distinct()
    spread = spread.join(label.withColumnRenamed("id", "d"), "d", "left").selectExpr("key", "d", "coalesce(component, d) AS c")
    signed_keys = spread.groupBy("key").agg(F.count("*").alias("g"), F.min("c").alias("low"), F.max("c").alias("high"), F.bit_xor(F.xxhash64("d")).alias("x"), F.bit_xor(F.xxhash64("d", F.lit(1))).alias("y"))
    open_keys = signed_keys.where("g > 2 AND low <> high").groupBy("g", "x", "y").agg(F.min("key").alias("key")).select("key")
    rows = materialise(spread.join(open_keys, "key").join(size.withColumnRenamed("doc_id", "d"), "d").withColumnRenamed("key", "grp"))
    may = dealt(rows, "n", *SKETCH).mapInArrow(tidy(_may(share)), "a long, b long").distinct()
    family = components(docs.sparkSession, may).selectExpr("id AS c", "component AS grp")
    near = materialise(rows.select("d", "c").distinct().join(family, "c"))
    short = only(docs, near.select(F.col("d").alias("doc_id"))).dropDuplicates(["doc_id"]).select("doc_id", "text").mapInArrow(tidy(_short(words, seed)), "d long, members binary")
    return dealt(near.join(short, "d"), "members").mapInArrow(tidy(_cross(share)), "a long, b long, n2 long").distinct()


def jaccard_components(docs: DataFrame, share: int = SHARE, n: int = N) -> DataFrame:
    """Per row of docs: doc_id, n_shingles and component_id (the smallest doc_id that links lead to).

    A-Z count as a-z; words are runs without ASCII white space; sets that share 100 * intersection >= share * union link;
    a set holds the distinct shingles of n words, or the whole sequence if there are fewer words. No words or null text:
    empty, linked with nothing. A row with null doc_id links with nothing and has a null component. doc_id names a
    document: repeated rows must be equal, and get equal rows. Components are whole; not every link within one is sought.
    Other columns have no influence. Empty table: no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = with_ids(docs)
    own = docs.select("doc_id", "text")
    sets = materialise(own.mapInArrow(tidy(_sizes(n)), "doc_id long, n long, name binary, " + ", ".join(f"{c} long" for c in SKETCH)))
    salt = f"pmod(xxhash64(doc_id), {SALTS}) AS salt"
    named = sets.where("n > 0 AND doc_id IS NOT NULL").selectExpr("doc_id", "name", "n AS size", salt)
    parts = named.groupBy("name", "salt").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    classes = parts.groupBy("name").agg(F.min("least").alias("rep"), F.sum("n").alias("n")).where("n > 1").select("name", "rep")
    # A class can hold a third of all rows: these meet it by name and salt, of which a class has SALTS at most.
    parts = materialise(parts.select("name", "salt").join(classes, "name"))
    copies = materialise(named.join(parts, ["name", "salt"]).where("doc_id <> rep").select("doc_id", "size").distinct())
    # A class's smallest document stands for all of it: however many copies there are, its keys are made and shuffled once.
    known = without(own.where("doc_id IS NOT NULL AND text IS NOT NULL"), copies)
    (rows, total), (others, fewer) = (x.agg(F.count("*"), F.coalesce(F.sum(c), F.lit(0))).first() for x, c in ((sets, "n"), (copies, "size")))
    if others > FEW:
        known = materialise(known)
    buckets = max(1, -(-(total - fewer) // BUCKET))
    hot = hot_shingles(known, rows - others, n, buckets)
    # A chunk's smallest document of a key meets those of the other chunks; the rest were led to it in their chunk.
    index = known.mapInArrow(tidy(_index(share, n, hot, buckets)), "bucket int, rows binary").repartition("bucket").sortWithinPartitions("bucket")
    star = materialise(index.mapInArrow(tidy(_stars(buckets)), "key long, doc_id long, first long"))
    mapped = star.selectExpr("key", "least(doc_id, first) AS a", "greatest(doc_id, first) AS b")
    size = sets.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", *SKETCH).dropDuplicates(["doc_id"])
    two = mapped.select("a", "b").distinct()
    for side, prefix in (("a", "x"), ("b", "y")):
        two = two.join(size.selectExpr(f"doc_id AS {side}", *[f"{c} AS {prefix}{c}" for c in ("n", *SKETCH)]), side)
    links = materialise(verified(docs, materialise(two.where(can_link("x", "y", share)).select("a", "b", F.col("yn").alias("n2"))), share, n))
    label = components(spark, links)
    seed = 0
    while True:
        seed += 1
        more = materialise(joining(own, mapped, size, label, share, n, seed))
        if not (told := more.count()):
            break
        found = materialise(verified(docs, more, share, n))
        links = links.union(found)
        label = components(spark, links)
        # A pair that only its hashes link may have stood in for a link: then all is tried again by another hash.
        if found.count() == told:
            break
    reached = parts.join(label.withColumnRenamed("id", "rep"), "rep", "left").selectExpr("name", "salt", "coalesce(component, rep) AS of_class")
    out = sets.selectExpr("doc_id", "n", "name", salt).join(reached, ["name", "salt"], "left").join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.selectExpr("doc_id", "n AS n_shingles", "IF(n > 0, coalesce(of_class, component, doc_id), doc_id) AS component_id")
