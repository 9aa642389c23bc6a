"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct new pieces of a batch lie end to end in one list of symbols. An index maps each pair of neighbours to all
its positions; the ranks that occur are applied in ascending order, each at all its positions, and the lists of the
pairs that appear are extended. A merged symbol's own merges rank later than the merge that made it, so taking the
pieces together gives what each alone would.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from operator import itemgetter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from sylvaframe.llm.common import slices, small_batches, tidy

#: Pieces whose codes a worker gathers in a generation; those of the generation before stay at hand, and those met again move on.
MEMORY = 200_000
#: Pieces that are learned together: their index takes about a kilobyte each.
TOGETHER = 4_000
# The pattern that splits text into pieces before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes for themselves, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return letters | {chr(256 + i): b for i, b in enumerate(hidden)}


def plane_pattern() -> str:
    """PATTERN with its properties spelled out as ranges of the first 65,536 code points, for the faster matcher."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    ranges = {p: "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for m in regex.findall(f"{p}+", every) for run in _runs(m)) for p in (r"\s", r"\p{L}", r"\p{N}")}
    out = PATTERN.replace(r"\S", f"[^{ranges[chr(92) + 's']}]")
    out = out.replace(r"[^\s\p{L}\p{N}]", f"[^{''.join(ranges.values())}]")
    for p, found in ranges.items():
        out = out.replace(p, f"[{found}]")
    return out


def _runs(chars: str) -> Iterator[str]:
    """Pieces of ascending characters without a gap in their code points (the surrogates make one)."""
    at = 0
    for i in range(1, len(chars) + 1):
        if i == len(chars) or ord(chars[i]) != ord(chars[i - 1]) + 1:
            yield chars[at:i]
            at = i


class Codec:
    """Vocabulary, merges and remembered pieces. spec: the bytes of a tokenizer's JSON file (byte-level BPE)."""

    def __init__(self, spec: bytes):
        import regex

        told = json.loads(spec)
        vocab = told["model"]["vocab"]
        letters = byte_letters()
        self.size = max(vocab.values()) + 1
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.base = [0] * 256
        for c, b in letters.items():
            self.base[b] = vocab[c]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        self.pairs: list[int] = []
        for r, pair in enumerate(told["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] * self.size + vocab[b]] = r
            self.pairs.append(vocab[a] * self.size + vocab[b])
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.find_any, self.find_plane = regex.compile(PATTERN).findall, re.compile(plane_pattern()).findall
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        #: Bytes by id as it is written, and the ids of pieces, joined by commas: one string a piece, as there are many.
        self.spelled = {str(i): b for i, b in self.bytes.items()}
        self.known: dict[str | tuple[str], str] = {}
        self.older: dict[str | tuple[str], str] = {}

    def find(self, text: str) -> list[str]:
        """The pieces of a text. Code points past the first 65,536 take the slower matcher."""
        if text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text):
            return self.find_plane(text)
        return self.find_any(text)

    def learn(self, pieces: list[str]) -> None:
        """Encode and remember distinct new pieces. The index's many lists hold no cycles, so nothing is gained by collecting among them."""
        was = gc.isenabled()
        gc.disable()
        try:
            for at in range(0, len(pieces), TOGETHER):
                self._learn(pieces[at : at + TOGETHER])
        finally:
            if was:
                gc.enable()

    def _learn(self, pieces: list[str]) -> None:
        sym: list[int] = []
        base, rank, size = self.base, self.rank, self.size
        for p in pieces:
            sym.extend([base[b] for b in p.encode()])
            sym.append(-1)
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        where: dict[int, list[int]] = {}
        for i in range(n - 1):
            a, b = sym[i], sym[i + 1]
            if a >= 0 and b >= 0 and (r := rank.get(a * size + b)) is not None:
                if r in where:
                    where[r].append(i)
                else:
                    where[r] = [i]
        active = list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            pair, new = self.pairs[r], self.made[r]
            a, b = divmod(pair, size)
            for i in sorted(where.pop(r)):
                j = after[i]
                if sym[i] != a or j >= n or sym[j] != b:
                    continue
                sym[i], sym[j] = new, -2
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if (c := sym[k]) >= 0 and (x := rank.get(new * size + c)) is not None:
                        if x in where:
                            where[x].append(i)
                        else:
                            where[x] = [i]
                            heapq.heappush(active, x)
                if (h := before[i]) >= 0 and (c := sym[h]) >= 0 and (x := rank.get(c * size + new)) is not None:
                    if x in where:
                        where[x].append(h)
                    else:
                        where[x] = [h]
                        heapq.heappush(active, x)
        i, known = 0, self.known
        for p in pieces:
            ids = []
            while sym[i] != -1:
                ids.append(sym[i])
                i = after[i]
            i = after[i]
            known[p] = ",".join(map(str, ids))

    def decode(self, ids: list[str]) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(itemgetter(*ids)(self.spelled)) if len(ids) > 1 else b"".join([self.spelled[i] for i in ids])

    def encode(self, texts: list[str]) -> Iterator[tuple[str, int, bytes]]:
        """Ids joined by commas, their number, and the decoded bytes, of each text."""
        if len(self.known) > MEMORY:
            self.older, self.known = self.known, {}
        cut = []
        for text in texts:
            if self.special and any(t in text for t in self.special):
                pieces = []
                for part in self.split(text):
                    pieces += [(part,)] if part in self.special else self.find(part)
                cut.append(pieces)
            else:
                cut.append(self.find(text))
        new = set().union(*cut).difference(self.known) if cut else set()
        met = new.intersection(self.older)
        self.known |= {p: self.older[p] for p in met}
        new -= met
        self.learn([p for p in new if isinstance(p, str)])
        for p in new:
            if isinstance(p, tuple):
                self.known[p] = str(self.special[p[0]])
        for pieces in cut:
            joined = ",".join(itemgetter(*pieces)(self.known)) if len(pieces) > 1 else "".join([self.known[p] for p in pieces])
            ids = joined.split(",") if joined else []
            yield joined, len(ids), self.decode(ids)


def _coded(spec: bytes, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(spec)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for piece, texts in slices(batches):
            ids, counts, decoded = [], [], []
            for joined, n, spelled in codec.encode([t.decode("utf-8", "replace") for t in texts]):
                counts.append(n)
                back = spelled.decode("utf-8", "replace")
                ids.append(sha(joined.encode()) if digest else [int(x) for x in joined.split(",") if x])
                decoded.append(sha(back.encode()) if digest else back)
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "n_tokens", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string() if digest else pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=names)

    return run


def bpe(docs: DataFrame, vocabulary: str, digest: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids array<int>, decoded string; with digest ids_sha256 and decoded_sha256 instead.

    vocabulary: path of a byte-level BPE tokenizer's JSON file, read on the driver. Null text is empty and has no ids;
    special tokens in a text are encoded as such. Rows don't depend on one another: repeated rows, null doc_ids and
    other columns change nothing. Empty table: no rows.
    """
    spec = Path(vocabulary).read_bytes()
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")
    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(tidy(_coded(spec, digest)), schema)
