"""HTML extraction by equivalence classes of template tokens.

A token is an element's path of structural tags, or a block of text with its path. Its occurrence vector over the pages
of a host is kept as counts and an exclusive-or of hashes of (page, occurrences), which parts of a host can be merged
from: tokens with equal sums have equal vectors and form a class. Classes that most pages have are valid; those of paths
that stand once on each page are the template's regions, nested by their paths, and blocks of text in classes that hold
enough text not to be chance are the template's own text. What isn't the template's fills the slots: the innermost
region that holds most of this text, over all pages of the host, is the article's slot, and the pages' text in it is
returned, without the template's text and the parts that are menus, comments and the like. Elements' names tell the
slot only where a host has too few pages for classes.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Container, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaframe.llm.common import mix, U, materialise, slices
from sylvaframe.llm.url_filter import host_path

#: A class is valid if it occurs on such a part of the host's pages.
SUPPORT = 0.5
#: Text is the template's if its class is on so many pages at least ...
TEXT_PAGES = 3
#: ... and the letters of the class's text times its pages but one come to so many.
EVIDENCE = 100
#: A region is the slot if it holds such a part of the text that isn't the template's.
MOST = 0.6
#: The table of slots is broadcast up to so many hosts; beyond, pages and slots are joined by salted host.
BROADCAST_HOSTS = 20_000
SALTS = 64
# Elements by what they mean for the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
DROPPED = frozenset("noscript template iframe svg math object canvas select option button".split())
#: A start tag of the same kind ends these.
FLAT = frozenset("iframe noscript canvas select button".split())
BLOCKS = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
OUT = frozenset("nav footer aside form menu dialog".split())
SELF_CLOSING = {"p": frozenset("p".split()), "li": frozenset("li".split()), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "tr": frozenset("tr".split()), "td": frozenset("td th".split()), "th": frozenset("td th".split())}
OUT_NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments commentlist respond disqus reply replies discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup subscription share sharing social related recommended footer masthead toolbar pagination pager skip login search widget".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Words that may stand beside these in a name; any other word makes the name one of the article's.
BESIDE = frozenset("site page top bottom left right center middle wrapper wrap container box area bar slot list item block section primary secondary global header inner outer content post article header unit text inline mobile desktop".split())
MAIN_NAMES = frozenset("article post entry content story main body".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!(?!--)[^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_KNOWN = frozenset("class id role hidden aria-hidden".split())
_NAME = re.compile(r"[a-z]+")
#: Elements that hold a piece of text, not a region.
_HOLDER = re.compile(r"(^|/)(p|li|dt|dd|h\d|td|th|blockquote|pre|figcaption|caption|summary)(\.[^/]*)?$")
_OPTION_ENDS = frozenset("option optgroup select datalist".split())
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}


def _kind(tag: str, attrs: str, inside: bool) -> tuple[str, bool, bool]:
    """Token of an element, whether its text is left out, whether its name says it holds an article."""
    out, main = tag in OUT or (tag == "header" and not inside), tag in ("article", "main")
    token = tag
    if attrs and not attrs.isspace():
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name not in _KNOWN:
                continue
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                out = True
            elif name == "role":
                out |= value in OUT_ROLES
                main |= value in ("main", "article")
            elif name in ("class", "id") and tag not in ("html", "body"):
                names = [_NAME.findall(x) for x in value.split()]
                words = [w for x in names for w in x]
                token += "." + "-".join(words)
                # A name is that of a menu and the like only as a whole: `cookie-notice` is, `notice-period` isn't.
                if any(not OUT_NAMES.isdisjoint(x) and OUT_NAMES.union(BESIDE).issuperset(x) for x in names):
                    out |= tag != "main" and (tag != "article" or MAIN_NAMES.isdisjoint(words))
                main |= not MAIN_NAMES.isdisjoint(words)
    return token, out, main and not out


def _dropped_end(page: str, at: int, tag: str, outer: list[str]) -> int:
    """Where the dropped element that has just opened ends: after its end tag.

    Without one before the end of an element around it, or before a tag that can't be inside it, it goes up to the next tag
    of a block only, so that no text after it is lost.
    """
    inside, block = [tag], None
    while m := _TAG.search(page, at):
        close, name = m[1], (m[2] or "").lower()
        at = m.end()
        if not name:
            continue
        if block is None and name in BLOCKS and name not in VOID:
            block = m.start()
        if close:
            if name in inside:
                del inside[len(inside) - 1 - inside[::-1].index(name) :]
                if not inside:
                    return at
            elif name in BLOCKS and name in outer:
                return m.start() if block is None else block
            elif tag == "option" and name in _OPTION_ENDS:
                return m.start()
        elif name in RAW:
            if not m[3].rstrip().endswith("/"):
                stop = _RAW_END[name].search(page, at)
                at = stop.end() if stop else len(page)
        elif name == tag and tag in FLAT:
            return m.start() if block is None else block
        elif name in BLOCKS or name in DROPPED:
            if name not in VOID and name != "option" and not m[3].rstrip().endswith("/"):
                inside.append(name)
        if tag == "option" and not close and (name in _OPTION_ENDS or name in BLOCKS):
            return m.start()
    return len(page) if block is None else block


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], bool, str, int]]:
    """Path, whether it is left out, text and letters of links of each block of text, and of each element as it opens (text '')."""
    stack: list[tuple[str, str, bool, bool]] = []  # tag, token, left out, main
    path: tuple[str, ...] = ()
    out = False
    parts: list[str] = []
    links, link = 0, False
    at, size = 0, len(page)

    def flush():
        nonlocal links
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        found = (path, out, text, links) if text else None
        links = 0
        return found

    while at < size:
        m = _TAG.search(page, at)
        end = m.start() if m else size
        if end > at:
            piece = page[at:end]
            if not m and (cut := re.search(r"<[a-zA-Z/!?]", piece)):
                piece = piece[: cut.start()]
            parts.append(piece)
            if link:
                links += len(piece)
        if not m:
            break
        at = m.end()
        close, tag, attrs = m[1], m[2], m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not close and not attrs.rstrip().endswith("/"):
                stop = _RAW_END[tag].search(page, at)
                at = stop.end() if stop else size
            continue
        if tag in DROPPED:
            if not close and not attrs.rstrip().endswith("/"):
                at = _dropped_end(page, at, tag, [s[0] for s in stack])
            continue
        if tag == "a":
            link = not close
            continue
        if tag == "br" or tag == "hr":
            parts.append(" ")
            if tag == "br":
                continue
        if tag not in BLOCKS or tag in VOID:
            continue
        if found := flush():
            yield found
        if close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        else:
            link = False
            ends = SELF_CLOSING.get(tag)
            if stack and (stack[-1][0] == "p" or (ends and stack[-1][0] in ends)):
                stack.pop()
            token, off, main = _kind(tag, attrs, any(s[3] for s in stack))
            stack.append((tag, token, off or (bool(stack) and stack[-1][2]), main or (bool(stack) and stack[-1][3])))
        path = tuple(s[1] for s in stack)
        out = bool(stack) and stack[-1][2]
        if not close:
            yield path, out, "", 0
    if found := flush():
        yield found


def _code(path: str, text: str) -> int:
    """64-bit hash of a block of text with its path, never 0, which paths alone have."""
    return int.from_bytes(hashlib.blake2b(f"{path}\n{text}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) or 1


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By host and token (path and hash of text, or 0), merged over the rows of a batch: pages, occurrences, vector's hash, letters, letters of links, left out."""
    for piece, texts in slices(batches, "html"):
        hosts = piece.column(1).to_pylist()
        ids = piece.column(0).to_pylist()
        sums: dict[tuple[str, str, int], list[int]] = {}
        for host, page_id, raw in zip(hosts, ids, texts, strict=True):
            count: dict[tuple[str, int], list[int]] = {}
            for path, out, text, links in blocks(raw.decode("utf-8", "replace")):
                where = "/".join(path)
                keys = [(where, 0), (where, _code(where, text))] if text and not out else [(where, 0)]
                for key in keys:
                    own = count.setdefault(key, [0, 0, 0, int(out)])
                    if text:
                        own[1] += len(text)
                        own[2] += min(links, len(text))
                    if key[1] or not text:
                        own[0] += 1
            for (token, told), (n, size, links, out) in count.items():
                total = sums.setdefault((host, token, told), [0, 0, 0, 0, 0, out])
                code = zlib.crc32(f"{page_id}/{n}".encode()) | zlib.adler32(f"{n}/{page_id}".encode()) << 32
                for i, x in enumerate((1, n, 0, size, links)):
                    total[i] += x
                total[2] ^= code
        rows = [(*k, *v) for k, v in sums.items()]
        if rows:
            host, token, told, pages, n, code, size, links, out = zip(*rows, strict=True)
            import numpy as np

            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(token, pa.string()), pa.array(told, pa.int64()), pa.array(pages, pa.int64()), pa.array(n, pa.int64()), pa.array(mix(np.array(code, U)).view(np.int64)), pa.array(size, pa.int64()), pa.array(links, pa.int64()), pa.array(out, pa.int32())], names=["host", "token", "told", "pages", "n", "code", "size", "links", "out"])


def _classes(tokens: list) -> dict[tuple, list]:
    """Tokens by occurrence vector: pages, occurrences, and the vector's hash."""
    out: dict[tuple, list] = {}
    for t in tokens:
        out.setdefault((t["pages"], t["n"], t["code"]), []).append(t)
    return out


def _template(classes: dict[tuple, list]) -> list:
    """The blocks of text of the host's template: those of classes with enough text on enough pages."""
    told = {key: [t for t in group if t["told"]] for key, group in classes.items() if key[0] >= TEXT_PAGES}
    return [t for key, group in told.items() if (key[0] - 1) * sum(t["size"] for t in group) >= EVIDENCE * key[0] for t in group]


def _slot(classes: dict[tuple, list], template: list, host_pages: int) -> str:
    """The path of the host's article slot. tokens: (token, told, pages, n, code, size, links, out)."""
    fixed: dict[str, list[int]] = {}
    for t in template:
        own = fixed.setdefault(t["token"], [0, 0])
        own[0] += t["size"]
        own[1] += t["links"]
    plain = lambda ts: sum(t["size"] - t["links"] for t in ts)
    paths = [t for group in classes.values() for t in group if not t["told"] and not t["out"]]
    tokens = []
    for t in paths:
        size, links = fixed.get(t["token"], (0, 0))
        tokens.append({**t, "size": t["size"] - size, "links": t["links"] - links})
    inside = lambda root: [t for t in tokens if t["token"] == root or t["token"].startswith(root + "/")]
    # Where all pages are copies of one, no text is left to go by, and names must do.
    whole = plain(tokens)
    if host_pages >= TEXT_PAGES and whole:
        regions = [t["token"] for key, group in classes.items() if key[0] == key[1] for t in group if not t["told"] and not t["out"] and not _HOLDER.search(t["token"])]
        return max((r for r in regions if plain(inside(r)) >= MOST * whole), key=lambda r: (r.count("/"), r), default="")
    tokens = tokens if whole else paths
    names: dict[str, list[str]] = {"article": [], "main": []}
    for t in paths:
        last = t["token"].rsplit("/", 1)[-1].split(".")[0]
        if last in names:
            names[last].append(t["token"])
    for group in names.values():
        if group:
            return max(group, key=lambda r: (plain(inside(r)), -len(r), r))
    return ""


def _slots(group):
    import pandas as pd

    tokens = group.sort_values(["token", "told"]).to_dict("records")
    classes = _classes(tokens)
    template = _template(classes)
    return pd.DataFrame({"host": [tokens[0]["host"]], "slot": [_slot(classes, template, tokens[0]["host_pages"])], "template": [sorted(t["told"] for t in template)]})


def main_text(page: str, slot: str, template: Container[int] = ()) -> str:
    """Text of the page in the template's slot; where the page has no such slot, in its own article, main or body.

    Without the template's own text, except on pages that have no other: copies of one page can't be told from a template.
    """
    own: list[tuple[str, bool, str]] = [("/".join(path), out, text) for path, out, text, _ in blocks(page)]
    under = lambda p, root: not root or p == root or p.startswith(root + "/")
    roots = [slot] if slot and any(under(p, slot) for p, _, _ in own) else []
    if not roots:
        for name in ("article", "main"):
            roots = sorted({p for p, out, text in own if not text and not out and p.rsplit("/", 1)[-1].split(".")[0] == name})
            if roots:
                break
    found = [(p, text) for p, out, text in own if text and not out and (not roots or any(under(p, r) for r in roots))]
    kept = [text for p, text in found if _code(p, text) not in template] if template else []
    return " ".join(kept or [text for _, text in found])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece, texts in slices(batches, "html"):
        # Rows repeat their host's template; it is made a set once.
        templates: dict[tuple[int, ...], frozenset[int]] = {}
        told = [templates.setdefault(k, frozenset(k)) for k in (tuple(x or ()) for x in piece.column(4).to_pylist())]
        found = [main_text(t.decode("utf-8", "replace"), s or "", x) for t, s, x in zip(texts, piece.column(3).to_pylist(), told, strict=True)]
        yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def slots(pages: DataFrame) -> DataFrame:
    """(host, slot, template): each host's article slot and hashes of its template's blocks of text, from the merged tokens of all its pages."""
    own = pages.select("page_id", host_path(F.col("url"))[0].alias("host"), "html")
    parts = own.mapInArrow(_tokens, "host string, token string, told long, pages long, n long, code long, size long, links long, out int")
    merged = parts.groupBy("host", "token", "told").agg(*[F.sum(c).alias(c) for c in ("pages", "n", "size", "links")], F.bit_xor("code").alias("code"), F.min("out").alias("out"))
    count = own.groupBy("host").agg(F.count("*").alias("host_pages"))
    # Paths that hardly any page has can't be in a valid class; they are summed in their host's pages all the same.
    kept = merged.where(f"told = 0 OR pages >= {TEXT_PAGES}").join(count, "host").where(F.col("pages") >= SUPPORT * F.col("host_pages"))
    return kept.groupBy("host").applyInPandas(_slots, "host string, slot string, template array<long>")


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars.

    Character references are decoded, white space in a block becomes one space, blocks are joined by one space in page
    order. Blocks of text that are the template's are left out. Null html and pages without article text: empty. Null urls share the empty host. Repeated rows count as
    pages. Empty table: no rows.
    """
    found = materialise(slots(pages))
    own = pages.select("page_id", "url", "html", host_path(F.col("url"))[0].alias("host"))
    if found.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        both = own.join(F.broadcast(found), "host", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = own.withColumn("salt", F.pmod(F.hash("page_id", "url"), F.lit(SALTS))).join(salted, ["host", "salt"], "left")
    return both.select("page_id", "url", "html", "slot", "template").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
