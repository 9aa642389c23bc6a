"""Training-data operators against brute force, on small tables with nulls, empty and repeated rows and clashing names."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaframe.llm import bpe, chat_format, common, fingerprints, html_extract, language_id, mixing, ngram_jaccard, queries, substring_dedup, topk_search, url_filter

SF = os.environ.get("SYLVAFRAME_TEST_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, starts int"


def corpus(seed=1, n=60):
    """Texts of a few words with shared passages, copies, near copies, runs, null, empty and one long text."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(words) for _ in range(30)]
    texts = [None, "", "one", "a b c", " \t\n", "x " * 40, "x " * 55 + "tail", "Lang ä ß " * 700]
    for _ in range(n):
        own = [rnd.choice(words) for _ in range(rnd.randint(3, 60))]
        if rnd.random() < 0.3:
            at = rnd.randint(0, 10)
            own[at:at] = passage[rnd.randint(0, 9) : rnd.randint(15, 30)]
        texts.append(" ".join(own))
        if rnd.random() < 0.4:
            for i in range(rnd.randint(0, 2)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            texts.append("  ".join(own).upper() if rnd.random() < 0.5 else " ".join(own))
    texts += [t for t in texts if rnd.random() < 0.2]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None if i % 5 == 0 else "en", "s", len(t or ""), i, 0) for i, t in rows], DOCS)


def test_substring_dedup(spark):
    rows = corpus()
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][s : s + 13]), i)
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(frame(spark, rows)).collect()}
    whole = {r.doc_id: r for r in substring_dedup.dedup_substrings(frame(spark, rows), whole=True).collect()}
    for i, w in words.items():
        gone = {j for s in range(len(w) - 12) if first[tuple(w[s : s + 13])] < i for j in range(s, s + 13)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
        assert whole[i].kept_text == (kept.decode() if gone else dict(rows)[i] or "") and whole[i].key == i
    assert substring_dedup.dedup_substrings(frame(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize("share,n", [(85, 4), (80, 5)])
def test_ngram_jaccard(spark, share, n):
    rows = corpus(2)
    sets = {i: ngram_jaccard._shingles((t or "").encode(), n) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= share * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    docs = frame(spark, rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(docs.union(docs.where("doc_id = 9")), share, n).collect()}
    assert got == {i: (len(s), top(i)) for i, s in sets.items()}


def thue_morse(n, first="a", second="b"):
    """A word and its complement: a polynomial hash modulo 2^64 can't tell them apart, whatever its base."""
    out = first
    while len(out) < n:
        out += out.translate(str.maketrans(first + second, second + first))
    return out, out.translate(str.maketrans(first + second, second + first))


def test_words_that_polynomial_hashes_confuse(spark):
    x, y = thue_morse(4096)
    tail = " ".join(f"t{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{x} {tail}"), (2, f"{y} {tail}"), (3, x), (4, y), (5, f"{x} {tail}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 13}
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def near_misses(n, words, changes, seed):
    """Texts that differ from one text in `changes` places each."""
    rnd = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in rnd.sample(range(words), changes):
            own[at] = f"c{rnd.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_ngram_jaccard_of_a_crowd(spark, monkeypatch):
    """Many near copies of one text, about as alike as links ask for, in many blocks; with nulls, repeats and short texts."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 4)
    texts = [f"{i} {t}".replace(" b", f" b{i}x") for i in (1, 2, 3) for t in near_misses(20, 90, i, 3 + i)] + [None, "", "one", "ONE", "a b", "a  B"]
    sets = {i: ngram_jaccard._shingles((t or "").encode()) for i, t in enumerate(texts)}
    up = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    up[i] = up[j] = min(up[i], up[j])
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(5, texts[5], 7), (None, "x y z", 7)]
    got = {(r.doc_id, r.component_id) for r in ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()}
    assert got == {*up.items(), (None, None)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard.jaccard_components(empty).count() == 0


def test_pieces_of_sets_that_link_meet():
    """Every two sets that link share a key, also where threes of segments and deletions are allotted."""
    import numpy as np

    rnd = np.random.default_rng(5)
    for pieces in (None, (0, 1, 0), (2, 1, 1), (3, 0, 2), (1, 2, 0)):
        ngram_jaccard._PLANS.clear()
        if pieces:
            plan = []
            for lo, hi, *_ in ngram_jaccard.bands(400):
                apart = 2 * (hi - 1) * 15 // 115
                alone, threes, doubles = pieces[0], pieces[1], pieces[2]
                alone = max(0, apart + 1 + 3 - 2 * (threes + doubles)) if lo > 20 else 4 + apart
                plan.append((lo, hi, alone, *((threes, doubles, 3) if lo > 20 else (0, 0, 3))))
            ngram_jaccard._PLANS[85] = plan + [(plan[-1][1], 1 << 40, 500, 0, 0, 3)]
        for _ in range(150):
            n = int(rnd.integers(1, 300))
            a = rnd.integers(0, 2**63, n).astype(np.uint64)
            b = a.copy()
            for at in rnd.integers(0, n, int(rnd.integers(0, n // 8 + 2))):
                b[at] = rnd.integers(0, 2**63)
            b = b[: n - int(rnd.integers(0, n // 10 + 1))]
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                key, whose = ngram_jaccard.set_keys(np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)]), 2)
                assert set(key[whose == 0].tolist()) & set(key[whose == 1].tolist())
    ngram_jaccard._PLANS.clear()


def test_bpe(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    told = Tokenizer.from_file(path)
    rnd = random.Random(3)
    letters = "ab  \n'stMre09.,é中 \x1c😀"
    rows = [(i, t) for i, t in enumerate([None, "", "<|endoftext|> a", *["".join(rnd.choice(letters) for _ in range(30)) for _ in range(200)]])]
    got = {r.doc_id: r for r in bpe.bpe(frame(spark, rows), path).collect()}
    for i, t in rows:
        ids = told.encode(t or "", add_special_tokens=False).ids
        assert (got[i].ids, got[i].decoded, got[i].n_tokens) == (ids, told.decode(ids, skip_special_tokens=False), len(ids))


def test_bpe_matchers_agree_and_older_pieces_return(monkeypatch):
    codec = bpe.Codec(open(queries.vocabulary(), "rb").read())
    rnd = random.Random(8)
    letters = "ab'sdll ré9²Ⅷ.,é中 \x1c\x85\u2003\u3000\u200b\ufeff\u0345ʰ٣\n\t"
    for _ in range(5000):
        x = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 20)))
        assert codec.find_plane(x) == codec.find_any(x) == codec.find(x)
    every = " ".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    assert codec.find_plane(every) == codec.find_any(every)
    texts = ["".join(rnd.choice(letters) for _ in range(20)) for _ in range(40)] * 3
    told = list(codec.encode(texts))
    monkeypatch.setattr(bpe, "MEMORY", 10)
    small = bpe.Codec(open(queries.vocabulary(), "rb").read())
    assert [x for t in texts for x in small.encode([t])] == told


def test_bpe_memory_of_pieces():
    import tracemalloc

    codec = bpe.Codec(open(queries.vocabulary(), "rb").read())
    rnd = random.Random(4)
    texts = [" ".join("".join(rnd.choice("abcdefghij") for _ in range(9)) for _ in range(100)) for _ in range(300)]
    tracemalloc.start()
    try:
        n = sum(len(x) for x, *_ in codec.encode(texts))
        held, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert n and len(codec.known) > 29_000
    # Bytes a piece: 146 and 358; 253 and 1386 when all were learned together and kept with their bytes.
    assert held / len(codec.known) < 200 and most / len(codec.known) < 700, (held / len(codec.known), most / len(codec.known))


def test_language_id(spark):
    rnd = random.Random(4)
    make = lambda ws, k: " ".join(rnd.choice(ws) for _ in range(k))
    en, de = "the and of thing with from house water".split(), "der die und nicht straße wasser haus über".split()
    rows = [(i, make(en if i % 2 else de, 30), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, None), (101, "12 ...", None), (102, make(en, 40) + " " + make(de, 20), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify_held_out(docs, spans=True).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if lang)
    assert got[100].lang_pred == got[101].lang_pred == "und"
    assert [s.lang for s in got[102].spans] == ["en", "de"] and got[102].lang_pred == "en"
    assert language_id.identify_held_out(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_fingerprints(spark):
    rows = corpus(5)
    got = {r.doc_id: r for r in fingerprints.fingerprints(frame(spark, rows)).collect()}
    texts = [t or "" for _, t in rows]
    for i, t in enumerate(texts):
        h, after = len(t) // 2, texts[(i + 1) % len(texts)]
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - h] + after[:h]).encode()).hexdigest() and got[i].n_chars == len(t)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    by = {}
    for i, t in enumerate(texts):
        assert by.setdefault(t, got[i].fp) == got[i].fp
    long = next(i for i, t in enumerate(texts) if len(t.split()) > 50 and t.startswith("w"))
    pos = [x.pos for x in got[long].fp]
    assert pos == sorted(pos) and max(b - a for a, b in zip(pos, pos[1:])) <= fingerprints.W


def test_url_rules_and_graph(spark):
    link = lambda h: f'<a class=x href="https://{h}/p">l</a>'
    rows = [(0, "HTTP://A.Org/x?y", link("b.net") * 3), (1, "https://b.net/", link("c.net")), (2, "http://c.net", ""), (3, "http://bad.com/de/1", ""), (4, "http://spam.net/z", link("bad.com")), (5, None, None), (6, "nourl", "x"), (7, "http://w.example.org/es/q", ""), (8, "http://xorg/", "")]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.org", "/x", "org/", "allow")
    assert got[1].trust > got[2].trust > 0 and got[1].verdict == "allow"
    assert (got[3].rule, got[3].verdict) == ("com/de/", "block") and got[4].verdict == "block" and got[4].rule is None
    assert got[7].rule == "example.org/es/" and got[8].rule is None and got[5].host == got[6].host == ""


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", r"\### Assistant: </turn> ok"), (1, 1, "assistant", "<turn>\\l#"), (1, 2, "assistant", None), (2, 0, None, ""), (2, None, "user", "x"), (3, 1, "assistant", "b"), (3, 0, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, x or "") for _, _, r, x in rows[:3]]
    assert [(t.role, t.text) for t in got[2].turns] == [("user", "x"), ("", "")]
    assert got[3].formatted == "### assistant: <turn>a<turn>b</turn>\n"
    assert "".join(s.text for s in got[1].segments) == got[1].formatted
    assert {r.conv_id: (r.n_turns, r.loss_chars) for r in chat_format.chat_digests(chat_format.format_chats(df)).collect()} == {1: (3, 9), 2: (2, 0), 3: (2, 2)}


def test_mixing(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(2000)]
    rows, labels = [(9000, None), (9001, "")], []
    for i in range(600):
        kind = i % 3
        own = [rnd.choice(words) for _ in range(40)] + [["awful"], ["***"] * 3, []][kind]
        rows.append((i, " ".join(own)))
        if i % 2:
            labels.append((i, 0 if kind == 1 else 1, 1 if kind == 0 else 0))
    out = mixing.mix_sources(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    rate = {k: sum(r.rate for r in out if r.doc_id < 600 and r.doc_id % 3 == k) / 200 for k in range(3)}
    assert rate[0] < 0.1 < rate[1] and rate[2] > 0.9
    tokens = [sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in out) for d in mixing.DOMAINS]
    assert all(abs(x / sum(tokens) - w) < 1e-5 for x, w in zip(tokens, mixing.WEIGHTS, strict=True)) and all(r.miss < 1e-6 for r in out)
    assert len(out) == len(rows) and all(abs(r.p_toxic + r.p_low + r.p_high - 1) < 1e-9 for r in out)


def test_mixing_meets_its_targets_on_the_test_table_and_edges(spark):
    docs, labels = (spark.read.parquet(f"{SF}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    clash = docs.withColumn("rate", F.lit(1)).withColumn("quality", F.lit(2)).withColumn("miss", F.lit("x"))
    one = mixing.mix_sources(clash, labels).collect()
    two = mixing.mix_sources(docs.orderBy(F.desc("doc_id")), labels).collect()
    tokens = [sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in one) for d in mixing.DOMAINS]
    assert all(abs(x / sum(tokens) - w) < 1e-5 for x, w in zip(tokens, mixing.WEIGHTS, strict=True))
    assert {r.doc_id: round(r.rate, 6) for r in one} == {r.doc_id: round(r.rate, 6) for r in two}
    none = mixing.mix_sources(docs, labels.where("false")).first()
    assert none.p_low == pytest.approx(1 / 3) and none.miss > 0.1
    assert mixing.mix_sources(docs.where("false"), labels).count() == 0


def test_html(spark):
    page = lambda body: f"<html><body><nav><a href=/>Menu</a></nav><header>Site</header><div class='cookie-notice'>Accept</div>{body}<aside>Side</aside><footer>&copy; x</footer></body></html>"
    rows = [(i, f"http://h.net/{i}", page(f"<article><h1>T{i}</h1><p>a &amp; <b>b</b>\n c<p>d<script>var t='</p>'</script><section class=comments><p>nice</p></section></article>")) for i in range(6)]
    rows += [(10 + i, f"http://plain.net/{i}", page(f"<div class=wrap><p>Some long text number {i}.</p><p>More of it here.</p></div>")) for i in range(4)]
    rows += [(20, None, None), (21, "x", "plain <b>text"), (22, "http://h.net/9", "<p>cut <")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == f"T{i} a & b c d" for i in range(6))
    assert all(got[10 + i].text == f"Some long text number {i}. More of it here." for i in range(4))
    assert got[20].text == "" and got[21].text == "plain text" and got[20].n_chars == 0


def test_topk(spark):
    rnd = random.Random(7)
    rows = [(i, [float(rnd.randint(-3, 3)) / 3 for _ in range(4)]) for i in range(450)]
    rows += [(500, None), (600, [1.0, None, 0.0, 0.0]), (700, [float("nan")] * 4), rows[3]]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    import numpy as np

    x = {i: np.floor(np.array(v, np.float32).astype(float) * 1024).astype(int) for i, v in rows[:450]}
    told = {(q, r + 1): (i, s) for q in range(0, 450, 100) for r, (s, i) in enumerate(sorted(((-int(x[q] @ x[i]), i) for i in x if i != q))[:10])}
    assert {(r.query_id, r.rank): (r.vec_id, -r.score) for r in got} == {k: (i, s) for k, (i, s) in told.items()} and len(got) == len(told)


def test_topk_of_large_numbers_is_exact(monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(3)
    for most in (200, 2 * 10**8, 2 * 10**9, 2**62):
        x = rnd.integers(-most, most, (500, 16))
        x[7], x[9] = x[8], x[8]  # ties
        ids = np.arange(500) * 3
        tree = topk_search.Tree(ids.copy(), x.copy(), leaf=16)
        q = x[::60]
        for i, got in enumerate(tree.search(q, ids[::60], 5, [None] * len(q))):
            told = sorted(((-sum(a * b for a, b in zip(q[i].tolist(), v.tolist(), strict=True)), j) for j, v in zip(ids.tolist(), x, strict=True) if j != ids[i * 60]))[:5]
            assert sorted((-s, j) for s, j in got) == told


def test_topk_edges(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 3)
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 2)
    schema = "vec_id long, embedding array<double>, score string, shard int"
    assert topk_search.top_k(spark.createDataFrame([], schema)).count() == 0
    rows = [(0, [1.0, 0.0], "a", 1), (0, [0.5, 9.0], "a", 1), (100, [1.0], "b", 2), (200, [2.0, 0.0], "c", 3), (1, [1e30, 1.0], "d", 4), (2, [1.0, 1.0], "e", 5), (3, [1.0, 1.0], None, 6), (None, [1.0, 1.0], None, 7)]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk_search.top_k(spark.createDataFrame(rows, schema), k=3).collect()}
    one = 1024 * 1024
    assert got == {(0, 1): (1, 2**63 - 1), (0, 2): (2, 9 * one + one // 2), (0, 3): (3, 9 * one + one // 2), (200, 1): (1, 2**63 - 1), (200, 2): (2, 2 * one), (200, 3): (3, 2 * one)}


def test_html_unclosed_elements_end():
    text = lambda page: html_extract.main_text(page, "")
    for head in ("<datalist><option value=a><option value=b></datalist>", "<div><button>Menu</div>", "<svg><path>", "<div><canvas>x</div>", "<select><option>a<option>b", "<div><object>o</div><p></object>", "<button>a<p></p><button>b</button>", "<option>a"):
        assert text(f"<body>{head}<article><p>Kept <b>text</b>.</p></article></body>") == "Kept text.", head
    assert text("<article>a<svg><title>t</title><svg></svg>x</svg>b <select><option>c<option>d</select><template><p>e<p>f</template>g</article>") == "ab g"
    assert text("<article>a<script>b<p>c") == "a"


def test_html_attributes_are_read_whole():
    text = lambda page: html_extract.main_text(page, "")
    for kept in ('<p title="a hidden gem">x</p>', '<p data-id="ad-3">x</p>', "<p data-role=navigation>x</p>", '<p class="notice-period">x</p>', "<p title='class=ad'>x</p>", "<div class=share-capital>x</div>", "<p title=\"x' hidden y\">x</p>"):
        assert text(f"<article>{kept}</article>") == "x", kept
    for gone in ("<p hidden>x</p>", '<p class="big ad">x</p>', "<div class=cookie-notice>x</div>", "<div id='comments-area'>x</div>", "<p aria-hidden=true>x</p>", "<div role=navigation>x</div>"):
        assert text(f"<article>{gone}y</article>") == "y", gone


def test_html_classes_against_brute_force_and_without_names(spark, monkeypatch):
    """No element is named: classes alone tell the article's region. Both joins give the same. Vectors equal those counted by hand."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(8):
        menu = "".join(f"<div><a href=/{word()}>{word()}</a></div>" for _ in range(5))
        body = "".join(f"<p>{word()} {word()} {word()} {word()}</p>" for _ in range(rnd.randint(2, 5)))
        rows.append((i, f"http://u.net/{i}", f"<body><div><div>{menu}</div></div><div><section><h2>{word()}</h2>{body}</section></div><div><span>{word()}</span></div></body>"))
    schema = "page_id long, url string, html string, host string, slot int, salt int"
    pages = spark.createDataFrame([(*r, "x", 1, 2) for r in [*rows, (99, None, None), rows[0]]], schema)
    told = {i: " ".join(__import__("re").findall(r"<(?:h2|p)>([^<]*)", h)) for i, _, h in rows}
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got == {**told, 99: ""}
    monkeypatch.setattr(html_extract, "BROADCAST_HOSTS", 0)
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == got
    assert html_extract.extract(pages.where("false")).count() == 0
    import pyarrow as pa

    own = pages.where("page_id < 8").dropDuplicates(["page_id"]).selectExpr("page_id", "'u.net' AS host", "html").collect()
    vectors = {}
    for r in own:
        for path, _, text, _ in html_extract.blocks(r.html):
            if not text:
                vectors.setdefault("/".join(path), {}).setdefault(r.page_id, 0)
                vectors["/".join(path)][r.page_id] += 1
    batch = pa.RecordBatch.from_pydict({"page_id": [r.page_id for r in own], "host": ["u.net"] * len(own), "html": [r.html for r in own]})
    sums = [t for b in html_extract._tokens(iter([batch])) for t in b.to_pylist() if not t["told"]]
    classes = {}
    for t in sums:
        classes.setdefault((t["pages"], t["n"], t["code"]), set()).add(t["token"])
    brute = {}
    for path, v in vectors.items():
        brute.setdefault(tuple(sorted(v.items())), set()).add(path)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, brute.values()))


def test_html_repeated_text_is_the_templates(spark):
    legal, more = "This site is run without any warranty by its owner.", "Call us on 555."
    named = lambda i: f"<body><article><h1>T{i}</h1><div>{legal}</div><p>Own text {i}.</p><div class=x><p>{more}</p></div></article></body>"
    plain = lambda i: f"<body><div>{legal * 9}</div><div class=wrap><p>Long own text of page number {i}.</p><div>{more}</div></div></body>"
    rows = [(i, f"http://a.net/{i}", named(i)) for i in range(6)] + [(10 + i, f"http://b.net/{i}", plain(i)) for i in range(9)]
    rows += [(20 + i, f"http://c.net/{i}", named(7)) for i in range(5)]  # copies of one page
    rows += [(30 + i, f"http://d.net/{i}", named(i)) for i in range(2)]  # too few pages
    rows += [(40 + i, f"http://e.net/{i}", named(i) if i < 2 else f"<body><article><p>Alone {i}.</p></article></body>") for i in range(6)]  # on a third of the pages
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = lambda i: f"T{i} {legal} Own text {i}. {more}"
    assert [got[i] for i in range(6)] == [f"T{i} Own text {i}." for i in range(6)]
    assert [got[10 + i] for i in range(9)] == [f"Long own text of page number {i}." for i in range(9)]
    assert [got[20 + i] for i in range(5)] == [whole(7)] * 5 and [got[30 + i] for i in range(2)] == [whole(0), whole(1)]
    assert [got[40 + i] for i in range(6)] == [whole(0), whole(1), *[f"Alone {i}." for i in range(2, 6)]]


@pytest.mark.parametrize("k,w,step", [(4, 5, 7), (4, 5, 4092), (10, 25, 33), (10, 25, 4072), (3, 2, 5)])
def test_winnow_against_brute_force(spark, monkeypatch, k, w, step):
    """Chosen hashes and their places against a search of every window; hashes worked out anew with the xxhash library."""
    import xxhash

    for name, value in (("K", k), ("W", w), ("STEP", step)):
        monkeypatch.setattr(fingerprints, name, value)

    def hashed(*values, seed=42):
        for v in values:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little"), seed)
        return seed

    def gram(x):
        if len(x) < k:
            return hashed(x)
        row, width = list(x), 1
        while width < k:
            many = min(5, -(-k // width))
            row = [hashed(*v) for v in zip(*[row[min(j * width, k - width) :] for j in range(many)])]
            width = min(many * width, k)
        return row[0]

    rnd = random.Random(10)
    texts = ["".join(rnd.choice("ab中 \u3000\xa0\n\x1c😀") for _ in range(rnd.randint(0, 90))) for _ in range(200)] + ["", "a", "ab" * 2500, "x" * 9000, "".join(rnd.choice("ab中😀 ") for _ in range(9000))]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", fingerprints.winnow(F.col("text")).alias("fp")).collect()
    assert len(got) == len(texts)
    for r in got:
        flat = " ".join(texts[r.i].split())
        size = min(k, len(flat))
        signed = lambda h: (h - (1 << 64) if h >> 63 else h) >> 12
        told = [signed(gram(flat[i : i + size])) for i in range(len(flat) - size + 1)] if flat else []
        chosen = sorted({min(range(s, min(s + w, len(told))), key=lambda i: (told[i], -i)) for s in range(max(1, len(told) - w + 1))}) if told else []
        assert [(x.hash, x.pos) for x in r.fp] == [(told[i], i) for i in chosen]


@pytest.mark.parametrize("k,w", [(4, 5), (10, 25)])
def test_winnow_of_joined_texts(spark, monkeypatch, k, w):
    """The edited text's fingerprint, made from those of its two sides, is that of the whole edited text."""
    monkeypatch.setattr(fingerprints, "K", k)
    monkeypatch.setattr(fingerprints, "W", w)
    rnd = random.Random(12)
    text = lambda n: "".join(rnd.choice("ab中\u3000  😀" if n % 3 else "ab") for _ in range(n))
    sizes = [0, 1, 2, 3, k, w, k + w - 2, k + 2 * w - 3, k + 2 * w - 2, 2 * k + 4 * w, 4 * k + 8 * w, 9000]
    rows = [(text(rnd.choice(sizes) + rnd.randint(0, 2)), text(rnd.choice(sizes) + rnd.randint(0, 2))) for _ in range(400)]
    rows = [(a, b, rnd.randint(0, len(a)), rnd.randint(0, len(b))) for a, b in rows] + [(" ", "a" * 300, 1, 200), ("a" * 300, "  ", 300, 2), ("b" * 300 + " ", " " + "a" * 300, 301, 301)]
    df = spark.createDataFrame([(a[:i], b[:j], a, b) for a, b, i, j in rows], "head string, tail string, a string, b string")
    df = df.withColumn("fa", fingerprints.winnow(F.col("a"))).withColumn("fb", fingerprints.winnow(F.col("b")))
    got = df.select(fingerprints.winnow_joined(F.col("head"), F.col("tail"), F.col("fa"), F.col("fb")).alias("x"), fingerprints.winnow(F.concat("head", "tail")).alias("y")).collect()
    assert len(got) == len(rows) and all(r.x == r.y for r in got)


@pytest.mark.parametrize("k,w,block", [(4, 5, 1), (4, 5, 7), (3, 2, 5), (10, 25, 3), (10, 25, 96)])
def test_winnowed_rows(spark, monkeypatch, k, w, block):
    """Texts winnowed as rows of blocks have the fingerprints that winnow gives; each row of the table stays, with its columns."""
    for name, value in (("K", k), ("W", w), ("BLOCK", block)):
        monkeypatch.setattr(fingerprints, name, value)
    rnd = random.Random(13)
    text = lambda n: "".join(rnd.choice("ab中 \u3000\xa0\n\x1c😀" if n % 2 else "ab") for _ in range(n))
    sizes = [*range(12), k + w - 2, k + w - 1, k + w, block + k + w - 2, block + k + w - 1, block + k + w, 2 * block, 2 * block + k]
    texts = [text(n) for n in sizes for _ in range(4)] + ["", " ", " \n", "ab" * 700, "x" * 700, text(5001), "same", "same"]
    rows = [(i if i % 50 else None, t, i % 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int")
    got = fingerprints.winnowed(docs.repartition("part"), "text", "part").withColumn("same", F.col("fp").eqNullSafe(fingerprints.winnow(F.col("text")))).collect()
    assert sorted(map(repr, [(r.doc_id, r.text, r.part) for r in got])) == sorted(map(repr, rows))
    assert all(r.same for r in got)


def test_fingerprints_of_whole_texts_are_compiled(spark):
    """No array of a text's code points, over which Spark would interpret lambdas, and no exchange but that by part."""
    told = fingerprints.with_next(spark.createDataFrame([(i, "some text " * 40) for i in range(9)], "doc_id long, text string")).select("doc_id", "fp")
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "split(text" not in plan and ", , -1)" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_white_space_is_spaced_as_before(spark):
    """Each of the first 0x3100 code points between letters, beside a space and doubled, against a search without the short cut."""
    rows = [(c, t) for c in [*range(0x3100), 0x1F600] if not 0xD800 <= c < 0xE000 for t in (f"a{chr(c)}b", f"a {chr(c)}b", f"a{chr(c)} b", f"中{chr(c)}{chr(c)}😀")]
    plain = F.trim(F.regexp_replace("text", rf"{fingerprints._SPACE}+", " "))
    assert spark.createDataFrame(rows, "c int, text string").where(fingerprints._spaced(F.col("text")) != plain).count() == 0


def test_fingerprints_of_text_without_spaces_and_with_typos(spark):
    rnd = random.Random(11)
    han = "".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(300))
    prose = ["".join(rnd.choice("abcdefgh") for _ in range(9)) for _ in range(200)]
    typos = ["x" + v[1:] if i % 6 == 0 else v for i, v in enumerate(prose)]
    texts = [han, han[:150] + "a" + han[151:], " ".join(prose), " ".join(typos), "　".join(prose)]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].near_next > 0.7 and 0.2 < got[2].near_next < 1
    assert [x.hash for x in got[4].fp] == [x.hash for x in got[2].fp] and len(got[0].fp) > 10


def test_viterbi_against_all_labelings():
    """The path scores as much as the best of all labelings, less a switch's cost for each change."""
    import itertools

    import numpy as np

    rnd = np.random.default_rng(9)
    for _ in range(200):
        n, k = int(rnd.integers(1, 7)), int(rnd.integers(1, 4))
        scores = np.round(rnd.normal(0, 6, (n, k)), 1)
        worth = lambda path: sum(scores[i, x] for i, x in enumerate(path)) - 5.0 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
        best = max(map(worth, itertools.product(range(k), repeat=n)))
        path = language_id.viterbi(scores.copy(), 5.0)
        assert worth(path.tolist()) == pytest.approx(best)
        lang = int(scores.sum(0).argmax())
        if language_id.constant(scores, lang, 5.0):
            assert worth([lang] * n) == pytest.approx(best)


def test_language_id_edges(spark):
    rows = [(1, "the house and the water", "en"), (2, "das haus und das wasser", "de"), (3, "", "en"), (4, "дом и вода", "ru"), (4, "дом и вода", "ru"), (None, "the house", None), (5, "the water " * 40_000, None), (6, "1 2 !", None), (8, "水", None)]
    docs = spark.createDataFrame([(i, t, x, "clash", 0.5) for i, t, x in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs.select("doc_id", "text", "lang"), docs.where("doc_id IS NOT NULL"), spans=False).collect()), key=repr)
    told = {i: x for i, x, _ in got}
    assert (told[1], told[2], told[4], told[3], told[6], told[5]) == ("en", "de", "ru", "und", "und", "en") and len(got) == len(rows)
    assert language_id.identify_held_out(docs.where("false")).count() == 0
    assert {r.lang_pred for r in language_id.identify_held_out(docs).where("doc_id = 4").collect()} == {"ru"}


def test_pagerank_against_power_iteration(spark):
    """Trust along links and distrust against them, as by matrices in NumPy; hubs, ties, repeats, nulls and clashing names."""
    import numpy as np

    rnd = random.Random(2)
    hosts = [f"h{i}.net" for i in range(8)] + ["a.org", "b.org", "x.com"]
    rows = []
    for i in range(40):
        src = rnd.choice(hosts)
        path = "/de/1" if src == "x.com" and i % 2 else "/p"
        links = "".join(f'<a href="https://{rnd.choice(hosts)}/q">l</a>' for _ in range(rnd.randint(0, 4)))
        rows.append((i, f"https://{src}{path}", links, "clash", 0.1))
    rows += [rows[0], (90, None, "<a href=https://a.org/>", "c", 0.2), (91, "none", None, "c", 0.3), (92, "https://lone.net/", None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string, trust double")
    got = url_filter.judge_urls(df).collect()
    assert len(got) == len(rows) and url_filter.judge_urls(df.where("false")).count() == 0
    names = sorted({r.host for r in got if r.host} | set(hosts))
    at = {h: i for i, h in enumerate(names)}
    w, good, bad, pages = (np.zeros((len(names), len(names))), *(np.zeros(len(names)) for _ in range(3)))
    for _, url, html, *_ in rows:
        if not url or "://" not in url:
            continue
        h = url.split("//")[1].split("/")[0]
        pages[at[h]] += 1
        rule = "allow" if h.endswith("org") else "block" if h == "x.com" and "/de/" in url else None
        good[at[h]] += rule == "allow"
        bad[at[h]] += rule == "block"
        for to in (html or "").split('href="https://')[1:]:
            to = to.split("/")[0]
            w[at[h], at[to]] += to != h
    good, bad = good / np.maximum(pages, 1), bad / np.maximum(pages, 1)

    def rank(m, seed):
        m = m / np.maximum(m.sum(1, keepdims=True), 1)
        seed = seed / (seed.sum() or 1)
        x = seed.copy()
        for _ in range(500):
            x = (1 - url_filter.DAMPING) * seed + url_filter.DAMPING * (m.T @ x)
        return x

    trust, distrust = rank(w, good), rank(w.T, bad)
    for r in got:
        if r.host:
            assert r.trust == pytest.approx(trust[at[r.host]], abs=1e-5) and r.distrust == pytest.approx(distrust[at[r.host]], abs=1e-5)


def test_fingerprint_edges(spark):
    schema = "doc_id long, text string, fp int, n_chars string"
    lone = fingerprints.fingerprints(spark.createDataFrame([(5, "abcdefghijkl", 1, "x")], schema)).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0
    assert fingerprints.fingerprints(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "first of all", 1, None), (1, None, 1, "x"), (2, "", 1, "x"), (3, "tie", 1, "x"), (3, "tie", 1, "x"), (4, "long " * 300_000, 1, "x")]
    got = fingerprints.fingerprints(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.n_chars for r in got) == sorted(len(t or "") for _, t, *_ in rows)
    long = next(r for r in got if r.doc_id == 4)
    assert long.edited_sha256 == hashlib.sha256(("long " * 300_000)[:750_000].encode() + b"first of all").hexdigest()


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, formatted int"
    assert chat_format.format_chats(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, 0, "user", "a", 1), (None, 1, "assistant", "b", 1), (1, 0, "assistant", "x", 1), (1, 0, "assistant", "x", 1), (2, 0, "assistant", "y" * 1_000_000, 1)]
    got = {r.conv_id: r for r in chat_format.chat_digests(chat_format.format_chats(spark.createDataFrame(rows, schema))).collect()}
    assert (got[None].n_turns, got[None].loss_chars) == (2, 1) and (got[1].n_turns, got[1].loss_chars) == (2, 2) and got[2].loss_chars == 1_000_000


def test_bpe_edges(spark):
    schema = "doc_id long, text string, ids int, decoded int"
    path = queries.vocabulary()
    assert bpe.bpe(spark.createDataFrame([], schema), path).count() == 0
    rows = [(None, "null id", 1, 1), (1, "the house " * 50_000, 1, 1), (1, "the house " * 50_000, 1, 1)]
    got = bpe.bpe(spark.createDataFrame(rows, schema), path).collect()
    assert sorted(r.decoded for r in got) == sorted(t for _, t, *_ in rows)


@pytest.mark.parametrize("name", ["op1_topk_search", "op5_chat_format"])
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    told = con.execute(queries.ORACLES[name])
    cols = [x[0] for x in told.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, SF).select(*cols).collect())) == sorted(told.fetchall())


@pytest.mark.parametrize("buckets,span", [(1, 50), (7, 1 << 62), (300, 100_000)])
def test_packed_keys_lead_all_their_documents_to_the_smallest(buckets, span):
    rnd = np.random.default_rng(buckets)
    met, docs, size, n = {}, {}, 0, 0
    for _ in range(3):
        key, ids = rnd.integers(0, 300, 500).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), rnd.integers(-span, span, 500)
        for k, i in zip((key % np.uint64(buckets << ngram_jaccard.KEY_BITS)).tolist(), ids.tolist(), strict=True):
            docs.setdefault(k, set()).add(i)
        rows = ngram_jaccard._settle([(key[:200], ids[:200]), (key[200:], ids[200:])], buckets)
        for b, x in zip(rows["bucket"].to_pylist(), rows["rows"].to_pylist(), strict=True):
            met.setdefault(b, []).append(x)
            size, n = size + len(x) * (b < buckets), n + (len(ngram_jaccard._unpacked(x)[0]) if b < buckets else 0)
    edges = [e for b, x in met.items() for e in zip(*[c.to_pylist() for c in ngram_jaccard._star(b, x, buckets).columns], strict=True)]
    for k, all_of_it in docs.items():
        reached = {min(all_of_it)}
        for _ in range(2):
            reached |= {d for at, d, first in edges if at == k and first in reached}
        assert reached == all_of_it
    assert {d for _, d, _ in edges} <= set().union(*docs.values()) and (buckets > 1 or size <= 6 * n + 3 * 24)


def test_common_shingles_are_counted_over_all_documents(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "HOT_OF", 20)
    monkeypatch.setattr(ngram_jaccard, "CHUNK", 300)
    texts = [f"x{i} y{i} z{i} u{i} " + " ".join(["a b c d"] * (i % 6 == 0) + [f"q{i}", "e f g h"] * (i % 8 == 0)) for i in range(200)]
    counts = {}
    for t in texts:
        for g in ngram_jaccard.shingle_sets([t.encode()])[0].tolist():
            counts[g % (3 << ngram_jaccard.KEY_BITS)] = counts.get(g % (3 << ngram_jaccard.KEY_BITS), 0) + 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = ngram_jaccard.hot_shingles(docs, len(texts), 4, 3).tolist()
    assert got == sorted(g for g, n in counts.items() if n >= 30) and len(got) == 1  # "a b c d" is in 34 of 200, "e f g h" in 25


def test_substring_dedup_holds_one_step_at_a_time(spark):
    """The windows' rows are shuffled and done with before the texts are: what is left to do is one join."""
    left = substring_dedup.dedup_substrings(frame(spark, corpus()), whole=True)
    assert "Window" not in left._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [1_000_000, 1])
def test_ngram_jaccard_indexes_a_class_once(spark, monkeypatch, few):
    """Copies in every partition make no edges, whether their ids are broadcast or shuffled."""
    monkeypatch.setattr(common, "FEW", few)
    monkeypatch.setattr(ngram_jaccard, "FEW", few, raising=False)
    written = []
    monkeypatch.setattr(ngram_jaccard, "materialise", lambda df: written.append(common.materialise(df)) or written[-1])
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(12)]
    rows = [(100 * k + i, t.upper() if k % 2 else t) for k in range(6) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(docs).collect()}
    assert got == {i: (27, i % 100) for i, _ in rows}
    assert [df.count() for df in written if "first" in df.columns] == [0]
