"""Stages of the corpus pipeline on small tables."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from sylvaframe.llm import mixing


def test_mixing_writes_each_document_as_often_as_it_has_copies(spark, tmp_path):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    rows, labels = [(None, "w1 w2", None, "s", 5), (None, "w3 w4", "en", "s", 5), (5000, None, "en", "s", 0)], []
    for i in range(1000):
        kind = 0 if i < 20 else 1 if i < 320 else 2
        text = " ".join([rnd.choice(words) for _ in range(40)] + [["awful"], ["***"], ["w0"]][kind])
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 0 if kind == 1 else 1, 1 if kind == 0 else 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    table.write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.stage_mixing(spark, docs, str(tmp_path))
    got = [tuple(r) for r in out.collect()]
    assert out.columns == list(corpus_pipeline.COLUMNS) and set(got) <= set(rows)
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(docs, table).collect()}
    assert Counter(r[0] for r in got if r[0] is not None) == {i: n for i, n in copies.items() if n and i is not None}
    assert Counter(r[1] for r in got if r[0] is None) == {r[1]: copies[None] for r in rows[:2] if copies[None]}
    tokens = Counter("toxic" if r[0] < 20 else "low" if r[0] < 320 else "high" for r in got if r[0] is not None and r[0] < 1000)
    share = [tokens[d] / sum(tokens.values()) for d in mixing.DOMAINS]
    assert all(abs(a - b) < 0.01 for a, b in zip(share, mixing.WEIGHTS)), share
    assert tokens["toxic"] < 20 and tokens["high"] > 680


def test_run_against_brute_force(spark, tmp_path):
    """Each stage on what the one before kept: nulls, letters missing, near copies, shared passages, toxic texts, repeats."""
    import hashlib
    import random

    from tokenizers import Tokenizer

    from sylvaframe.llm import ngram_jaccard, queries

    rnd = random.Random(21)
    words = {"en": "the and of thing with from house water they shall".split(), "de": "der die und nicht straße wasser haus über auch sehr".split()}
    own = lambda k, n: [rnd.choice(words[k]) + (rnd.choice("xyz") * rnd.randint(0, 2)) for _ in range(n)]
    passage = own("en", 60)
    rows, labels = [], []
    for i in range(120):
        lang = "en" if i % 2 else "de"
        text = own(lang, 50)
        if i in (31, 41, 61):
            text[10:10] = passage
        if i % 5 == 0:
            text += ["kurwax"] * 3
        rows.append((i, " ".join(text), lang, "s", 0))
        labels.append((i, 1, int(i % 5 == 0)))
        if i % 20 == 7:
            text[3] = "changed"
            rows.append((1000 + i, " ".join(text), None, "s", 0))
    rows += [(2000, None, "en", "s", 0), (2001, " 12 ... ", "en", "s", 0), (2002, "", None, None, None), rows[1], (None, "the house and the water of the thing", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("component_id", F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        held[name] = now.collect()
    first = {(r.doc_id, r.text) for r in held["language_id"]}
    assert first == {(i, t) for i, t, *_ in rows if i not in (2000, 2001, 2002)}
    assert all(r.lang is not None for r in held["language_id"])
    sets = {i: ngram_jaccard._shingles(t.encode(), 5) for i, t in first if i is not None}
    up = {i: i for i in sets}
    for _ in range(3):
        for i, a in sets.items():
            for j, b in sets.items():
                if 100 * len(a & b) >= 80 * len(a | b):
                    up[i] = up[j] = min(up[i], up[j])
    second = sorted((r.doc_id, r.text) for r in held["ngram_jaccard"] if r.doc_id is not None)
    assert second == sorted((i, t) for i, t in first if i is not None and up[i] == i) and len(second) == 120
    seen, third = {}, {}
    for i, t in second:
        w = t.split()
        for s in range(len(w) - 12):
            seen.setdefault(tuple(w[s : s + 13]), i)
    for i, t in second:
        w = t.split()
        gone = {j for s in range(len(w) - 12) if seen[tuple(w[s : s + 13])] < i for j in range(s, s + 13)}
        third[i] = " ".join(x for j, x in enumerate(w) if j not in gone)
    assert {r.doc_id: r.text for r in held["substring_dedup"] if r.doc_id is not None} == third and third[41].split() != dict(second)[41].split()
    kept = {}
    for r in held["mixing"]:
        kept[r.doc_id] = kept.get(r.doc_id, 0) + 1
        assert r.doc_id is None or r.text == third[r.doc_id]
    told = {r.doc_id: r.copies for r in mixing.mix_sources(spark.read.parquet(f"{tmp_path}/substring_dedup"), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert kept == {i: n for i, n in told.items() if n}
    tokens = Tokenizer.from_file(queries.vocabulary())
    for r in held["bpe"]:
        text = third.get(r.doc_id, rows[-1][1])
        ids = tokens.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert {r.doc_id for r in held["bpe"]} == set(kept)
    empty = spark.createDataFrame([], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0


def test_a_written_table_leaves_no_shuffle_files(spark):
    from sylvaframe.llm.common import materialise

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    count = lambda: sum(disk.getAllFiles().apply(i).getName().startswith("shuffle_") for i in range(disk.getAllFiles().size()))
    before, was = count(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    assert materialise(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == was
    new = count() - before
    assert new <= 2, new  # of the count of what was written, which is one task's


def test_near_copies_go_without_a_shuffle_of_texts(spark):
    words = lambda i: " ".join(f"a{i}b{j}" for j in range(30))
    rows = [(1, words(1)), (2, words(1)), (3, words(3)), (3, words(3)), (4, words(4)), (None, words(4)), (None, words(4)), (6, None), (7, words(7)), (7, words(7)), (5, words(7))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.stage_ngram_jaccard(spark, docs, "")
    assert Counter(tuple(r)[:2] for r in out.collect()) == Counter([(1, words(1)), (3, words(3)), (4, words(4)), (None, words(4)), (None, words(4)), (6, None), (5, words(7))])
    # Only repeated ids may be brought together, and so few of them are picked out before their texts move.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "SortMergeJoin" not in plan


def test_batches_for_workers_are_small_and_change_no_result(spark):
    import pyarrow as pa

    from sylvaframe.llm import bpe, queries
    from sylvaframe.llm.common import BATCH_BYTES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    words = lambda i, n=40: " ".join(f"a{i % 150}b{j}" for j in range(n))
    rows = [(i, words(i) + " x" * (i % 3), "en", "s", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    found = lambda: [sorted(map(tuple, stage(spark, docs, "").collect())) for name, stage in corpus_pipeline.STAGES if name != "mixing"]
    spark.conf.unset(key)
    try:
        bpe.bpe(docs, queries.vocabulary())

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

        told = [r.n for r in spark.range(40, numPartitions=1).selectExpr("repeat('0123456789', 50000) AS text").mapInArrow(sizes, "n long").collect()]
        assert sum(told) >= 20_000_000 and max(told) <= BATCH_BYTES + 600_000, told
        large = found()
        spark.conf.set(key, "3000b")
        assert found() == large and spark.conf.get(key) == "3000b"
    finally:
        spark.conf.unset(key)
