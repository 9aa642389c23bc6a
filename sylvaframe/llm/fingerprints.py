"""Winnowing fingerprints, in Spark expressions.

Hashes of K code points in a row; of each W in a row the smallest is chosen, the rightmost of equal ones, with its
position. Texts that share K + W - 1 code points in a row share a chosen hash. Runs of white space count as one space, and
none at the ends; positions count code points of the text so spaced, from 0. Hashes roll: those of 5 code points
in a row are made first, and each of K = 10 of two of them. They have 52 bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 10
W = 25
#: Parts of the id range for each shuffle partition, so that parts even out.
PARTS = 6
#: Places of one piece of a text; a long and so many places share 64 bits.
PLACES = 4096
#: Windows that start in one piece; it also holds the code points that the last of them reaches to.
STEP = PLACES - W + 1
#: Windows that start in one row, where `winnowed` has a column for each code point.
BLOCK = 96
#: Above all hashes with a place.
NOWHERE = (1 << 63) - 1
_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Code points that aren't white space, by few ranges: most text is found to be such, or a single space before such, at once.
_PLAIN = r"[!-~\xa1-\u167f\u1681-\u1fff\u3001-\x{10ffff}]"
#: Most white space is single spaces, which stay as they are: only the rest is found and replaced.
_UNEVEN = rf"(?!{_PLAIN}| {_PLAIN})(?:{_SPACE}{{2,}}|[{_SPACE}&&[^ ]])"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _steps(width: int) -> list[list[int]]:
    """How `width` elements in a row are joined to one, five at a time, then five of those: by step, how far on the others are."""
    steps, reach = [], 1
    while reach < width:
        many = min(5, -(-width // reach))
        steps.append([min(j * reach, width - reach) for j in range(1, many)])
        reach = min(many * reach, width)
    return steps


def _rolled(a: Column, width: int, join: Callable[..., Column], last: Callable[[Column, Column], Column] = lambda x, i: x) -> Column:
    """By place, `width` elements in a row joined to one, by steps. `last` gets each and its place."""

    def joined(a: Column, rest: list[list[int]]) -> Column:
        end = last if len(rest) == 1 else lambda x, i: x
        b = F.transform(a, lambda x, i: end(join(x, *[F.get(a, i + F.lit(j)) for j in rest[0]]), i))
        return b if len(rest) == 1 else _let(b, lambda c: joined(c, rest[1:]))

    return joined(a, _steps(width))


def _placed(x: Column, i: Column) -> Column:
    """A hash above, and the place counted down below: of equal hashes the rightmost is the least."""
    return x.bitwiseAND(F.lit(-PLACES).cast("long")).bitwiseOR((F.lit(PLACES - 1) - i).cast("long"))


def _chosen(piece: Column, number: Column) -> Column:
    """Hashes and positions chosen in the windows that start in one piece of a text."""

    def marked(codes: Column) -> Column:
        n = F.size(codes)
        grams = F.slice(_rolled(codes, K, F.xxhash64, _placed), F.lit(1), n - F.lit(K - 1))
        # A text shorter than a window is one window; of a later piece the piece before has it already.
        windows = F.slice(_let(grams, lambda g: _rolled(g, W, F.least)), F.lit(1), F.greatest(F.lit(1), n - F.lit(K + W - 2)))
        put = lambda x: F.struct(F.shiftright(x, 12).alias("hash"), (F.lit(PLACES - 1) - x.bitwiseAND(F.lit(PLACES - 1).cast("long")) + number.cast("long") * STEP).cast("int").alias("pos"))
        return F.transform(F.array_distinct(windows), put)

    n = F.char_length(piece)
    whole = F.array(F.struct(F.shiftright(F.xxhash64(piece), 12).alias("hash"), F.lit(0).alias("pos")))
    none = F.slice(whole, F.lit(1), F.lit(0))
    return F.when((number > 0) & (n < K + W - 1), none).when(n < K, whole).otherwise(_let(F.split(piece, ""), marked))


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _UNEVEN, " "))


def _once(a: Column) -> Column:
    return F.filter(a, lambda x, i: (i == 0) | (x["pos"] != F.get(a, i - F.lit(1))["pos"]))


def _winnowed(spaced: Column) -> Column:
    # A text is cut in one pass, and worked on piece by piece; each piece reads on into the next.
    cut = lambda t: F.when(F.char_length(t) <= STEP, F.filter(F.array(t), lambda x: x != "")).otherwise(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{STEP}}}"), F.lit(0)))
    onward = lambda p: F.transform(p, lambda x, i: _let(F.concat(x, F.coalesce(F.left(F.get(p, i + F.lit(1)), F.lit(K + W - 2)), F.lit(""))), lambda y: _chosen(y, i)))
    return _let(spaced, lambda t: _let(cut(t), lambda p: _let(F.flatten(onward(p)), _once)))


def winnow(text: Column) -> Column:
    """array<struct<hash: bigint, pos: int>> of the chosen hashes, by position. Fewer than K code points hash as one; none: empty."""
    return _winnowed(_spaced(text))


def winnowed(docs: DataFrame, text: str, near: str) -> DataFrame:
    """docs with winnow(text) as fp. Texts aren't null; the rows of docs are dealt by the column `near`, and stay where they are.

    A text is cut into rows, each of BLOCK windows' starts and what these windows reach to. There every code point, hash
    and window has a column, which Spark compiles; over arrays it would interpret them.
    """
    keys = [c for c in docs.columns if c != text]
    size = BLOCK + K + W - 2
    spaced = _spaced(F.col(text))
    # The text itself goes first, as block 0, so that it doesn't go with every block.
    cut = F.concat(F.array(F.col(text)), F.regexp_extract_all(spaced, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{BLOCK}}}"), F.lit(1)))
    rows = docs.withColumn("_row", F.monotonically_increasing_id()).select(*keys, "_row", F.posexplode(cut).alias("_block", "_piece"))
    kept = [*keys, "_row", "_block", "_text", "_n", "_short"]
    piece, block, n = F.coalesce("_piece", F.lit("")), F.col("_block"), F.col("_n")
    many = round(size**0.5)
    parts = [F.substring(piece, j + 1, many).alias(f"_p{j // many}") for j in range(0, size, many)]
    rows = rows.select(*keys, "_row", "_block", F.when(block == 0, piece).alias("_text"), F.when(block == 0, 0).otherwise(F.char_length(piece)).alias("_n"), _placed(F.xxhash64(piece), F.lit(1)).alias("_short"), *parts)

    def stepped(rows: DataFrame, to: str, values: list[Column]) -> DataFrame:
        return rows.select(*kept, *[x.alias(f"{to}{j}") for j, x in enumerate(values)])

    rows, at, left = stepped(rows, "_c", [F.substring(f"_p{j // many}", j % many + 1, 1) for j in range(size)]), "_c", size
    for width, join in ((K, F.xxhash64), (W, F.least)):
        for k, step in enumerate(_steps(width)):
            left -= step[-1]
            values = [join(*[F.col(f"{at}{j + i}") for i in (0, *step)]) for j in range(left)]
            if join is F.xxhash64 and k == len(_steps(width)) - 1:
                values = [F.when(n >= j + K, _placed(x, F.lit(j + 1))).otherwise(F.lit(NOWHERE)) for j, x in enumerate(values)]
            rows, at = stepped(rows, f"_{join.__name__}{k}_", values), f"_{join.__name__}{k}_"
    # A text shorter than a window is one window; of a later block the block before has it already.
    told = [F.when((n >= K + W - 1) | (block == 1), F.col(f"{at}0")).otherwise(F.lit(NOWHERE))]
    told += [F.when((n >= j + K + W - 1) & (F.col(f"{at}{j}") != F.col(f"{at}{j - 1}")), F.col(f"{at}{j}")).otherwise(F.lit(NOWHERE)) for j in range(1, BLOCK)]
    chosen = F.when((block == 1) & (n < K), F.array("_short")).otherwise(F.array_remove(F.array(*told), F.lit(NOWHERE)))
    rows = rows.select(*keys, "_row", "_text", F.when(block > 0, F.struct("_block", chosen.alias("chosen"))).alias("_chosen"))
    whole = rows.groupBy(near, *[k for k in keys if k != near], "_row").agg(F.first("_text", ignorenulls=True).alias(text), F.sort_array(F.collect_list("_chosen")).alias("_chosen"))
    last = F.lit(PLACES - 1).cast("long")
    put = lambda b: F.transform(b["chosen"], lambda x: F.struct(F.shiftright(x, 12).alias("hash"), (F.lit(PLACES - 2) - x.bitwiseAND(last) + (b["_block"] - 1).cast("long") * BLOCK).cast("int").alias("pos")))
    return whole.select(*docs.columns, _let(F.flatten(F.transform("_chosen", put)), _once).alias("fp"))


def winnow_joined(head: Column, tail: Column, head_fp: Column, tail_fp: Column) -> Column:
    """winnow(head + tail), where texts that begin with head and with tail have been winnowed already to head_fp and tail_fp.

    What a place's windows choose depends on their code points alone. So places whose windows all lie in head, or all in
    tail, are as they were there; windows about the seam and at the end are worked out anew.
    """
    side = K + 2 * W - 3  # code points of all windows that hold a place whose own reach just passes an end
    reach = K + W - 2

    def both(a: Column, b: Column, gap: Column) -> Column:
        n, m = F.char_length(a), F.char_length(b)
        start = n + F.char_length(gap)  # of b in the whole
        before = n - F.least(n, F.lit(side))  # of the code points about the seam
        part = lambda fp, low, high, by: F.transform(F.filter(fp, lambda x: (x["pos"] >= low) & (x["pos"] <= high)), lambda x: F.struct(x["hash"].alias("hash"), (x["pos"] + by).cast("int").alias("pos")))
        # A side too short to have windows of its own is worked out anew as a whole.
        seam = part(_winnowed(F.concat(F.right(a, F.lit(side)), gap, F.left(b, F.lit(side)))), F.when(n < side, 0).otherwise(side - reach), F.when(m < side, 2 * side + 1).otherwise(start - before + W - 2), before)
        end = part(_winnowed(F.right(b, F.lit(side))), F.lit(side - reach), F.lit(side), start + m - side)
        first = part(head_fp, F.lit(0), n - reach - 1, F.lit(0))
        last = F.concat(part(tail_fp, F.lit(W - 1), m - reach - 1, start), end)
        none = F.filter(head_fp, lambda x: F.lit(False))
        return F.concat(F.when(n < side, none).otherwise(first), seam, F.when(m < side, none).otherwise(last))

    gap = lambda a, b: F.when((a != "") & (b != "") & F.concat(F.right(head, F.lit(1)), F.left(tail, F.lit(1))).rlike(_SPACE), F.lit(" ")).otherwise(F.lit(""))
    return _let(_spaced(head), lambda a: _let(_spaced(tail), lambda b: _let(gap(a, b), lambda g: both(a, b, g))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of hashes; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def shown(fp: Column) -> Column:
    """A fingerprint as a string: hash@position, in order."""
    return F.array_join(F.transform(fp, lambda x: F.concat(F.lower(F.hex(x["hash"])), F.lit("@"), x["pos"].cast("string"))), " ")


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _part(cuts: list[int], key: Column) -> Column:
    """How many of the sorted cuts are not above key: first among every so many of them, then among those between."""
    if not cuts:
        return F.lit(0)
    stride = max(1, round(len(cuts) ** 0.5))
    count = lambda a: F.size(F.filter(a, lambda c: c <= key))
    coarse = F.greatest(count(_numbers(cuts[::stride])) - 1, F.lit(0))
    return coarse * stride + count(F.slice(_numbers(cuts), coarse * stride + 1, F.lit(stride)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fp and those of the next doc_id as next_text and next_fp (after the last: the first); ties follow the text.

    The id range is cut at quantiles, so that each part is sorted alone; only the first document of each part goes on to
    the part before. Texts are shuffled without their fingerprints, which are made where the texts arrive.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    parts = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = own.select("doc_id").agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0]
    part = _part(sorted(set(cuts or [])), key)
    # The first id of each part goes on with its text to the part before: as many ids as parts.
    heads = sorted((r["part"], r["id"]) for r in own.select(part.alias("part"), key.alias("id")).groupBy("part").agg(F.min("id").alias("id")).collect())
    dealt = own.select("doc_id", "text", part.alias("part"), F.lit(0).alias("guest"))
    if heads:
        before, firsts = [p for p, _ in [heads[-1], *heads[:-1]]], [i for _, i in heads]
        table = spark.range(1).select(F.explode(F.arrays_zip(_numbers(before).alias("part"), _numbers(firsts).alias("id"))).alias("x")).select(F.col("x.part").cast("int").alias("part"), F.col("x.id").alias("id"))
        dealt = dealt.union(own.withColumn("id", key).join(F.broadcast(table), "id").select("doc_id", "text", "part", F.lit(1).alias("guest")))
    order = Window.partitionBy("part").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    told = winnowed(dealt.repartition("part"), "text", "part")
    led = told.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fp", F.lead("fp").over(order))
    return led.where("guest = 0").select("doc_id", "text", "fp", "next_text", "next_fp")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fp and edited_fp array<struct<hash, pos>>, near_edited, near_next.

    Null text is empty. The edited text: the last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next document. Likeness is the Jaccard likeness of the sets of chosen hashes, 1 if both are empty. A null
    doc_id comes first; repeated rows follow one another; a lone document is followed by itself. Empty table: no rows.
    """
    two = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    two = two.withColumn("head", F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half)).withColumn("tail", F.substring("next_text", F.lit(1), half))
    edited_fp = winnow_joined(F.col("head"), F.col("tail"), F.col("fp"), F.col("next_fp"))
    two = two.select("doc_id", "n_chars", F.sha2(F.concat("head", "tail"), 256).alias("edited_sha256"), "fp", edited_fp.alias("edited_fp"), "next_fp")
    near = lambda other: likeness(F.col("fp.hash"), F.col(f"{other}.hash"))
    return two.select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", near("edited_fp").alias("near_edited"), near("next_fp").alias("near_next"))


def fingerprint_digests(docs: DataFrame) -> DataFrame:
    """The same with fp and edited_fp as strings `fingerprint` and `edited_fingerprint`."""
    return fingerprints(docs).select("doc_id", "n_chars", "edited_sha256", shown(F.col("fp")).alias("fingerprint"), shown(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")
