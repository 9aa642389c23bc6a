"""Chat formatting in Spark expressions: sort collected turns, merge neighbours of one role, concatenate.

A block is `### role: ` then `<turn>text` for each of its turns, then `</turn>` and a line end. In roles and texts a
backslash, `<` and `#` are written as backslash b, l and h, so no marker can appear in them and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, TURN, END = "### ", "<turn>", "</turn>\n"
LEARNED = "assistant"


def escape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame) -> DataFrame:
    """Per conv_id: conv_id, formatted, segments array<struct<text, loss>>, which joined are `formatted`.

    loss marks the escaped texts of the assistant's turns and nothing else. Turns are sorted by turn (null first), then
    role, then text; null roles and texts are empty. Neighbours of one role share a block. Rows with null conv_id form a
    conversation. Repeated rows are repeated turns. Empty table: no rows. A conversation is one row by nature: it must
    fit in a row; within a task, conversations pass one at a time.
    """
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    n = F.size("t")
    role = lambda i: F.get(F.col("t"), i)["role"]
    own = own.withColumn("starts", F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (role(i) != role(F.greatest(i - 1, F.lit(0))))))
    stop = lambda j: F.coalesce(F.get(F.col("starts"), j + 1), n)
    blocks = F.transform("starts", lambda i, j: F.struct(role(i).alias("role"), F.slice(F.col("t"), i + 1, stop(j) - i).alias("turns")))
    plain = lambda x: F.struct(x.alias("text"), F.lit(False).alias("loss"))

    def block(b: Column) -> Column:
        said = F.flatten(F.transform(b["turns"], lambda t: F.array(plain(F.lit(TURN)), F.struct(escape(t["text"]).alias("text"), (b["role"] == LEARNED).alias("loss")))))
        return F.concat(F.array(plain(F.concat(F.lit(HEAD), escape(b["role"]), F.lit(": ")))), said, F.array(plain(F.lit(END))))

    own = own.withColumn("segments", F.flatten(F.transform(blocks, block)))
    return own.select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id and turns array<struct<role, text>> from the column `formatted` alone."""
    blocks = F.filter(F.split("formatted", F.lit(END)), lambda b: b != "")

    def turns(b: Column) -> Column:
        parts = F.split(b, F.lit(TURN))
        head = F.get(parts, F.lit(0))
        role = unescape(F.substring(head, F.lit(len(HEAD) + 1), F.char_length(head) - len(HEAD) - 2))
        return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return formatted.select("*", F.flatten(F.transform(blocks, turns)).alias("turns"))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from format_chats' output."""
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))
