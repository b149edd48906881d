"""Lines that many documents repeat, dropped everywhere but in one document.

A line's key is the line without white space at both ends, A-Z in lower case.  Keys of at least
``min_length`` characters that at least ``min_docs`` documents hold lose their lines in all
documents but the one with the largest id.

Lines travel as 128-bit hashes of their keys with the document's id and the line's position,
never as text.  They are range-partitioned by hash, then descending id, then position, and
sorted so inside each task, which makes the first occurrence in the stream the one that stays.
A line that a third of all documents hold is spread over as many tasks as it fills; what a task
sees of a hash is the whole of it, except for the hashes that run over the border of tasks, two
of a task at most, whose documents are counted on their own.  What comes back is a bitmap for
each document with dropped lines: words of 64 positions, a set bit for a line that is kept, and
words that keep all their lines left out.  Bitmaps are joined to the documents and applied there.

Everything is DataFrame expressions.

Cases: a null or empty text is one empty line; rows with the same id are the same document
where documents are counted, and the text's hash tells their bitmaps apart, so each row keeps
its own lines; rows repeated as a whole have the same bitmap; a null id is one document, the
least; all lines of the document that keeps a key stay, however often it holds it; a long text
is one document like any other; an empty table gives an empty result; columns go by number
meanwhile, so none clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

MIN_LENGTH = 40
MIN_DOCS = 5
# The white space that is stripped, and what counts as upper case.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a task's rows in the numbers that Spark gives.
_ROW_BITS = 33


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def text_hash(text: Column) -> Column:
    """Tells rows with the same id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``key, id, of_text, position`` of every line that is long enough; ``docs`` has ``id`` and ``text``."""
    rows = docs.select("id", text_hash(F.col("text")).alias("of_text"), F.posexplode(lines_of(F.col("text"))))
    stripped = rows.select("id", "of_text", F.col("pos").alias("position"), F.btrim("col", F.lit(WHITE)).alias("line"))
    long = stripped.where(F.char_length("line") >= min_length)
    key = F.unhex(F.md5(F.translate("line", UPPER, LOWER)))
    return long.select(key.alias("key"), "id", "of_text", "position")


def ranged(lines: DataFrame) -> DataFrame:
    """Lines in the order of the stream, with the task that each fell to; written, which fixes the borders."""
    order = [F.col("key"), F.desc("id"), F.col("position")]
    # Copies of a whole row are told apart by a salt, or they would all go to one task.
    salted = lines.withColumn("salt", F.rand(0)).repartitionByRange(*order, F.col("salt")).drop("salt")
    placed = salted.sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    parts = materialize(placed, "lines")
    return parts.withColumn("task", F.shiftright("row", _ROW_BITS)).drop("row")


def over_borders(parts: DataFrame) -> DataFrame:
    """``key, all_docs, all_last`` of the keys that more than one task holds: less than one a task."""
    edges = parts.groupBy("task").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    held = edges.select("task", F.explode(F.array("low", "high")).alias("key")).distinct()
    several = materialize(held.groupBy("key").count().where("count > 1").select("key"), "borders")
    each = parts.join(F.broadcast(several), "key").select("key", "id").distinct()
    return materialize(each.groupBy("key").agg(F.count("*").alias("all_docs"), F.max("id").alias("all_last")), "borders")


def dropped_lines(parts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``id, of_text, position`` of the lines that go."""
    run = Window.partitionBy("task", "key")
    stream = parts.withColumn("nth", F.dense_rank().over(run.orderBy(F.desc("id"))))
    seen = stream.withColumns({"docs": F.max("nth").over(run), "last": F.max("id").over(run)})
    # Less than one row a task, of a hash and two numbers.
    counted = seen.join(F.broadcast(over_borders(parts)), "key", "left")
    whole = F.col("all_docs").isNull()
    docs = F.when(whole, F.col("docs")).otherwise(F.col("all_docs"))
    last = F.when(whole, F.col("last")).otherwise(F.col("all_last"))
    return counted.where((docs >= min_docs) & ~F.col("id").eqNullSafe(last)).select("id", "of_text", "position")


def bitmaps(dropped: DataFrame) -> DataFrame:
    """``id, of_text, keep``: the words of 64 lines that do not keep them all, in order."""
    word = F.floor(F.col("position") / F.lit(64)).cast("int").alias("word")
    words = dropped.groupBy("id", "of_text", word).agg(
        F.bitwise_not(F.expr("bit_or(shiftleft(1L, position % 64))")).alias("bits")
    )
    return words.groupBy("id", "of_text").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """Bitmaps of the documents that lose lines; ``of_text`` is ``text_hash`` of the row's text."""
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = ranged(hashed_lines(named, min_length))
    return materialize(bitmaps(dropped_lines(parts, min_docs)), "bitmaps")


def applied(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_n_lines``, ``_n_dropped`` and ``_kept``, the text without its dropped lines."""
    columns = {"_id": F.col(id_col).cast("long"), "_of_text": text_hash(F.col(text_col))}
    numbered = docs.withColumns(columns)
    joined = numbered.join(
        kept.withColumnRenamed("id", "_kept_id"),
        F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_of_text") == F.col("of_text")),
        "left",
    )
    lines = joined.withColumns({"_lines": lines_of(F.col(text_col)), "_words": F.map_from_entries("keep")})
    every = F.sequence(F.lit(0), F.expr("int((size(_lines) - 1) div 64)"))
    dense = F.when(F.col("keep").isNotNull(), F.transform(every, lambda w: F.coalesce(F.element_at("_words", w), F.lit(-1).cast("long"))))
    flat = lines.withColumn("_bits", dense)
    # The words are used twice, so that they are put together once and not for every line.
    lost = F.aggregate("_bits", F.lit(0), lambda n, bits: n + F.bit_count(F.bitwise_not(bits)))
    stay = F.expr("filter(_lines, (l, i) -> shiftright(_bits[i div 64], i % 64) & 1L = 1L)")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return flat.select(
        *[F.col(c) for c in docs.columns],
        F.size("_lines").cast("long").alias("_n_lines"),
        F.coalesce(lost, F.lit(0)).cast("long").alias("_n_dropped"),
        F.when(F.col("_bits").isNull(), text).otherwise(F.array_join(stay, "\n")).alias("_kept"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents, columns as given, with their repeated lines dropped; texts without any as they were."""
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    by, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    found = applied(numbered, keep_bitmaps(numbered, by, text), by, text)
    new = F.when(F.col("_n_dropped") > 0, F.col("_kept")).otherwise(F.col(text)).alias(text)
    return found.select(*[new if c == text else F.col(c) for c in numbered.columns]).toDF(*docs.columns)


def report(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per document: lines, dropped lines, digest of what is kept."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = applied(picked, keep_bitmaps(picked, min_length=min_length, min_docs=min_docs))
    return found.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )
