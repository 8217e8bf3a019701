"""Line deduplication: which lines of which documents stay, as compressed bitmaps.

A line's key is the line without outer white space, A-Z lower-cased.  Keys of at least ``min_length`` code points that
occur in at least ``min_docs`` documents keep their lines only in the document with the largest id that holds them.

Lines become (hash, document, position) rows.  They are range-partitioned by (hash, document), so that a hash that occurs
everywhere spreads over many partitions, and sorted inside them by hash, document and position.  The first row of each
(hash, document) is streamed off that order without another shuffle; each task counts them by hash and sends one row per
hash onwards.  Texts are never shuffled for the decision; it is returned as one row per document that loses lines, with
64-bit words of the line numbers that stay; words whose lines all stay are left out.

Defined cases: texts of any length are taken whole (one row a line; memory grows with one text); a null text is one empty line; rows that repeat a doc_id count as one document; a null doc_id is a
document of its own that is never the largest; repeated lines inside one document share their fate; other columns are
ignored by the decision and carried by ``apply``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, ascii_lower, let, small_join, stage


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def text_key(text: Column) -> Column:
    """Tells rows with the same doc_id but other texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_rows(docs: DataFrame, min_length: int) -> DataFrame:
    """One row (_pw_hash, _pw_doc, _pw_text, _pw_pos) for each line whose key is long enough."""
    lines = docs.select(F.col("doc_id").alias("_pw_doc"), text_key(F.col("text")).alias("_pw_text"),
                        F.posexplode(split_lines(F.col("text"))).alias("_pw_pos", "_pw_line"))
    keyed = lines.withColumn("_pw_key", F.btrim("_pw_line", F.lit(SPACE))).filter(F.char_length("_pw_key") >= min_length)
    return keyed.select(F.unhex(F.md5(ascii_lower(F.col("_pw_key")))).alias("_pw_hash"), "_pw_doc", "_pw_text", "_pw_pos")


def first_occurrences(lines: DataFrame) -> DataFrame:
    """The first row of each (hash, document), streamed off range partitions sorted by hash, document and position."""
    ranged = lines.repartitionByRange("_pw_hash", "_pw_doc")
    stream = Window.partitionBy("_pw_hash", "_pw_doc").orderBy("_pw_pos")  # the range partitions hold each group whole
    return ranged.withColumn("_pw_nth", F.row_number().over(stream)).filter(F.col("_pw_nth") == 1).drop("_pw_nth")


def bitmaps(docs: DataFrame, min_docs: int = 3, min_length: int = 20) -> DataFrame:
    """(_pw_doc, _pw_text, kept): per document that loses lines, array<struct<word, bits>> in order of word.

    Line ``i`` stays when bit ``i % 64`` of word ``i div 64`` is set; words of lines that all stay are left out.
    """
    lines = stage(line_rows(docs, min_length))
    shared = (first_occurrences(lines).groupBy("_pw_hash").agg(F.count("*").alias("_pw_n"), F.max("_pw_doc").alias("_pw_keep"))
              .filter(F.col("_pw_n") >= min_docs).select("_pw_hash", "_pw_keep"))
    gone = small_join(lines, stage(shared), ["_pw_hash"]).filter(~F.col("_pw_doc").eqNullSafe(F.col("_pw_keep")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_pw_pos") % 64).cast("int"))
    per_word = (gone.withColumn("word", F.floor(F.col("_pw_pos") / 64).cast("int")).repartition("_pw_doc", "_pw_text")
                .groupBy("_pw_doc", "_pw_text", "word").agg(F.bitwise_not(F.bit_or(bit)).alias("bits")))
    return per_word.groupBy("_pw_doc", "_pw_text").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("kept"))


def kept_lines(lines: Column, kept: Column) -> Column:
    """The lines whose bit is set."""
    dense = let(F.map_from_entries(kept), lambda m: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 64).cast("int")),
        lambda w: F.coalesce(F.try_element_at(m, w), F.lit(-1).cast("long"))))
    return let(dense, lambda bits: F.filter(lines, lambda _, i: F.call_function(
        "getbit", F.get(bits, F.floor(i / 64).cast("int")), (i % 64).cast("int")) == 1))


def _decided(docs: DataFrame, min_docs: int, min_length: int) -> DataFrame:
    """All columns of ``docs`` with the decision as ``_pw_keep_bits``, ``_pw_n_lines``, ``_pw_n_dropped`` and ``_pw_kept_text``."""
    marks = bitmaps(docs, min_docs, min_length).withColumnsRenamed({"_pw_doc": "_pw_d", "_pw_text": "_pw_t", "kept": "_pw_keep_bits"})
    own = docs.withColumn("_pw_text", text_key(F.col("text")))
    joined = own.join(marks, F.col("doc_id").eqNullSafe(F.col("_pw_d")) & (F.col("_pw_text") == F.col("_pw_t")), "left")
    text, kept = F.coalesce(F.col("text"), F.lit("")), F.col("_pw_keep_bits")
    count = F.coalesce(F.aggregate(kept, F.lit(0).cast("long"), lambda n, d: n + 64 - F.bit_count(d["bits"])), F.lit(0).cast("long"))
    rest = let(split_lines(F.col("text")), lambda lines: F.array_join(kept_lines(lines, kept), "\n"))
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return joined.select(*[F.col(c) for c in docs.columns], kept, n_lines.cast("long").alias("_pw_n_lines"), count.alias("_pw_n_dropped"),
                         F.when(kept.isNull(), text).otherwise(rest).alias("_pw_kept_text"))


def decide(docs: DataFrame, min_docs: int = 3, min_length: int = 20) -> DataFrame:
    """``docs`` with ``keep_bits`` (null: all lines stay), ``n_lines``, ``n_dropped`` and ``kept_text``; columns so named are replaced."""
    made = ["keep_bits", "n_lines", "n_dropped", "kept_text"]
    return _decided(docs, min_docs, min_length).drop(*made).withColumnsRenamed({f"_pw_{c}": c for c in made})


def apply(docs: DataFrame, min_docs: int = 3, min_length: int = 20) -> DataFrame:
    """``docs`` with the lines gone from ``text`` and ``n_chars`` (if there) counted anew; other columns as they are."""
    lost = F.col("_pw_n_dropped") > 0
    cells = {"text": F.when(lost, F.col("_pw_kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        cells["n_chars"] = F.when(lost, F.char_length("_pw_kept_text").cast("long")).otherwise(F.col("n_chars"))
    return _decided(docs, min_docs, min_length).select([cells[c].alias(c) if c in cells else F.col(c) for c in docs.columns])
