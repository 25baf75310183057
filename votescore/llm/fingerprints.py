"""Merkle fingerprints of documents.

A text is cut into paragraphs (after line ends and sentence ends, and within long ones after 96 characters), paragraphs
are hashed, runs of paragraphs form sections, and the hash of the section hashes is the root. A section ends after a
paragraph whose hash is divisible by `SECTION` (and at the end), so an inserted or changed paragraph touches its own
section and leaves the borders of the others. Equal roots mean equal texts; sections whose hashes differ, and within
them paragraphs, locate edits.

A fingerprint is the root (128 bits) and, behind a colon, 32 bits of each paragraph. The likeness of two fingerprints
is 1 for equal roots, else the number of different paragraphs they share by that of the one with more.

All of it is column expressions. NULL text counts as empty: one paragraph without characters, the same root for all
such texts. Repeated rows get equal fingerprints. An empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votescore.functions.branch import count_at_or_below
from votescore.llm.common import document_key, let

#: Paragraphs of a section on average.
SECTION = 8
#: A paragraph ends behind a line end, behind a full stop, question or exclamation mark and a blank, or where it has
#: grown to so many characters (counted from its own beginning).
LONGEST = 96
_BORDER = rf"(?<=\n)|(?<=[.!?] )|(?<=\G.{{{LONGEST}}})"


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), _BORDER)


def _leaves(text: Column) -> Column:
    return F.transform(paragraphs(text), lambda p: F.xxhash64(p))


def sections(leaves: Column) -> Column:
    """Arrays of paragraph hashes, one per section."""

    def cut(own: Column) -> Column:
        last = F.size(own) - 1
        ends = F.filter(F.transform(own, lambda h, i: F.when((h % SECTION == 0) | (i == last), i)),
                        lambda i: i.isNotNull())
        return let(ends, lambda e: F.transform(e, lambda end, i: let(
            F.when(i == 0, F.lit(0)).otherwise(F.get(e, i - 1) + 1),
            lambda begin: F.slice(own, begin + 1, end - begin + 1))))

    return let(leaves, cut)


def section_hashes(leaves: Column) -> Column:
    return F.transform(sections(leaves), lambda s: F.sha2(F.array_join(F.transform(s, lambda h: F.hex(h)), ",").cast("binary"), 256))


def root(leaves: Column) -> Column:
    return F.substring(F.sha2(F.array_join(section_hashes(leaves), ",").cast("binary"), 256), 1, 32)


def _short(leaves: Column) -> Column:
    """32 bits of each paragraph hash."""
    return F.transform(leaves, lambda h: F.shiftright(h, 32).cast("int"))


def _print(root_: Column, short: Column) -> Column:
    cells = F.transform(short, lambda h: F.substring(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(1 << 32)), 2, 8))
    return F.lower(F.concat(root_, F.lit(":"), F.array_join(cells, "")))


def tree(text: Column) -> Column:
    """Struct of root and short paragraph hashes."""
    return let(_leaves(text), lambda leaves: F.struct(root(leaves).alias("root"), _short(leaves).alias("short")))


def likeness(a: Column, b: Column) -> Column:
    """Of two trees."""

    most = F.greatest(F.size(F.array_distinct(a["short"])), F.size(F.array_distinct(b["short"])))
    shared = F.size(F.array_intersect(a["short"], b["short"]))
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise((shared / most).cast("double"))


def fingerprint(text: Column) -> Column:
    return let(tree(text), lambda t: _print(t["root"], t["short"]))


def edits(frame: DataFrame, old: str, new: str) -> DataFrame:
    """The frame with what differs between two text columns: sections of either text that the other lacks, and the
    numbers of the paragraphs of either that the other lacks, found within those sections only."""
    a, b = _leaves(F.col(old)), _leaves(F.col(new))

    def lacking(mine: Column, other: Column) -> Column:
        return let(F.array_distinct(other), lambda known: F.filter(
            F.transform(mine, lambda h, i: F.when(~F.array_contains(known, h), i)), lambda i: i.isNotNull()))

    sections_of = lambda mine, other: F.array_except(section_hashes(mine), section_hashes(other))
    return frame.select(
        "*", (root(a) == root(b)).alias("equal"),
        F.size(sections_of(a, b)).alias("sections_lost"), F.size(sections_of(b, a)).alias("sections_new"),
        lacking(a, b).alias("paragraphs_lost"), lacking(b, a).alias("paragraphs_new"))


# --- each document against its edited text and the next document -----------------------------------


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, tree, next_text, next_tree: the next document by doc_id, and the first after the last.

    Texts move once, into blocks of consecutive ids, within which a window looks ahead. There are four blocks for each
    shuffle partition (and as many for NULL ids, by hash of the text), with borders at quantiles of the ids. The last
    row of a block sees the first document of the next one, of which a copy stands at its end; the driver holds
    the ids of these first documents, one per block.
    """
    spark = docs.sparkSession
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # some for each task, to even out their sizes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", document_key(F.col("doc_id"), F.col("text")))
    shares = [i / blocks for i in range(1, blocks)]
    borders = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, 100 * blocks).alias("b")).first().b or []))
    nameless = F.floor((F.shiftright("key", 48) + 32768) * blocks / 65536) - blocks
    block = F.when(F.col("doc_id").isNull(), nameless).otherwise(count_at_or_below(F.col("doc_id") - 1, borders))
    blocked = rows.withColumn("block", block.cast("int"))

    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "key")).alias("o")
    heads = sorted(blocked.select("block", "doc_id", "key").groupBy("block").agg(least).collect())
    ahead = spark.createDataFrame(
        [(before.block, head.o.doc_id, head.o.key) for before, head in zip(heads, heads[1:] + heads[:1])],
        "target int, head_id long, head_key long")
    copies = (blocked.join(F.broadcast(ahead), (F.col("key") == F.col("head_key")) & F.col("doc_id").eqNullSafe(F.col("head_id")))
              .select("doc_id", "text", "key", F.col("target").alias("block"), F.lit(True).alias("copy"))
              .dropDuplicates(["block"]))
    every = blocked.withColumn("copy", F.lit(False)).unionByName(copies).withColumn("tree", tree(F.col("text")))
    look = Window.partitionBy("block").orderBy("copy", F.col("doc_id").asc_nulls_first(), "key")
    return every.select("doc_id", "text", "tree", "copy", F.lead("text").over(look).alias("next_text"),
                        F.lead("tree").over(look).alias("next_tree")).where("not copy").drop("copy")


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last quarter taken from the next document), and how like
    they are to each other and to the next document's."""
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - quarter),
                      F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = with_next(docs).select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "tree", "next_tree",
                                  F.explode(F.array(edited)).alias("edited"))
    rows = rows.select("*", F.explode(F.array(tree(F.col("edited")))).alias("edited_tree"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        _print(F.col("tree.root"), F.col("tree.short")).alias("fingerprint"),
        _print(F.col("edited_tree.root"), F.col("edited_tree.short")).alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        likeness(F.col("tree"), F.col("next_tree")).alias("near_next"))
