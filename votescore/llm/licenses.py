"""Licence scan by canonical digests.

Texts are brought to a canonical form: lines that only name a holder dropped, lower case, one spelling for words that licence texts
spell in several ways, punctuation and white space as single blanks. Its SHA-256 is joined with the digests of known
licence texts and notices. A document is looked up as a whole, by its blocks (between blank lines) and by its lines, so
a notice on a line of its own is found as well as a file that is nothing but a licence.

The known digests are a table given by the caller; the planner broadcasts it by its size, and then texts stay where they are
read, and one narrow row per document is shuffled for the result.

NULL and empty texts and lines without a word match nothing. Repeated rows are found alike, each with a row of its own
in the result. Several known names for one digest are all reported. An empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votescore.llm.common import let, written
from votescore.llm.known_licenses import NOTICES, SPELLINGS, TEXTS

#: Words of terms and of sentences. A line with one of them is text, whatever else it says.
_TERMS = (
    "no|not|nor|use|used|uses|using|user|users|commercial|noncommercial|may|must|shall|will|can|cannot|is|are|be|been|was|were|has|have|"
    "permission|permissions|permitted|permit|permits|granted|grant|grants|required|require|requires|forbidden|prohibited|"
    "license|licensed|licenses|licence|licenced|licences|licensing|without|except|unless|only|any|notice|notices|holder|holders|"
    "owner|owners|hereby|provided|subject|under|copies|copy|copied|copying|distribute|distributed|distribution|"
    "redistribute|redistributed|redistribution|modify|modified|modification|modifications|sold|sell|sale|contract|contracts|"
    "terms|agreement|restrict|restricted|restrictions|warranty|warranties|liable|liability|claim|claims|assign|assigned|"
    "assignment|sublicense|derivative|reproduce|reproduced|consent|written|conditions|disclaimer|infringement|that|which|if|but|this")
#: What follows `copyright` in the sentences of licences.
_IN_SENTENCES = "and|or|in|of|to|for|as|on|with|laws?|statements?|interests?|protection|information|treaty|treaties|rights?|doctrines?|works?|status|acts?"
_MARK = r"(?i:copyright|\(c\)|©)(?![\p{L}\p{N}]{2})"
_MARKS = _MARK + r"(?:[ \t:,.]*" + _MARK + ")*"
_YEARS = r"[\[<{]?(?:[0-9]{4}|(?i:yyyy|year))[\]>}]?(?:[ \t]*[-–,][ \t]*(?:[0-9]{2,4}|(?i:present)))*(?![\p{L}\p{N}])"
_NAME = r"[\p{Lu}\p{Lo}<\[{][^ \t\r\n]*"
#: A line that does nothing but name the holder of the rights, with its line end: marks, years and up to ten words; marks and a
#: name of up to five words that begin with capitals; or the reservation of all rights, alone. In doubt a line is text, so no
#: terms are lost, and it does not matter where a text is wrapped.
COPYRIGHT_LINE = (
    r"(^|\n)[^\p{L}\p{N}\n©(]*(?=[cC©(aA])(?=" + _MARK + r"|(?i:all rights))"
    r"(?![^\n]*(?<![\p{L}\p{N}])(?i:" + _TERMS + r")(?![\p{L}\p{N}]))(?:"
    + _MARKS + r"[ \t:,.]*" + _YEARS + r"(?:[ \t,.]+[^ \t\r\n]+){0,10}"
    + "|" + _MARKS + r"(?![ \t:]+(?i:" + _IN_SENTENCES + r")(?![\p{L}\p{N}]))(?:[ \t:]+(?i:by|the))?[ \t:]+" + _NAME
    + r"(?:[ \t]+(?:(?i:and|of|the|de|von|et|al\.|&)|" + _NAME + r")){0,4}(?:[ \t]+(?i:all rights reserved)[.!]?)?"
    + r"|(?i:all rights reserved)[^\p{L}\p{N}\n]*)[ \t\r]*(?=\n|$)")
_WORD = r"[\p{L}\p{N}]"


def canonical(text: Column) -> Column:
    body = F.lower(F.regexp_replace(text, COPYRIGHT_LINE, "\n"))
    body = F.trim(F.regexp_replace(body, r"[^\p{L}\p{N}]+", " "))
    for other, usual in SPELLINGS.items():
        body = F.replace(body, F.lit(other), F.lit(usual))
    return body


def digest(text: Column) -> Column:
    """NULL for a text without words."""
    return let(canonical(text), lambda c: F.when(c != "", F.sha2(c.cast("binary"), 256)))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, license of (license, text) pairs."""
    pairs = list(TEXTS.items()) + list(NOTICES.items()) if known is None else known
    rows = [(name, text) for name, texts in pairs for text in ([texts] if isinstance(texts, str) else texts)]
    frame = spark.createDataFrame(rows, "license string, text string")
    # Written, so that the planner knows its size.
    return written(frame.select(digest(F.col("text")).alias("digest"), "license").where("digest is not null").distinct(), "known-digests")


def _units(text: Column) -> Column:
    """Array of (kind, text): 0 the document, 1 its blocks if there are several, 2 its lines if there are several."""
    kind = lambda k, parts: F.when(F.size(parts) > 1, F.transform(
        F.filter(parts, lambda p: p.rlike(_WORD)), lambda p: F.struct(F.lit(k).alias("kind"), p.alias("text")))
    ).otherwise(F.array().cast("array<struct<kind:int,text:string>>"))
    whole = F.array(F.struct(F.lit(0).alias("kind"), text.alias("text")))
    return F.concat(whole, kind(1, F.split(text, r"\n[ \t\r]*\n")), kind(2, F.split(text, "\n")))


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, whole (licences that the entire text is), found (licences of the text, its blocks and lines) and
    n_notices (blocks and lines that are known) of every row; the lists are sorted and joined by commas."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    units = rows.select("doc_id", "row", F.explode(_units(F.col("text"))).alias("u"))
    looked = units.select("doc_id", "row", "u.kind", digest(F.col("u.text")).alias("digest")).join(
        known, "digest", "left")
    hit = F.col("license").isNotNull()
    names = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("license")))), ",")
    return looked.groupBy("row", "doc_id").agg(
        names(F.col("kind") == 0).alias("whole"), names(hit).alias("found"),
        F.count(F.when(hit & (F.col("kind") > 0), 1)).alias("n_notices")).drop("row")
