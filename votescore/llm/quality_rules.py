"""Quality rules with thresholds that adapt to language and source.

Every document gets counts (words, symbols, repeated lines, repeated passages, words like the one before). From these come four measures in
whole thousandths or tenths. A mergeable quantile sketch per (lang, source) and measure is a histogram over at most
`BINS` whole values: sketches of parts add up to the sketch of the whole, so the first level is built by partial
aggregation, and sketches of a language and of everything are sums of those. Thresholds are quartiles widened by
interquartile ranges; a source with few documents takes the sketch of its language, a language with few takes that
of everything. The filter joins documents and thresholds by (lang, source); the join needs no hint, because the
thresholds are small if there are few sources and the adaptive planner splits hot keys if there are many.

NULL text counts as empty (rejected: too short). NULL lang or source are groups of their own. Repeated rows are
judged alike and each counts in the sketches. An empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votescore.llm.common import let, with_row, written
from votescore.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Values above the last bin count in it.
BINS = 1000
#: Groups with fewer documents use the sketch of the level above.
MIN_ROWS = 100
#: Interquartile ranges beyond a quartile, and the least distance from it, by measure.
REACH = 3
SLACK = {"symbols": 25, "dup_lines": 400, "repeats": 250, "stutter": 100, "word_length": 15}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(words: Column) -> Column:
    """Words covered by 8-word windows that occur at least twice in the same text."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(p: Column) -> Column:
            same = lambda x, i: (
                ((i > 0) & (F.get(p, i - 1)["h"] == x["h"]))
                | ((i < F.size(p) - 1) & (F.get(p, i + 1)["h"] == x["h"])))
            starts = F.sort_array(F.transform(F.filter(p, same), lambda x: x["i"]))
            return F.aggregate(
                starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total")),
                lambda a, x: F.struct(
                    x.alias("last"), (a["total"] + F.least(F.lit(WINDOW), x - a["last"])).alias("total")),
                lambda a: a["total"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, repeated))

    windows = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(windows, covered))


def counts(text: Column) -> Column:
    """Struct of the counts of one text."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        again = F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1))))
        return F.struct(F.size(words).cast("long").alias("n_words"), again.cast("long").alias("n_stutter"),
                        _repeat_words(words).cast("long").alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"),
                        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        let(words, of_words).alias("words"), let(lines, of_lines).alias("lines"),
        (F.char_length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))


def counted(frame: DataFrame, text: str = "text") -> DataFrame:
    """The frame with a struct column `q` of the counts."""
    flat = frame.withColumn("c", F.explode(F.array(counts(F.col(text)))))
    q = {"n_words": "c.words.n_words", "word_chars": "c.word_chars", "n_symbols": "c.n_symbols",
         "n_dup_lines": "c.lines.n_dup_lines", "n_repeat_words": "c.words.n_repeat_words", "n_stutter": "c.words.n_stutter", "n_lines": "c.lines.n_lines"}
    return flat.withColumn("q", F.struct(*[F.col(v).alias(k) for k, v in q.items()])).drop("c")


def measures() -> dict[str, Column]:
    q = lambda name: F.col(f"q.{name}")
    share = lambda part, whole, scale: F.least(
        F.lit(BINS).cast("long"), F.floor(q(part) * scale / F.greatest(q(whole), F.lit(1)))).cast("int")
    return {
        "symbols": share("n_symbols", "word_chars", 1000), "dup_lines": share("n_dup_lines", "n_lines", 1000),
        "repeats": share("n_repeat_words", "n_words", 1000), "stutter": share("n_stutter", "n_words", 1000),
        "word_length": share("word_chars", "n_words", 10),
    }


def base_failed() -> Column:
    return (F.col("q.n_words") < 20) | (F.col("q.n_repeat_words") * 100 > F.col("q.n_words") * 30)


def sketches(stats: DataFrame) -> DataFrame:
    """Histograms per lang, source and measure: at most BINS + 1 rows each."""
    bins = F.explode(F.array(*[
        F.struct(F.lit(name).alias("measure"), value.alias("bin")) for name, value in measures().items()]))
    return stats.select("lang", "source", bins.alias("m")).groupBy(
        "lang", "source", F.col("m.measure").alias("measure"), F.col("m.bin").alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))


def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """n, q1 and q3 per group and measure, from sketches merged to that level."""
    merged = sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")
    ranked = merged.select(
        "*", F.sum("n").over(group.orderBy("bin")).alias("upto"), F.sum("n").over(group).alias("total"))
    quartile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bin")))
    return ranked.groupBy(*by, "measure").agg(
        F.max("total").alias("total"), quartile(1).alias("q1"), quartile(3).alias("q3"))


def _limits(quartiles: DataFrame, by: list[str], level: str) -> DataFrame:
    """One row per group: its size and a struct of limits."""
    spread = REACH * (F.col("q3") - F.col("q1"))
    cells = []
    for name, slack in SLACK.items():
        own = F.col("measure") == name
        cells.append(F.max(F.when(own, F.col("q3") + F.greatest(spread, F.lit(slack)))).alias(f"{name}_high"))
    low = F.col("q1") - F.greatest(spread, F.lit(SLACK["word_length"]))
    cells.append(F.max(F.when(F.col("measure") == "word_length", low)).alias("word_length_low"))
    grouped = quartiles.groupBy(*by).agg(F.max("total").alias(f"{level}_rows"), *cells)
    names = [f"{name}_high" for name in SLACK] + ["word_length_low"]
    return grouped.select(*by, f"{level}_rows", F.struct(*names).alias(f"{level}_limits"))


def thresholds(stats: DataFrame) -> DataFrame:
    """lang, source, limits: the thresholds that hold for each group. The sketches of the groups are written once; the
    sketch of everything is one group, whose limits enter the plan as literals."""
    sketch = cut_lineage(sketches(stats))
    own = _limits(_quartiles(sketch, ["lang", "source"]), ["lang", "source"], "own")
    lang = _limits(_quartiles(sketch, ["lang"]), ["lang"], "lang").withColumnRenamed("lang", "of_lang")
    every = _limits(_quartiles(sketch.withColumn("every", F.lit(1)), ["every"]), ["every"], "every").first()
    names = own.schema["own_limits"].dataType.fields
    literal = F.struct(*[F.lit(every and every.every_limits[f.name]).cast(f.dataType).alias(f.name) for f in names])
    limits = (F.when(F.col("own_rows") >= MIN_ROWS, F.col("own_limits"))
              .when(F.col("lang_rows") >= MIN_ROWS, F.col("lang_limits")).otherwise(literal))
    return own.join(lang, F.col("lang").eqNullSafe(F.col("of_lang"))).select("lang", "source", limits.alias("limits"))


def verdict() -> Column:
    m = measures()
    outlier = m["word_length"] < F.col("limits.word_length_low")
    for name in SLACK:
        outlier = outlier | (m[name] > F.col(f"limits.{name}_high"))
    return ~base_failed() & ~outlier


def _joined(stats: DataFrame, limits: DataFrame) -> DataFrame:
    limits = limits.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    return stats.join(limits, F.col("lang").eqNullSafe(F.col("of_lang"))
                      & F.col("source").eqNullSafe(F.col("of_source")))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every row. The counts are written once, without texts, and read twice."""
    narrow = docs.select("doc_id", "lang", "source", "text")
    stats = cut_lineage(counted(narrow).select("doc_id", "lang", "source", "q"))
    return _joined(stats, thresholds(stats)).select(
        "doc_id", *[F.col(f"q.{name}") for name in COUNTS],
        base_failed().alias("base_failed"), verdict().alias("kept"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """Rows that pass, with all their columns. The rows are written once with their counts, so every text is counted once;
    the thresholds are written too, so the planner knows how small they are and the rows stay where they are."""
    rows = with_row(docs).select("row", F.col("row.lang").alias("lang"), F.col("row.source").alias("source"),
                                 F.col("row.text").alias("text"))
    stats = written(counted(rows).drop("text"), "counted")
    limits = written(thresholds(stats.select("lang", "source", "q")), "thresholds")
    return _joined(stats, limits).where(verdict()).select("row.*")
