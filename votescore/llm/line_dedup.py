"""Removal of repeated lines: deletion-neighbourhood join.

A line goes if an equal line, or one within one edit (a character inserted, deleted or replaced), stands earlier in
the corpus: smaller doc_id, or same document and smaller line number. Lines are compared as they are, split at \\n.
Lines without a word stay and count for nothing; lines under `min_chars` characters (16 if not said) are compared for equality only,
because one edit makes another word of a short one. A line that goes still counts as an earlier line for others, so
the result does not depend on the order of work.

1. Equal lines are one row from the start (the earliest place and 128 bits of hash of the line).
2. A line has as many variants as characters, so lines that cannot have a partner are set aside first: after one
   edit, two lines share their first or their last half (by the shorter length), and so on within the other half.
   Lines that share no such three quarters with another line end here. This filter loses nothing.
3. The rest emit their deletion neighbourhood as hashes: the line itself and the line without each character. Lines
   are near if one is a variant of the other, or if both lack a character at the same place of an equal variant.
4. Lines meet by variant in order of place, and each takes the earliest it is near to as witness: as many rows as
   variants, never pairs of a group. Equal lines are one, so a variant has at most one line of itself and one for each
   character at each place: its group is bounded by the length of a line, not by the corpus. The edit distance of
   line and witness is verified on the texts.

Of the lines only hashes and places move; texts are dealt by document once, for the lines that passed the filter and
for the result.

NULL text has no lines. Repeated rows (same doc_id and text) are one document and keep the same lines. Different
texts under one doc_id, and NULL ids (which come first), are ordered by a hash of the text. A document may be left
without text; it is not dropped. An empty table gives an empty result.
"""

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votescore.llm.common import document_key, let, packed, replaced_text, sliced, unpacked, with_row, written
from votescore.session import cut_lineage

MIN_CHARS = 16
#: Halvings of the filter.
DEPTH = 2
_WORD = r"[^\x20\x09-\x0D]"


def _id(line: Column) -> Column:
    return F.xxhash64(line)


def _check(line: Column) -> Column:
    return F.xxhash64(F.lit("check"), line)


def _lines(keyed: DataFrame) -> DataFrame:
    """place, id, check, line of every line with a word. Places order the corpus; NULL ids come first. Two hashes of 64
    bits, id and check, are the line: among 10^12 lines the first alone is the same for some 27 000 pairs."""
    split = keyed.select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "key", "line_no").alias("place")
    return split.where(F.col("line").rlike(_WORD)).select(
        place, _id(F.col("line")).alias("id"), _check(F.col("line")).alias("check"), "line")


def _shared_parts(line: Column, depth: int) -> Column:
    """Keys of which two lines share at least one if one edit makes one of the other.

    With r characters left between equal ends, r by the shorter line, the first or the last r / 2 of them are equal
    too. A key holds the shorter length and the ends after `depth` such choices.
    """

    def keys(n: Column) -> Column:
        cells = []
        for shorter in (n, n - 1):
            # Of r characters r >> 1 are taken and (r + 1) >> 1 are left, whichever end they are taken from.
            taken = [F.shiftright(F.shiftright(shorter + ((1 << step) - 1), step), 1) for step in range(depth)]
            for path in range(1 << depth):
                left, right = (sum((x for step, x in enumerate(taken) if (path >> step & 1) == side), F.lit(0))
                               for side in (1, 0))
                cells.append(F.xxhash64(F.lit(path), shorter, F.substring(line, F.lit(1), left),
                                        F.substring(line, n - right + 1, right)))
        return F.array(*cells)

    return let(F.char_length(line), keys)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id of the rows (part, id), sorted, that have a neighbour with the same part. Holds one row between batches."""
    part, ids, before = np.empty(0, np.int64), np.empty(0, np.int64), False
    for batch in batches:
        part = np.concatenate((part, batch["part"].to_numpy()))
        ids = np.concatenate((ids, batch["id"].to_numpy()))
        if not len(part):
            continue
        same = part[1:] == part[:-1]
        met = np.concatenate(([before], same[:-1])) | same if len(same) else np.empty(0, bool)
        yield pa.record_batch([pa.array(np.unique(ids[:-1][met]))], names=["id"])
        before = bool(same[-1]) if len(same) else before
        part, ids = part[-1:], ids[-1:]
    if before:
        yield pa.record_batch([pa.array(ids)], names=["id"])


def _with_partner(lines: DataFrame) -> DataFrame:
    """id and place of the rows (id, place, parts) that share a part with another line."""
    ids = (lines.select(F.explode("parts").alias("part"), "id").repartition("part").sortWithinPartitions("part", "id")
           .mapInArrow(_met, "id long").distinct())
    return lines.select("id", "place").join(ids, "id", "left_semi")


# --- variants --------------------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: `gap` of the line itself.
WHOLE = -1
#: Rows of a neighbourhood in one batch.
EMITTED = 1 << 18


def variant_hashes(line: str) -> np.ndarray:
    """Hash of the line and of the line without its i-th character, for every i, in time linear in its length."""
    codes = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64)
    n = len(codes)
    codes = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    codes ^= codes >> np.uint64(29)
    power = np.full(n, _BASE)
    power[:1] = 1
    power = power.cumprod(dtype=np.uint64)
    before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * power, dtype=np.uint64)))
    # What follows the deleted character moves down by one place: what precedes it is scaled up instead.
    sums = np.concatenate((before[n:] * _BASE, before[:n] * _BASE + (before[n:] - before[1:])))
    return ((sums ^ (sums >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)).view(np.int64)


def _neighbourhood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deletion neighbourhood of each line; `gap` is the place of the deleted character. A long line's rows leave in
    batches of `EMITTED`."""
    for batch in sliced(batches, "line", 1 << 18):
        found = [variant_hashes(line) for line in batch["line"].to_pylist()]
        ends = np.cumsum([len(hashes) for hashes in found])
        hashes = np.concatenate(found)
        del found
        for at in range(0, len(hashes), EMITTED):
            row = np.arange(at, min(at + EMITTED, len(hashes)))
            line = np.searchsorted(ends, row, side="right")
            begin = np.concatenate(([0], ends[:-1]))[line]
            own = pa.array(line)
            yield pa.record_batch(
                [pa.array(hashes[row]), pa.array((row - begin + WHOLE).astype(np.int32)), batch["place"].take(own)],
                names=["variant", "gap", "place"])


def _witnessed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place and witness for each row whose line has an earlier one by this variant. Rows sorted by variant and place."""

    def of(rows: pa.Table) -> pa.RecordBatch:
        variant, place = rows["variant"].to_numpy(), rows["place"].combine_chunks()
        new = np.concatenate(([True], variant[1:] != variant[:-1]))
        other = np.zeros(len(variant), bool)
        for name in ("doc_id", "key", "line_no"):
            part = place.field(name).fill_null(0).to_numpy(zero_copy_only=False)
            other[1:] |= part[1:] != part[:-1]
        other &= ~new
        group = np.cumsum(new) - 1
        met = np.bincount(group, other) > 0  # variants of several lines
        rows = rows.filter(pa.array(met[group]))
        held, longer, shorter, replaced = None, None, None, {}
        places, found = [], []
        for variant, gap, place in zip(*(rows[c].to_pylist() for c in ("variant", "gap", "place"))):
            if variant != held:
                held, longer, shorter, replaced = variant, None, None, {}
            # In order of place, the first that was seen is the earliest.
            if gap == WHOLE:
                near, shorter = longer, place
            else:
                seen = [p for p in (shorter, replaced.setdefault(gap, place)) if p and p != place]
                near = min(seen, key=_order) if seen else None
                longer = longer or place
            if near:
                places.append(place)
                found.append(near)
        kind = rows.schema.field("place").type
        return pa.record_batch([pa.array(places, kind), pa.array(found, kind)], names=["place", "witness"])

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        variant = held["variant"].to_numpy()
        cut = int(np.searchsorted(variant, variant[-1])) if len(variant) else 0  # the last variant may go on
        if cut:
            yield of(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield of(held)


def _order(place: dict) -> tuple:
    return tuple((value is not None, value) for value in place.values())


def near_earlier(lines: DataFrame) -> DataFrame:
    """place of the lines (place, line; one row per different line) that have an earlier line within one edit."""
    place = lines.schema["place"].dataType.simpleString()
    texts = lines.select("place", "line")
    found = (texts.mapInArrow(_neighbourhood, f"variant long, gap int, place {place}")
             .repartition("variant").sortWithinPartitions("variant", "place", "gap")
             .mapInArrow(_witnessed, f"place {place}, witness {place}")
             .groupBy("place").agg(F.min("witness").alias("witness")))
    return (found.join(texts, "place")
            .join(texts.select(F.col("place").alias("witness"), F.col("line").alias("earlier")), "witness")
            .where(F.levenshtein("line", "earlier", 1) >= 0).select("place"))


# --- documents -------------------------------------------------------------------------------------


def _wanted_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place, line of the wanted lines of each document."""
    for batch in sliced(batches, "text"):
        places, lines = [], []
        for doc_id, text, wanted in zip(batch["doc_id"].to_pylist(), unpacked(batch["text"].to_pylist()),
                                        batch["wanted"].to_pylist()):
            own = [place for place in wanted if place["doc_id"] == doc_id]
            split = text.split(b"\n") if own else []
            places += own
            lines += [split[place["line_no"]].decode() for place in own]
        kind = batch.schema.field("wanted").type.value_type
        yield pa.record_batch([pa.array(places, kind), pa.array(lines, pa.string())], names=["place", "line"])


def _results(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Per document: counts and digest, or the text that is left. Lines without a word stay."""
    for batch in sliced(batches, "text"):
        n_lines, n_removed, output = [], [], []
        for doc_id, text, kept in zip(batch["doc_id"].to_pylist(), unpacked(batch["text"].to_pylist()),
                                      batch["kept"].to_pylist()):
            numbers = {k["line_no"] for k in kept or () if k["doc_id"] == doc_id}
            lines = [] if text is None else text.split(b"\n")
            left = [x for i, x in enumerate(lines) if i in numbers or not x.strip()]
            n_lines.append(sum(1 for x in lines if x.strip()))
            n_removed.append(len(lines) - len(left))
            result = b"\n".join(left)
            output.append((None if text is None else result) if whole else hashlib.sha256(result).hexdigest())
        if whole:
            yield pa.record_batch([batch["row"], pa.array(output, pa.binary()).cast(pa.string())], names=["row", "text"])
        else:
            yield pa.record_batch(
                [batch["doc_id"], pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(output, pa.string())],
                names=["doc_id", "n_lines", "n_removed", "kept_sha256"])


def _judged(docs: DataFrame, min_chars: int, *more: str) -> DataFrame:
    """doc_id, packed text, more... and kept: the numbers of the lines that are the first of their kind."""
    lines = _lines(docs.select("doc_id", "key", "text"))
    parts = F.when(F.char_length("line") >= min_chars, _shared_parts(F.col("line"), DEPTH))
    different = written(lines.groupBy("id", "check").agg(F.min("place").alias("place"), F.first(parts).alias("parts")), "lines")
    wanted = cut_lineage(_with_partner(different.where("parts is not null"))).groupBy("place.key").agg(
        F.collect_list("place").alias("wanted"))

    # From here on one plan, in which the texts are dealt once and joined twice.
    dealt = packed(docs.select("doc_id", "key", F.col("text").cast("binary").alias("text"), *more)).repartition("key")
    texts = dealt.select("doc_id", "key", "text").join(wanted, "key").select("doc_id", "text", "wanted").mapInArrow(
        _wanted_lines, f"place {different.schema['place'].dataType.simpleString()}, line string")
    near = near_earlier(texts.dropDuplicates(["place"]))  # repeated rows bring a line twice
    kept = (different.select("place").join(near, "place", "left_anti").groupBy("place.key")
            .agg(F.collect_list(F.struct("place.doc_id", "place.line_no")).alias("kept")))
    return dealt.join(kept, "key", "left").select("doc_id", "text", *more, "kept")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines (lines with a word), n_removed, kept_sha256 (of the kept text) of every row."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        document_key(docs["doc_id"], docs["text"]).alias("key"), "text")
    return _judged(keyed, min_chars).mapInArrow(
        partial(_results, whole=False), "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def remove_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows and columns, with text (and n_chars, if there) without the removed lines."""
    keyed = with_row(docs).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), document_key(F.col("row.doc_id"), F.col("row.text")).alias("key"),
        F.col("row.text").alias("text"), F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    judged = _judged(keyed, min_chars, "row")
    cleaned = judged.mapInArrow(partial(_results, whole=True),
                                judged.select("row", F.col("text").cast("string")).schema)
    return cleaned.select(replaced_text(docs, F.col("text")))
