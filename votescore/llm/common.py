"""Helpers of the corpus operators.

Rows: two rows with the same doc_id and the same text are one document twice; operators treat them alike.
`document_key` stands for that pair where a narrow result is joined back to its text. Ids may be NULL or shared
by different texts; order among documents is by doc_id (NULL first), then by key.
"""

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import votescore
from votescore.session import scratch_path

#: Texts are handled in pieces of about this many bytes inside a Python task.
SLICE_BYTES = 4 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, which import its functions by name, once per application. On a cluster
    `--py-files` does the same."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        root = Path(votescore.__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="votescore-")) / "votescore-package.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        sc.addPyFile(str(archive))


def document_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once per row even if body names it often or in a lambda."""
    return F.transform(F.array(value), body)[0]


def sliced(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that one holds about `most` bytes of text, or a single longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        first, total = 0, 0
        for i, size in enumerate(sizes):
            if i > first and total + size > most:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += size
        yield batch.slice(first)


def packed(docs: DataFrame) -> DataFrame:
    """The frame with its binary column `text` as zstd frames, which are half as large in a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in sliced(batches, "text"):
            small = [None if text is None else pack(text) for text in batch["text"].to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(small, pa.binary()))

    return docs.mapInArrow(run, docs.schema)


def unpacked(texts: list[bytes | None]) -> list[bytes | None]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [None if text is None else unpack(text) for text in texts]


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: smaller than a checkpoint, and columns can be pruned."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def with_row(docs: DataFrame) -> DataFrame:
    """All columns as one struct `row`, so that names of the operator and of the table cannot clash."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


def replaced_text(docs: DataFrame, text: Column) -> list[Column]:
    """The columns of documents from `row`, with another text and its length."""
    return [
        (text if c == "text" else F.char_length(text).cast(docs.schema[c].dataType) if c == "n_chars"
         else F.col(f"row.`{c}`")).alias(c)
        for c in docs.columns
    ]
