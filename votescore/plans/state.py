"""Versioned state in buckets, and the record of what has been processed.

Both state tables lie in hash buckets: reputations by account, active votes by post. A commit appends the rows that it changes,
with its version, to a new snapshot, and a reader takes the newest row of a key. So a small batch writes a few rows beside a large
state; a bucket with more than a few such appends is written whole again by the commit that makes the last one. A progress
record then says for every bucket which snapshots hold it.

The record of a version is one file that appears whole, by a step that fails if the file is there (a hard link on a local
disk, a rename elsewhere, which must be atomic: stores without an atomic rename need a file system layer that has one). A
snapshot without a record does not exist for readers, a failed attempt leaves nothing visible, and of two writers that
continue from the same commit exactly one succeeds. The newest version is found by name, and a rewind is a record that names
older snapshots: it reads no state at all. The last `history` commits and as many more at most are kept as whole records; of older ones
lists of blocks, times and counts remain, a file for many commits.
"""

import json
import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from votescore import __version__, schemas


REPUTATION, VOTES = "account_reputations", "active_votes"
KEYS = {REPUTATION: ["account_id"], VOTES: ["author_id", "permlink"]}
ROWS = {REPUTATION: ["account_id"], VOTES: ["author_id", "permlink", "voter_id"]}
SCHEMAS = {REPUTATION: schemas.REPUTATION, VOTES: schemas.ACTIVE_VOTES}
CHANGES = {table: T.StructType([*schema.fields, T.StructField("gone", T.BooleanType()), T.StructField("version", T.LongType())])
           for table, schema in SCHEMAS.items()}
NO_EFFECT = dict(deleted_votes=0, upserted_votes=0, queued_votes=0)

#: Snapshots that hold changes only end so.
_CHANGES = ".changes"
_TIMES = ("started_at", "ended_at")


class StateStore:
    """`buckets` counts for a new store only; it should make buckets of some hundred MB. By default as many as shuffle
    partitions. A bucket is written whole after `appends` appends; a rewind goes back `history` commits at least."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, appends: int = 8, history: int = 1000):
        self.spark = spark
        self.root = root.rstrip("/")
        self.new_buckets = buckets
        self.appends = appends
        self.history = history

    def create(self) -> "StateStore":
        """Version 0: empty state before the first block. An existing store is left as it is."""
        if self.latest() is None:
            count = self.new_buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            nothing = {str(b): [] for b in range(count)}
            now = datetime.now()
            self._record(dict(
                version=0, snapshot="", reputation_in=nothing, votes_in=nothing, source="", batch_id=-1, batches={},
                first_block=0, last_block=0, last_op=0, **NO_EFFECT, started_at=now, ended_at=now, pipeline_version=__version__))
        return self

    def _files(self):
        """The Hadoop file system of the store."""
        return self._hadoop(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _named(self, folder: str) -> list[int]:
        """Versions by the names of the files in a folder."""
        files, path = self._files(), self._hadoop(f"{self.root}/{folder}")
        if not files.exists(path):
            return []
        names = [f.getPath().getName() for f in files.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def versions(self) -> list[int]:
        """Committed versions with a whole record."""
        return self._named("progress")

    def _record_path(self, version: int, folder: str = "progress") -> str:
        return f"{self.root}/{folder}/{version:012d}.json"

    def progress(self) -> DataFrame:
        """One row per commit."""
        found = [f"{self.root}/{folder}/[0-9]*.json" for folder in ("history", "progress") if self._named(folder)]
        return self.spark.read.schema(schemas.PROGRESS).json(found) if found else self.spark.createDataFrame([], schemas.PROGRESS)

    def record(self, version: int) -> Row:
        stream = self._files().open(self._hadoop(self._record_path(version)))
        try:
            row = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        at = {k: datetime.fromisoformat(row[k]).astimezone().replace(tzinfo=None) for k in _TIMES}
        return Row(**(row | at))

    def latest(self) -> Row | None:
        versions = self.versions()
        return self.record(versions[-1]) if versions else None

    def reputation(self, at: Row | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Reputation state at a commit, by default the newest, of some buckets or of all."""
        return self._read(REPUTATION, (at or self.latest()).reputation_in, buckets)

    def active_votes(self, at: Row | None = None, buckets: list[int] | None = None) -> DataFrame:
        return self._read(VOTES, (at or self.latest()).votes_in, buckets)

    def _path(self, table: str, snapshot: str) -> str:
        return f"{self.root}/{table}/{snapshot}"

    def _read(self, table: str, held: dict[str, list[str]], buckets: list[int] | None) -> DataFrame:
        wanted = held if buckets is None else {str(b): held[str(b)] for b in buckets}
        places = [(b, snapshot, any(s.endswith(_CHANGES) for s in snapshots))
                  for b, snapshots in wanted.items() for snapshot in snapshots]

        def rows(changed: bool, late: bool) -> DataFrame | None:
            """Rows of buckets with or without changes: the changes, or the whole snapshots."""
            paths = [f"{self._path(table, s)}/bucket={b}" for b, s, c in places if c == changed and s.endswith(_CHANGES) == late]
            return self.spark.read.schema(CHANGES[table] if late else SCHEMAS[table]).parquet(*paths) if paths else None

        whole, before, late = rows(False, False), rows(True, False), rows(True, True)
        if late is None:
            return whole if whole is not None else self.spark.createDataFrame([], SCHEMAS[table])
        if before is not None:
            late = late.unionByName(before.withColumns({"gone": F.lit(False), "version": F.lit(-1).cast("long")}))
        names = SCHEMAS[table].names
        values = [c for c in names if c not in ROWS[table]] + ["gone"]
        newest = late.groupBy(*ROWS[table]).agg(F.max_by(F.struct(*values), "version").alias("newest"))
        merged = newest.where("not newest.gone").select(*[c if c in ROWS[table] else F.col(f"newest.{c}") for c in names])
        return merged if whole is None else whole.unionByName(merged)

    def bucket_of(self, table: str, head: Row, *columns: str) -> Column:
        """The bucket of a row's key, which may stand in other columns."""
        # The hash of a number depends on its type.
        key = [F.col(c).cast(SCHEMAS[table][k].dataType) for c, k in zip(columns or KEYS[table], KEYS[table])]
        return F.pmod(F.xxhash64(*key), F.lit(len(head.reputation_in))).cast("int")

    def touched(self, rows: DataFrame, table: str, head: Row) -> list[int]:
        """Buckets of a table in which the keys of the rows lie: at most one number per bucket."""
        return sorted(r.bucket for r in rows.select(self.bucket_of(table, head).alias("bucket")).distinct().collect())

    def _write(self, frame: DataFrame, table: str, snapshot: str, head: Row) -> set[str]:
        """Writes rows by bucket; returns the buckets that have some."""
        path = self._path(table, snapshot)
        placed = frame.withColumn("bucket", self.bucket_of(table, head))
        # Rebalancing gathers a bucket for its files and splits a bucket with a hot post.
        placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        names = (f.getPath().getName() for f in self._files().listStatus(self._hadoop(path)))
        return {n.removeprefix("bucket=") for n in names if n.startswith("bucket=")}

    def commit(self, head: Row, reputation: DataFrame, active_votes: DataFrame, **batch) -> None:
        """Replaces the state that the commit `head` holds by another one."""
        snapshot = f"{head.version + 1}-{uuid.uuid4().hex}"
        places = {}
        for table, rows in ((REPUTATION, reputation), (VOTES, active_votes)):
            found = self._write(rows, table, snapshot, head)
            places[table] = {b: [snapshot] if b in found else [] for b in head.reputation_in}
        self._follow(head, snapshot, places, **batch)

    def append(self, head: Row, reputation: DataFrame, active_votes: DataFrame, **batch) -> None:
        """Adds the changed rows of a batch to the state that the commit `head` holds. Rows with `gone` are removed."""
        snapshot = f"{head.version + 1}-{uuid.uuid4().hex}"
        changes, places = snapshot + _CHANGES, {REPUTATION: head.reputation_in, VOTES: head.votes_in}
        for table, rows in ((REPUTATION, reputation), (VOTES, active_votes)):
            found = self._write(rows.withColumn("version", F.lit(head.version + 1).cast("long")), table, changes, head)
            held = {b: [*at, changes] if b in found else at for b, at in places[table].items()}
            full = [b for b in found if sum(s.endswith(_CHANGES) for s in held[b]) > self.appends]
            if full:
                whole = self._write(self._read(table, held, [int(b) for b in full]), table, snapshot, head)
                held |= {b: [snapshot] if b in whole else [] for b in full}
            places[table] = held
        self._follow(head, snapshot, places, **batch)

    def _follow(self, head: Row, snapshot: str, places: dict, *, source: str, batch_id: int, first_block: int, last_block: int,
                last_op: int, started_at: datetime, effect: dict | None = None) -> None:
        self._record(dict(
            version=head.version + 1, snapshot=snapshot, reputation_in=places[REPUTATION], votes_in=places[VOTES], source=source,
            batch_id=batch_id, batches=head.batches | {source: max(batch_id, head.batches.get(source, -1))},
            first_block=first_block, last_block=last_block, last_op=last_op, **(effect or NO_EFFECT), started_at=started_at,
            ended_at=datetime.now(), pipeline_version=__version__))
        if len(self.versions()) > 2 * self.history:
            self.expire(self.history)

    def _publish(self, path: str, lines: list[dict]) -> None:
        """Makes a file of JSON lines visible, or fails if there is one."""
        shown = [row | {k: row[k].astimezone(timezone.utc).isoformat(timespec="microseconds") for k in _TIMES} for row in lines]
        files, draft = self._files(), f"{os.path.dirname(path)}/_{uuid.uuid4().hex}"
        out = files.create(self._hadoop(draft), False)
        out.write(bytearray("".join(json.dumps(row) + "\n" for row in shown).encode()))
        out.close()
        taken = FileExistsError(f"{path} was committed by another writer")
        if files.getScheme() == "file":
            local = lambda p: files.makeQualified(self._hadoop(p)).toUri().getPath()
            try:
                os.link(local(draft), local(path))
            except FileExistsError:
                raise taken from None
            finally:
                files.delete(self._hadoop(draft), False)
        elif not files.rename(self._hadoop(draft), self._hadoop(path)):
            files.delete(self._hadoop(draft), False)
            raise taken

    def _record(self, row: dict) -> None:
        """Makes the record of a version visible, or fails if there is one."""
        version = row["version"]
        self._publish(self._record_path(version), [row])
        if version and version - 1 not in self.versions():
            # The commit that this one follows is history: others went on long ago.
            self._files().delete(self._hadoop(self._record_path(version)), False)
            raise FileExistsError(f"version {version} was committed by another writer")

    def expire(self, keep: int = 10) -> int:
        """Deletes what only older commits than the last `keep` hold, and makes their records history; returns how many
        snapshots were touched. A rewind can go back no further than the commits that are kept."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        if not old:
            return 0
        gone, kept_rows, old_rows = set(), [self.record(v) for v in kept], [self.record(v) for v in old]
        files = self._files()
        places = lambda rows, field: {(b, s) for r in rows for b, at in r[field].items() for s in at}
        done = max(self._named("history"), default=-1)
        history = [r.asDict() | {"reputation_in": None, "votes_in": None} for r in old_rows if r.version > done]
        if history:
            self._publish(self._record_path(old[-1], "history"), history)
        for version in old:
            files.delete(self._hadoop(self._record_path(version)), False)
        for table, field in ((REPUTATION, "reputation_in"), (VOTES, "votes_in")):
            for bucket, snapshot in places(old_rows, field) - places(kept_rows, field):
                if files.delete(self._hadoop(f"{self._path(table, snapshot)}/bucket={bucket}"), True):
                    gone.add(snapshot)
        return len(gone)

    def rewind(self, fork_block: int) -> Row:
        """Goes back to the newest state before `fork_block`; later snapshots stay where they are.

        Returns the progress row to continue from: operations after its `last_op` must be replayed from a log
        without the orphaned operations.
        """
        head = self.latest()
        # The newest commit below the fork is on the valid chain: a rewind that orphaned it would
        # be a newer commit with an even lower block.
        target = next((r for r in map(self.record, reversed(self.versions())) if r.last_block < fork_block), None)
        if target is None:
            raise ValueError(f"no state before block {fork_block}")
        now = datetime.now()
        self._record(target.asDict() | NO_EFFECT | {
            "version": head.version + 1, "source": head.source, "batch_id": head.batch_id, "batches": head.batches,
            "started_at": now, "ended_at": now})
        return self.latest()


def latest(progress: DataFrame) -> DataFrame:
    """The newest commit (0 or 1 rows)."""
    return progress.orderBy(F.desc("version")).limit(1)
