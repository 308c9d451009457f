"""Review state that stays as small as its keys: a snapshot and the changes since.

Layout under one folder of the shared file system::

    log/query_id=.../batch_id=...   changed states, as the streaming job writes them
    snapshots/<name>                one row per key
    manifest/<number>.json          which snapshot counts, and which batches it holds

A batch is in the log or in the snapshot that the last manifest names, never in
both.  ``compact`` folds the log into a new snapshot, and only then names it, by
creating the next manifest file (which fails if another compaction did so first).
A crash before that leaves a snapshot that nothing names; a crash after it leaves
files that nothing reads.  Both go with the next compaction.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.review import KIND, RELOADED, fold, live

NOT_STATE = ("query_id", "batch_id")


class ReviewStore:
    """One job's review state.  The states of ``fold`` (one row per key, with the
    order of its last event) are what is stored; ``latest`` applies reloads."""

    def __init__(self, spark: SparkSession, path: str, key: str = "item_key", order: tuple[str, ...] = ("ts", "seq")):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, tuple(order)
        self.log = f"{self.path}/log"
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------- files
    def _names(self, folder: str) -> list[str]:
        p = self._Path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _delete(self, path: str) -> None:
        self._fs.delete(self._Path(path), True)

    def manifest(self) -> dict:
        """The last manifest: ``number``, ``snapshot`` (None at first), ``held`` ({query: [batches]})."""
        numbers = sorted(int(n[:-5]) for n in self._names(f"{self.path}/manifest") if n.endswith(".json") and n[:-5].isdigit())
        if not numbers:
            return {"number": 0, "snapshot": None, "held": {}}
        stream = self._fs.open(self._Path(f"{self.path}/manifest/{numbers[-1]:08d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _name(self, manifest: dict) -> bool:
        """Creates the manifest file; False if there is one of that number."""
        tmp = self._Path(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(tmp, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        done = False
        final = self._Path(f"{self.path}/manifest/{manifest['number']:08d}.json")
        try:
            done = not self._fs.exists(final) and self._fs.rename(tmp, final)
        finally:
            self._fs.delete(tmp, False)
        return bool(done)

    def _batches(self) -> dict[str, list[int]]:
        out = {}
        for q in self._names(self.log):
            if q.startswith("query_id="):
                ids = [int(b.split("=")[1]) for b in self._names(f"{self.log}/{q}") if b.startswith("batch_id=")]
                out[q.split("=")[1]] = sorted(ids)
        return out

    def pending(self, manifest: dict | None = None) -> dict[str, list[int]]:
        """Batches in the log that the last snapshot does not hold."""
        held = (manifest or self.manifest())["held"]
        left = {q: [b for b in ids if b > held.get(q, -1)] for q, ids in self._batches().items()}
        return {q: ids for q, ids in left.items() if ids}

    # ------------------------------------------------------------- state
    def _rows(self, manifest: dict) -> DataFrame | None:
        parts = [f"{self.log}/query_id={q}/batch_id={b}" for q, ids in self.pending(manifest).items() for b in ids]
        frames = []
        if manifest["snapshot"]:
            frames.append(self.spark.read.parquet(f"{self.path}/snapshots/{manifest['snapshot']}"))
        if parts:
            frames.append(self.spark.read.parquet(*parts))
        if not frames:
            return None
        return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])

    def states(self) -> DataFrame:
        """One row per key, whatever is in the log."""
        rows = self._rows(self.manifest())
        if rows is None:
            raise FileNotFoundError(f"no review state under {self.path}")
        return _last(rows, self.key, self.order)

    def latest(self) -> DataFrame:
        """The review items of today: after the last reload, one row per key."""
        return live(self.states(), self.order).drop(RELOADED, KIND)

    def compact(self, keep_files: int = 8, _crash: str | None = None) -> bool:
        """Folds the log into a new snapshot of at most ``keep_files`` files (by
        state size; AQE makes fewer of small ones).  Returns whether there was
        anything to fold.  Called by the job that writes, between its batches."""
        now = self.manifest()
        pending = self.pending(now)
        if not pending:
            return False
        name = f"{now['number'] + 1:08d}-{uuid.uuid4().hex}"
        _last(self._rows(now), self.key, self.order).coalesce(keep_files).write.parquet(f"{self.path}/snapshots/{name}")
        if _crash == "before":
            raise RuntimeError("crash before the manifest")
        held = {**now["held"], **{q: max(ids) for q, ids in pending.items()}}
        if not self._name({"number": now["number"] + 1, "snapshot": name, "held": held}):
            return False        # another compaction was first; what was written goes with the next one
        if _crash == "after":
            raise RuntimeError("crash after the manifest")
        self.clean()
        return True

    def clean(self) -> None:
        """Removes what the last manifest does not need: held batches, older
        snapshots and manifests.  Readers that began before the compaction keep
        one snapshot and one manifest back."""
        now = self.manifest()
        for q, ids in self._batches().items():
            for b in ids:
                if b <= now["held"].get(q, -1):
                    self._delete(f"{self.log}/query_id={q}/batch_id={b}")
        number = lambda n: int(n[:8])
        for n in self._names(f"{self.path}/snapshots"):
            if number(n) < now["number"] - 1 or (number(n) == now["number"] and n != now["snapshot"]):
                self._delete(f"{self.path}/snapshots/{n}")
        for n in self._names(f"{self.path}/manifest"):
            if n.endswith(".json") and n[:8].isdigit() and number(n) < now["number"] - 1:
                self._delete(f"{self.path}/manifest/{n}")


def _last(rows: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The newest state per key of states that may repeat (a partial aggregate)."""
    others = [c for c in rows.columns if c not in (key, RELOADED, *NOT_STATE)]
    by: Column = F.struct(*order, KIND)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), by).alias("_last"), F.max(RELOADED).alias(RELOADED))
    return last.select(key, *[F.col(f"_last.{c}").alias(c) for c in others], RELOADED)


def run_reviews(stream: DataFrame, store: ReviewStore, checkpoint: str, compact_every: int = 20) -> None:
    """ST6: folds a stream of review events into the store until its input ends.

    Every micro-batch writes the keys that changed; every ``compact_every``
    batches of the job the log is folded into a snapshot, so readers read state
    and at most that many batches, not history."""
    from ..sinks.files import append_ledger_stream
    from .frames import _query_id
    query = _query_id(checkpoint)

    def sink(batch: DataFrame, batch_id: int):
        append_ledger_stream(batch, batch_id, store.log, query)
        if (batch_id + 1) % compact_every == 0:
            store.compact()

    q = (fold(stream, store.key, store.order).writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
