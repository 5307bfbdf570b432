"""Delta-maintained token counts by source, language and tokenizer version.

Changes to documents come in batches: an insert adds the document's tokens to its group's totals, a delete takes them
away, and a revision takes the old count away and adds the new one, in whatever groups both are. Each batch is summed to
signed deltas per group and written to a folder of its own attempt; it counts from the moment that this folder is renamed
to the batch's id. A batch that was lost on the way is written again, one that is committed is left alone, and of two
writers of one batch the second finds the name taken and drops its files. So batches are idempotent.

Totals are maintained: ``compact`` adds the deltas of the batches since the last snapshot to that snapshot's totals and
writes the next one, and ``totals`` reads the latest snapshot and the batches after it only. What the driver lists are
names of batches, never documents.

Tokens are counted as ids of public vocabulary files, one file to a tokenizer version; a text is split and looked up once
per version (see ``packing.Encoder``). Sums are pre-aggregated before the shuffle, so a source with a third of all rows
costs one row per task.

Defined cases: null source, language or version are groups of their own; null text has 0 tokens; repeated rows each
count; a group whose documents are all gone disappears from the totals; an empty batch commits nothing but itself; a
delete of what was never inserted makes a negative total, which ``overdrawn`` shows. The file system must rename folders
as a whole, as HDFS and POSIX file systems do.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_batches, checkpoint_folder, durable, give_back
from .packing import encoder

GROUP = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, documents long, tokens long"
COUNTED = "source string, lang string, tokens array<long>"


def counted(docs: DataFrame, paths: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(source, lang, tokens, *keep) of each row of ``docs``: the tokens by each vocabulary file, in the order of ``paths``."""
    schema = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), *[F.col(c) for c in keep], F.col("text").cast("binary").alias("text"))
    out = ", ".join([*(f"`{n}` {t}" for n, t in schema.dtypes[:-1]), "tokens array<long>"])

    def run(batches):
        own = [encoder(p) for p in paths]
        for batch, texts in byte_batches(batches, "text"):
            plain = [(x or b"").decode("utf-8", "replace") for x in texts]
            counts = np.array([e.counts(plain) for e in own], dtype=np.int64).T
            tokens = pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, len(own)), pa.int32()), pa.array(counts.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], tokens], names=[*batch.schema.names[:-1], "tokens"])
        give_back()

    return schema.mapInArrow(run, out)


def change(rows: DataFrame, sign: int, tokenizer: str, version: int = 0) -> DataFrame:
    """Signed rows from ``counted`` rows: documents that are added (1) or taken away (-1), by the ``version``-th count."""
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("documents"), (F.lit(sign) * F.element_at("tokens", version + 1)).alias("tokens"))


def insert(rows: DataFrame, tokenizer: str, version: int = 0) -> DataFrame:
    return change(rows, 1, tokenizer, version)


def delete(rows: DataFrame, tokenizer: str, version: int = 0) -> DataFrame:
    return change(rows, -1, tokenizer, version)


def revise(old: DataFrame, new: DataFrame, tokenizer: str, version: int = 0, new_tokenizer: str | None = None, new_version: int | None = None) -> DataFrame:
    """The old rows' counts out, the new rows' in; also from one tokenizer version to another."""
    return delete(old, tokenizer, version).unionByName(insert(new, new_tokenizer or tokenizer, version if new_version is None else new_version))


def summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Committed deltas and snapshots of their totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _names(self, name: str) -> list[str]:
        path = self._path(name)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in files.listStatus(path)) if files.exists(path) else []

    def _publish(self, attempt: str, name: str) -> bool:
        """Rename a finished attempt, unless another holds the name; whether it was renamed."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        source, goal = self._path(attempt), self._path(name)
        files = source.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.mkdirs(goal.getParent())
        source, goal = files.makeQualified(source), files.makeQualified(goal)
        how = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.NONE
        try:
            hadoop.FileContext.getFileContext(source.toUri(), self.spark._jsc.hadoopConfiguration()).rename(source, goal, how)
        except Exception:
            if not files.exists(goal):
                raise
            files.delete(source, True)
            return False
        return True

    def committed(self, batch_id: str) -> bool:
        if not re.fullmatch(r"[A-Za-z0-9-][A-Za-z0-9_.-]*", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        return batch_id in self._names("deltas")

    def commit(self, batch_id: str, *changes: DataFrame) -> bool:
        """Write the batch's deltas, unless it is committed already; whether it was written now."""
        if self.committed(batch_id):
            return False
        rows = changes[0]
        for more in changes[1:]:
            rows = rows.unionByName(more)
        attempt = f"attempts/{uuid.uuid4().hex}"
        summed(rows).write.parquet(f"{self.folder}/{attempt}")
        return self._publish(attempt, f"deltas/{batch_id}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) over all committed batches."""
        return self._added(self._latest(), self._names("deltas")).where((F.col("documents") != 0) | (F.col("tokens") != 0))

    def overdrawn(self) -> DataFrame:
        """Groups that more was taken from than added."""
        return self.totals().where((F.col("documents") < 0) | (F.col("tokens") < 0))

    def _latest(self) -> int:
        return max((int(n) for n in self._names("snapshots")), default=0)

    def _inside(self, snapshot: int) -> set[str]:
        return {r["batch"] for r in self.spark.read.parquet(f"{self.folder}/snapshots/{snapshot}/batches").collect()} if snapshot else set()

    def _added(self, snapshot: int, names: list[str]) -> DataFrame:
        """The snapshot's totals and the deltas ``names`` that it doesn't hold."""
        inside = self._inside(snapshot)
        paths = [f"{self.folder}/deltas/{n}" for n in names if n not in inside]
        if snapshot:
            paths.append(f"{self.folder}/snapshots/{snapshot}/totals")
        return summed(self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA))

    def compact(self) -> int:
        """Write the next snapshot of the totals; its number. Deltas that it holds are no longer read."""
        last = self._latest()
        names = self._names("deltas")
        if set(names) == self._inside(last):
            return last
        attempt = f"attempts/{uuid.uuid4().hex}"
        self._added(last, names).write.parquet(f"{self.folder}/{attempt}/totals")
        self.spark.createDataFrame([(n,) for n in names], "batch string").write.parquet(f"{self.folder}/{attempt}/batches")
        self._publish(attempt, f"snapshots/{last + 1}")
        return last + 1


def shared_folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/rollup-{uuid.uuid4().hex}"


def replay(docs: DataFrame, folder: str, tokenizers: dict[str, str]) -> DataFrame:
    """Totals of all of ``docs`` by both versions of ``tokenizers`` (name to file), after a history that ends with them.

    Documents come in by the first version, those with doc_id mod 4 = 1 as drafts, the first half of their text. The drafts
    are revised to the whole texts, and the revision is sent twice. Those with remainder 2 are deleted, totals are
    compacted, and they come back. Then all are counted by the second version, too.
    """
    (first, a), (second, b) = tokenizers.items()
    rest = F.pmod("doc_id", F.lit(4))
    whole = durable(counted(docs.withColumn("rollup_rest", rest), [a, b], ("rollup_rest",)))
    draft = counted(docs.where(rest == 1).withColumn("text", F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))), [a])
    of = lambda k: whole.where(F.col("rollup_rest") == k)
    rollup = Rollup(docs.sparkSession, folder)
    draft = durable(draft)
    rollup.commit("insert", insert(whole.where("rollup_rest IS NULL OR rollup_rest <> 1"), first), insert(draft, first))
    for _ in range(2):
        rollup.commit("revise", revise(draft, of(1), first))
    rollup.commit("delete", delete(of(2), first))
    rollup.compact()
    rollup.commit("restore", insert(of(2), first))
    rollup.commit("recount", insert(whole, second, 1))
    return rollup.totals()
