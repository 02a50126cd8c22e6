"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A change row has a sign: +1 for an inserted document, -1 for a deleted one; a revision is the old text with -1 and the
new one with +1 in one batch (`revision`).  A batch is reduced to its sums a group (combined before the shuffle, so a
hot source is no burden) and committed under an id: written aside, then renamed to `deltas/<id>` unless that is there.  A batch whose id is
committed already is skipped, so retries count once (a delta whose id the base holds is not read either); a writer that dies before the rename leaves nothing that is read.
Totals are the sums of the newest base and the later deltas; `compact` folds them into a new base that remembers the
ids, again made visible by one rename.

Cases: null source or language is a group of its own; a null or empty text has 0 tokens and counts as a document;
groups whose documents and tokens cancel out vanish; repeated rows count as often as they come; an empty batch commits; a text of
any length is counted whole, a row at a time; ids and extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._columnar import lean

GROUP = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
_encodings: dict[str, object] = {}


def encoding(path: str, pattern: str):
    """Byte-level BPE from a file of ranks; made once a process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def signed_counts(changes: DataFrame, path: str, pattern: str, version: str, sign: Column | int = 1) -> DataFrame:
    """(source, lang, tokenizer, n_docs, n_tokens) of each change row (source, lang, text), signed."""
    sign = F.lit(sign) if isinstance(sign, int) else sign
    rows = changes.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), sign.cast("long").alias("sign"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            n = np.fromiter((len(enc.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in batch.column(3)), np.int64, batch.num_rows)
            sign = np.asarray(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([version] * batch.num_rows, pa.string()), batch.column(2), pa.array(n * sign)], [*GROUP, "n_docs", "n_tokens"])

    return rows.mapInArrow(lean(run), SCHEMA)


def revision(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change rows with a column sign: what was counted before leaves, what holds now enters."""
    return before.select("source", "lang", "text", F.lit(-1).alias("sign")).union(after.select("source", "lang", "text", F.lit(1).alias("sign")))


class TokenRollup:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _publish(self, staged: str, final: str) -> bool:
        """One rename that fails where `final` is there already, decided by the file system, not by a look beforehand."""
        hadoop, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        self._fs.mkdirs(self._path(final).getParent())
        files = hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(self._path(staged), self._path(final), gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
        except Py4JJavaError:
            if not self._fs.exists(self._path(final)):
                raise
            self._fs.delete(self._path(staged), True)
            return False
        return True

    def _base(self) -> str | None:
        names = self._names("base")
        return f"{self.root}/base/{names[-1]}" if names else None

    def _folded(self, base: str | None) -> set[str]:
        return {r.id for r in self.spark.read.schema("id string").parquet(f"{base}/ids").collect()} if base else set()  # batch names only

    @staticmethod
    def _name(batch_id: str) -> str:
        return hashlib.sha256(batch_id.encode()).hexdigest()[:32]

    def committed(self, batch_id: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/deltas/{self._name(batch_id)}")) or self._name(batch_id) in self._folded(self._base())

    def commit(self, batch_id: str, counts: DataFrame) -> bool:
        """Adds a batch of signed counts; False, without evaluating it, if that id is in already."""
        if self.committed(batch_id):
            return False
        staged = f"{self.root}/staging/{uuid.uuid4().hex}"
        counts.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(staged)
        return self._publish(staged, f"{self.root}/deltas/{self._name(batch_id)}")

    def _all(self) -> tuple[DataFrame, list[str], set[str]]:
        """Rows that count, the deltas among them, and the ids the base holds, all from one look at base and deltas."""
        names, base = self._names("deltas"), self._base()  # deltas first: one that is folded meanwhile is in the base that is seen after
        folded = self._folded(base)
        later = [n for n in names if n not in folded]
        paths = [f"{self.root}/deltas/{n}" for n in later] + [f"{base}/totals"] * bool(base)
        if not paths:
            return self.spark.createDataFrame([], SCHEMA), later, folded
        return self.spark.read.schema(SCHEMA).parquet(*paths), later, folded

    @staticmethod
    def _sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        return self._sums(self._all()[0])

    def compact(self) -> None:
        """Folds the deltas seen at the start; one that is committed meanwhile stays a delta."""
        number = len(self._names("base"))
        rows, later, folded = self._all()
        if not later:
            return
        staged = f"{self.root}/staging/{uuid.uuid4().hex}"
        self._sums(rows).write.parquet(f"{staged}/totals")
        self.spark.createDataFrame([(n,) for n in sorted(folded | set(later))], "id string").coalesce(1).write.parquet(f"{staged}/ids")
        if self._publish(staged, f"{self.root}/base/{number:08d}"):
            for n in later:
                self._fs.delete(self._path(f"{self.root}/deltas/{n}"), True)
