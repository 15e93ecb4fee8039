"""Token counts as delta-maintained rollups with idempotent batch commits.

A store is a folder of committed batches. A batch is a small table of signed totals by
source, language and tokenizer version: an insert adds a document's count, a delete
subtracts it, a revision subtracts the old count and adds the new one, also under
another source, language or version. Totals are the sums over all committed batches,
so batches commute and `fold` replaces old ones by their sum.

A batch's table is written under a name of its own attempt. The batch counts from the moment
that a marker, a small file of its batch id's name that holds the table's name, is moved
into place, in one step that fails where the marker is there already. Then the attempt is
dropped: replaying a batch changes nothing, also with other content under the same id, of
which the first stays. A lost driver leaves nothing half done. One writer at a time may
fold; commits may run beside it.

A null source, language or count is kept: nulls form a group of their own, a null text
counts 0 tokens. Repeated rows count each time.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import bpe, shared

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def counted_words(text: Column) -> Column:
    """Words between white space (bytes 0x20, 0x09-0x0D); a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def with_bpe_counts(docs: DataFrame, path: str, text: str = "text", into: str = "new_tokens") -> DataFrame:
    """docs without the text and with its number of ids in a byte-level BPE tokenizer."""
    rest = [x for x in docs.columns if x not in (text, into)]
    rows = docs.select(*[F.col(f"`{x}`") for x in rest], text)
    schema = rows.drop(text).withColumn(into, F.lit(0).cast("long")).schema

    def count(batches):
        tool = bpe.encoder(path)
        for batch in batches:
            n = [len(x) // 4 for _, part in bpe.text_runs(batch.column(len(rest)).to_pylist()) for x in tool.encode(part)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=schema.names)

    return rows.mapInArrow(count, schema)


def signed(rows: DataFrame, old: Column | None, new: Column | None, old_version: str = "", new_version: str = "") -> DataFrame:
    """Signed counts of rows with source and lang: -1 document under the old version, +1 under the new one."""
    sides = []
    if old is not None:
        sides.append(F.struct(F.lit(old_version).alias("tokenizer"), F.lit(-1).cast("long").alias("n_docs"), F.negative(F.coalesce(old, F.lit(0))).cast("long").alias("n_tokens")))
    if new is not None:
        sides.append(F.struct(F.lit(new_version).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), F.coalesce(new, F.lit(0)).cast("long").alias("n_tokens")))
    return rows.select("source", "lang", F.explode(F.array(*sides)).alias("d")).select("source", "lang", "d.*")


def rolled(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollups:
    """Totals kept in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _marker(self, batch_id: str) -> str:
        if not batch_id or any(not (c.isalnum() or c in "-_") for c in batch_id):
            raise ValueError("a batch id is letters, digits, - and _")
        return f"{self.folder}/batches/{batch_id}"

    def _put(self, marker: str, deltas: DataFrame, folds: list[str]) -> bool:
        table = f"{self.folder}/tables/{uuid.uuid4().hex}"
        rolled(deltas).coalesce(1).write.parquet(table)
        attempt = f"{self.folder}/attempts/{uuid.uuid4().hex}"
        shared.write_text(self.spark, attempt, json.dumps({"table": table, "folds": folds}))
        done = shared.rename(self.spark, attempt, marker)
        if not done:
            shared.remove(self.spark, attempt, table)
        return done

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Adds a batch of signed counts (KEYS, n_docs, n_tokens). False if that id was committed before."""
        marker = self._marker(batch_id)
        return not shared.exists(self.spark, marker) and self._put(marker, deltas, [])

    def _markers(self) -> dict[str, dict]:
        """Committed batches and folds by name, without the tables that a fold stands for."""
        # one small file for each batch, read by the driver; a fold takes the place of many
        found = {name: json.loads(text) for name, text in shared.read_texts(self.spark, f"{self.folder}/batches").items()}
        gone = {x for m in found.values() for x in m["folds"]}
        return {name: m for name, m in found.items() if m["table"] not in gone}

    def fold(self) -> bool:
        """Replaces the tables of all batches by one with their sum. Their ids stay committed."""
        found = self._markers()
        if len(found) < 2:
            return False
        tables = [m["table"] for m in found.values()]
        done = self._put(f"{self.folder}/batches/fold.{uuid.uuid4().hex}", self._rows(tables), tables)
        if done:
            shared.remove(self.spark, *tables)
        return done

    def _rows(self, tables: list[str]) -> DataFrame:
        return self.spark.read.schema(TOTALS).parquet(*tables) if tables else self.spark.createDataFrame([], TOTALS)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups whose documents are all gone are left out."""
        return rolled(self._rows([m["table"] for m in self._markers().values()])).filter("n_docs <> 0 or n_tokens <> 0")


def upserts(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """Signed counts of a batch against the ledger of what is counted now.

    Both hold doc_id, source, lang, tokenizer, n_tokens; the batch also `gone` (true: a
    delete). Of a batch's rows for one doc_id the largest counts, so replays agree. A
    delete of an unknown document changes nothing.
    """
    last = batch.groupBy("doc_id").agg(F.max(F.struct("gone", *KEYS, "n_tokens")).alias("new"))
    both = ledger.select("doc_id", F.struct(*KEYS, "n_tokens").alias("old")).join(last, "doc_id", "right")
    rows = both.select(
        F.array_compact(
            F.array(
                F.when(F.col("old").isNotNull(), F.struct(*[F.col(f"old.{k}").alias(k) for k in KEYS], F.lit(-1).cast("long").alias("n_docs"), F.negative("old.n_tokens").alias("n_tokens"))),
                F.when(~F.coalesce("new.gone", F.lit(False)), F.struct(*[F.col(f"new.{k}").alias(k) for k in KEYS], F.lit(1).cast("long").alias("n_docs"), F.col("new.n_tokens").alias("n_tokens"))),
            )
        ).alias("d")
    )
    return rows.select(F.explode("d").alias("d")).select("d.*")
