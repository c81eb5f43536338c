"""Delta-maintained token counts by source, language and tokenizer version.

The store has two append-only tables, one folder per batch: ``ledger`` holds
signed rows per document (a revision is the old row with sign -1 and the new one
with +1), ``rollup`` their sums per group.  A batch is committed when the
``_SUCCESS`` file of its rollup folder exists, which is written last; only then its
ledger counts.  What a failed attempt has left is overwritten by the next one; a
committed batch is never touched again, so repeating it changes nothing.
Totals are sums of the committed rollups, never a rescan of documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockcast.llm.text import NOT_ALNUM, SPACES, checkpointed, count_words, single_blanks
from dockcast.session import path_exists

KEYS = ("source", "lang", "tokenizer")
# tokenizer versions: what parts their words
TOKENIZERS = {"space_words_v1": SPACES, "alnum_words_v1": NOT_ALNUM}

LEDGER = "doc_id long, source string, lang string, tokenizer string, sign int, n_tokens long"
ROLLUP = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def token_counts(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", lang_col="lang") -> DataFrame:
    """One row per document and tokenizer version; null texts have 0 tokens.  Repeated
    rows each get their rows.  An empty table gives none; other columns are ignored."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counts = [
        F.struct(F.lit(name).alias("tokenizer"), count_words(single_blanks(F.col("text"), parting)).alias("n_tokens"))
        for name, parting in TOKENIZERS.items()
    ]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), text.alias("text")
    )
    return rows.select("doc_id", "source", "lang", F.explode(F.array(*counts)).alias("c")).select(
        "doc_id", "source", "lang", "c.tokenizer", "c.n_tokens"
    )


class Rollup:
    """A rollup store below ``path`` in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, table: str, batch: int) -> str:
        return f"{self.path}/{table}/batch-{batch:012d}"

    def committed(self) -> list[int]:
        """Ids of the committed batches, ascending."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/rollup")
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return sorted(
            int(n.split("-")[1]) for n in names if n.startswith("batch-") and path_exists(self.spark, f"{self.path}/rollup/{n}/_SUCCESS")
        )

    def _read(self, table: str, ddl: str, below: int | None = None) -> DataFrame:
        paths = [self._folder(table, b) for b in self.committed() if below is None or b < below]
        schema = T.StructType.fromDDL(ddl)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def current(self, below: int | None = None) -> DataFrame:
        """Live rows per document: ledger rows whose signs don't cancel out."""
        keys = ["doc_id", *KEYS, "n_tokens"]
        return self._read("ledger", LEDGER, below).groupBy(*keys).agg(F.sum("sign").alias("copies")).where("copies <> 0")

    def commit(self, batch: int, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> None:
        """Apply one batch.

        ``upserts``: token counts (doc_id, source, lang, tokenizer, n_tokens) that
        replace whatever the store holds for their doc_id; several rows of one
        (doc_id, tokenizer) count as copies.  ``deletes``: doc_id rows to take out;
        ids that the store doesn't hold change nothing, repeated ids count once,
        and an id in both is replaced.  Null doc_ids are an id of their own.
        Batches must come in ascending order; a batch below the newest committed
        one is refused, the newest itself may be repeated, which does nothing.
        """
        done = self.committed()
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} is older than the committed batch {done[-1]}")
        if batch in done:
            return
        if upserts is not None:  # counting the texts is the costly part: once
            upserts = checkpointed(upserts.select("doc_id", *KEYS, "n_tokens"))
        touched = [x.select(F.col("doc_id").cast("long").alias("gone")) for x in (upserts, deletes) if x is not None]
        if not touched:
            raise ValueError("a batch needs upserts or deletes")
        gone = reduce(DataFrame.unionByName, touched).distinct()
        live = self.current(below=batch)
        old = live.join(gone, live["doc_id"].eqNullSafe(gone["gone"]), "left_semi")
        rows = old.select("doc_id", *KEYS, (-F.col("copies")).cast("int").alias("sign"), "n_tokens")
        if upserts is not None:
            new = upserts.select(F.col("doc_id").cast("long").alias("doc_id"), *KEYS, F.lit(1).alias("sign"), F.col("n_tokens").cast("long").alias("n_tokens"))
            rows = rows.unionByName(new)
        rows.write.mode("overwrite").parquet(self._folder("ledger", batch))
        delta = self.spark.read.schema(T.StructType.fromDDL(LEDGER)).parquet(self._folder("ledger", batch))
        sums = delta.groupBy(*KEYS).agg(_sum(F.col("sign")).alias("n_docs"), _sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        # the marker that Spark writes last commits the batch
        sums.where("n_docs <> 0 or n_tokens <> 0").write.mode("overwrite").parquet(self._folder("rollup", batch))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over the committed batches;
        groups without documents have no row.  An empty store has no rows."""
        sums = self._read("rollup", ROLLUP).groupBy(*KEYS).agg(_sum(F.col("n_docs")).alias("n_docs"), _sum(F.col("n_tokens")).alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")


def _sum(c: Column) -> Column:
    return F.sum(c.cast("long"))
