"""Line de-duplication over levelled sorted runs of line hashes.

A run is a sorted table (h1, h2, docs): how many documents of some batches hold a line. A
new batch is merge-anti-joined with the lines the runs already know to be frequent, and the
rest is added as a run of level 0; ``fanout`` runs of a level are merged into one run of the
next. So the state grows by sequential writes, every key is rewritten once per level, and
nothing but line hashes is kept.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from beaconry.plans.lineage import scratch_path

# Fixed value: white space stripped from both ends of a line.
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def _hashes(key: Column) -> Column:
    """128 bits of hash in two columns; equal keys always have equal hashes."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class LineRuns:
    """Document counts of line hashes, added batch by batch."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame, level: int) -> None:
        path = scratch_path(self.spark, f"line-run-{level}")
        run.repartitionByRange("h1").sortWithinPartitions("h1", "h2").write.parquet(path)
        self.levels.extend([] for _ in range(level + 1 - len(self.levels)))
        self.levels[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 bigint, h2 bigint, docs bigint").parquet(*paths)

    def _summed(self, paths: list[str]) -> DataFrame:
        return self._read(paths).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"))

    def add(self, batch: DataFrame) -> None:
        """Add (h1, h2, docs) of documents not seen before, at most one row per key."""
        runs = [path for level in self.levels for path in level]
        if runs:
            frequent = self._read(runs).where(F.col("docs") >= self.min_docs).select("h1", "h2")
            batch = batch.join(frequent.hint("merge"), ["h1", "h2"], "left_anti")
        self._write(batch, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._summed(full), level + 1)
            level += 1

    def frequent(self) -> DataFrame:
        """(h1, h2) found in at least ``min_docs`` documents, as a stored table."""
        path = scratch_path(self.spark, "frequent-lines")
        runs = [path for level in self.levels for path in level]
        self._summed(runs).where(F.col("docs") >= self.min_docs).select("h1", "h2").write.parquet(path)
        return self.spark.read.schema("h1 bigint, h2 bigint").parquet(path)


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines whose key occurs in at least ``min_docs`` rows, plus n_lines and n_dropped.

    A null or empty text is one empty line; keys shorter than ``min_chars`` code points always
    stay. Rows that repeat an id, or have none, are documents of their own. A text losing every
    line becomes empty; a text losing none keeps its value, null included. Existing columns
    n_lines and n_dropped are replaced. The result does not depend on ``batches`` or ``fanout``.
    """
    spark = docs.sparkSession
    text = F.col(f"row.`{text_col}`")
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    # A row is found again by a hash of its id and whole text; equal rows lose the same lines.
    rows = docs.select(F.struct("*").alias("row")).withColumns({
        "k1": F.xxhash64(F.col(f"row.`{id_col}`"), text), "k2": F.xxhash64(text, F.col(f"row.`{id_col}`")),
    })
    keys = F.array_distinct(F.filter(F.transform(lines, line_key), lambda k: F.char_length(k) >= min_chars))
    of_rows = rows.select("k1", "k2", F.explode(keys).alias("key")).select("k1", "k2", _hashes(F.col("key")).alias("h")).select("k1", "k2", "h.*")

    path = scratch_path(spark, "line-counts")
    counts = of_rows.groupBy(F.pmod("k1", F.lit(batches)).alias("batch"), "h1", "h2").agg(F.count(F.lit(1)).alias("docs"))
    counts.write.partitionBy("batch").parquet(path)
    counts = spark.read.schema("h1 bigint, h2 bigint, docs bigint, batch bigint").parquet(path)
    runs = LineRuns(spark, min_docs, fanout)
    for batch in range(batches):
        runs.add(counts.where(F.col("batch") == batch).drop("batch"))

    # Only rows with something to drop pass the semi-join; a line in very many rows is split by AQE.
    lost = (
        of_rows.join(runs.frequent().hint("merge"), ["h1", "h2"], "left_semi").groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))
    )
    kept = F.filter(lines, lambda line: ~F.array_contains(F.col("lost"), _hashes(line_key(line))))
    out = rows.join(lost, ["k1", "k2"], "left").withColumn("kept", F.when(F.col("lost").isNotNull(), kept))
    new_text = F.when(F.col("lost").isNotNull(), F.array_join("kept", "\n")).otherwise(text)
    return out.select(
        *[new_text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.size(lines).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(lines) - F.size("kept"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
