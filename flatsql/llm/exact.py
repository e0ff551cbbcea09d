"""Exact deduplication as a stateful stream, in DataFrame operations only.

A streaming aggregation without watermark keeps, in RocksDB, one entry for each digest and never expires it: the
digest, the largest identifier with its row's locator, the locator of the row that was seen first, and the number
of rows. A locator is the file that holds a row and the row's place in it, so that the text can be read again. Rows
whose digest was seen before are hits; the whole texts of hits are compared, so a collision of digests cannot merge
different texts. Where the state lies in a folder of the caller's, later tables go on from it: a hit on a row of an
earlier table is compared with that row's text, read by its locator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flatsql.llm.common import Scratch, ascii_lower, settings, text_of

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # a store then takes the disk that it fills
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",  # all of an executor's stores together
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}
#: Digests or locators that are sent to all workers take so many bytes at most; beyond, both sides are dealt out by them.
SENT_BYTES = 32 << 20


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _sent(df: DataFrame, row_bytes: int) -> DataFrame | None:
    """df to be broadcast, if its rows are few enough."""
    return F.broadcast(df) if df.count() * row_bytes <= SENT_BYTES else None


def _is_scan(docs: DataFrame) -> bool:
    """Whether every row is one row of a Parquet file, so that its place there tells it from all others."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.nodeName().startswith("LogicalRelation") and plan.relation().toString().lower() == "parquet"


def located(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, Column, Column]:
    """The same rows as files hold them, the files' paths and the locators; what is no Parquet scan is written first."""
    if not _is_scan(docs):
        docs = scratch.write(docs, "content")
    meta = docs.metadataColumn("_metadata")
    return docs, meta["file_path"], F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("at"))


def _seen(spark: SparkSession, base: str, rows_schema: object) -> DataFrame:
    """What the state in the folder holds after it has seen every row of its table "rows": (digest, top, first, group_size)."""
    stream = spark.readStream.schema(rows_schema).parquet(f"{base}/rows/*")
    state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("top"), F.min(F.struct("run", "locator")).alias("first"), F.count("*").alias("group_size"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/updates/batch={number}")

    with settings(spark, STATE):
        query = state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    updates = spark.read.schema(state.schema).parquet(f"{base}/updates")
    return updates.groupBy("digest").agg(F.max("top").alias("top"), F.min("first").alias("first"), F.max("group_size").alias("group_size"))


def _listed(spark: SparkSession, path: str) -> int | None:
    """How many entries a folder has; None: there is none. A file has one."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return len(files.listStatus(target)) if files.exists(target) else None


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, state_dir: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, locator): one row per row of docs.

    Texts are equal when they are after lower-casing A-Z; null counts as empty. Of equal texts the row with
    the largest doc_id stays (a null id is the smallest); of rows that repeat text and id, one stays. locator
    tells rows of one id apart. digest is what the state is keyed by. No row gives no row.

    state_dir: a shared folder that keeps the state. A later call with the same folder goes on from it: its rows are
    held against those of all earlier tables too, which must still lie where they were, under the same column names;
    what earlier calls returned does not change. A digest that different texts of different tables share is an error.
    A call that failed is repeated with the same docs: what it had fed to the state is not fed again.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "exact")
    base = (state_dir or scratch.path("stream")).rstrip("/")
    run = _listed(spark, f"{base}/files") or 0  # a call lists its files last, so those that failed are not counted
    docs, path, locator = located(docs, Scratch(spark, "exact-content") if state_dir is None else _Kept(spark, f"{base}/content/run={run}"))
    text = ascii_lower(text_of(text_col))
    hashed = [digest(text).alias("digest"), F.lit(None).cast("string").alias("sha") if digest is sha256 else sha256(text).alias("sha")]
    made = docs.select(F.col(id_col).alias("doc_id"), *hashed, locator.alias("locator"), F.lit(run).alias("run"))
    if _listed(spark, f"{base}/rows/{run}/_SUCCESS") is None:
        made.write.mode("overwrite").parquet(f"{base}/rows/{run}")
    rows = spark.read.schema(made.schema).parquet(f"{base}/rows/{run}")
    seen = scratch.write(_seen(spark, base, made.schema), "seen")

    hits = seen.where("group_size > 1").select("digest")
    few = _sent(hits, 80)
    bodies = docs.select(digest(text).alias("digest"), text.alias("body"))
    # Equal texts collapse to one pair of bodies before the shuffle, however many copies there are. Few digests are
    # sent to the texts; of many, all texts are compared, which spares the join: a text alone equals itself.
    bodies = bodies if few is None else bodies.join(few, "digest", "left_semi")
    compared = bodies.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("most"))
    clash = scratch.write(compared.where("least <> most").select("digest"), "clash")
    if run:
        _compare_earlier(spark, scratch, base, run, seen, rows, compared, text_col)
    if state_dir is not None:
        docs.select(path.alias("path")).distinct().select(F.xxhash64("path").alias("file"), "path").write.mode("overwrite").parquet(f"{base}/files/run={run}")
    if clash.isEmpty():
        done = rows.join(seen, "digest")
    else:  # the digest of different texts is the same: those rows are grouped by the texts themselves
        again = docs.select(F.col(id_col).alias("doc_id"), digest(text).alias("digest"), text.alias("body"), locator.alias("locator")).join(clash, "digest", "left_semi")
        texts = again.groupBy("digest", "body").agg(F.max(F.struct("doc_id", "locator")).alias("top"), F.count("*").alias("group_size"))
        found = again.join(texts, ["digest", "body"]).select("doc_id", "locator", "top", "group_size", sha256(F.col("body")).alias("sha"), "digest")
        plain = rows.join(clash, "digest", "left_anti").join(seen, "digest")
        done = plain.select("doc_id", "locator", "top", "group_size", "sha", "digest").union(found)
    kept = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("locator") == F.col("top.locator"))
    return done.select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), F.coalesce("sha", "digest").alias("text_sha256"), "locator")


class _Kept(Scratch):
    """A table in the caller's folder, which stays; it is written once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.dir = spark, folder

    def write(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        if _listed(self.spark, f"{self.path(name)}/_SUCCESS") is not None:
            return self.spark.read.schema(df.schema).parquet(self.path(name))
        return super().write(df, name, partition_by)


def _compare_earlier(spark: SparkSession, scratch: Scratch, base: str, run: int, seen: DataFrame, rows: DataFrame, compared: DataFrame, text_col: str) -> None:
    """Reads the rows of earlier tables that this table's rows hit, by their locators, and compares their texts."""
    hit = seen.where(F.col("first.run") < run).join(rows.select("digest").distinct(), "digest", "left_semi").select("digest", "first.locator")
    paths = spark.read.parquet(f"{base}/files").select("file", "path")
    hit = scratch.write(hit.join(paths, F.col("locator.file") == paths["file"]).select("digest", "path", F.col("locator.at").alias("at")), "earlier")
    files = [r[0] for r in hit.select("path").distinct().collect()]  # as many as earlier tables have files, at most
    if not files:
        return
    earlier = spark.read.parquet(*files)
    meta = earlier.metadataColumn("_metadata")
    earlier = earlier.select(meta["file_path"].alias("path"), meta["row_index"].alias("at"), ascii_lower(text_of(text_col)).alias("earlier"))
    both = earlier.join(hit, ["path", "at"]).select("digest", "earlier").join(compared, "digest")
    if not both.where("earlier <> least or earlier <> most").isEmpty():
        raise ValueError("different texts of different tables have the same digest")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None) -> DataFrame:
    """docs with one row of each text: that with the largest doc_id. Rows that repeat both stay as one.

    Null texts count as empty, a null id is the smallest; no row gives no row. state_dir: see exact_duplicates(); rows
    that an earlier table has with a larger doc_id go, too. Few rows that go are sent to the documents by their
    locators; of many, the documents are dealt out by locator.
    """
    scratch = Scratch(docs.sparkSession, "exact-drop")
    docs, _, locator = located(docs, scratch)
    marks = exact_duplicates(docs, id_col, text_col, state_dir=state_dir)
    own = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0))  # no column starts so
    gone = scratch.write(marks.where("not kept").select(F.col("locator.file").alias(f"{own}file"), F.col("locator.at").alias(f"{own}at")), "gone")
    few = _sent(gone, 64)
    placed = docs.select("*", locator["file"].alias(f"{own}file"), locator["at"].alias(f"{own}at"))
    return placed.join(gone.hint("merge") if few is None else few, [f"{own}file", f"{own}at"], "left_anti").drop(f"{own}file", f"{own}at")

