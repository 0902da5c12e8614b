"""Catalogue maintenance: change detection, upserts, clean-up and status, as joins over table snapshots.

Nothing is updated in place.  Each operator returns the rows of a table's next
version, or what a command would report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(snapshot: DataFrame, scan: DataFrame) -> DataFrame:
    """(collection, path, action) from indexed rows and scanned files (collection, path, hash, title).

    Actions: indexed, updated (text or title differs, or the row was inactive),
    unchanged, removed (an active row that was not seen).
    """
    old = snapshot.select("collection", "path", F.col("hash").alias("old_hash"), F.col("title").alias("old_title"), "active")
    new = scan.select("collection", "path", F.col("hash").alias("new_hash"), F.col("title").alias("new_title"))
    both = old.join(new, ["collection", "path"], "full_outer")
    same = F.col("active") & (F.col("old_hash") == F.col("new_hash")) & F.col("old_title").eqNullSafe(F.col("new_title"))
    action = F.when(F.col("new_hash").isNull(), F.when(F.col("active"), "removed")).when(F.col("old_hash").isNull(), "indexed").when(same, "unchanged").otherwise("updated")
    return both.withColumn("action", action).where("action is not null").select("collection", "path", "action")


def new_content(content: DataFrame, bodies: DataFrame) -> DataFrame:
    """Bodies (hash, doc) that are not stored yet, each once."""
    return bodies.groupBy("hash").agg(F.min("doc").alias("doc")).join(content.select("hash"), "hash", "left_anti")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The next version of documents: new rows win and become active, created_at stays the oldest."""
    kept = old.join(new.select("collection", "path"), ["collection", "path"], "left_anti")
    born = old.select("collection", "path", F.col("created_at").alias("born"))
    fresh = new.join(born, ["collection", "path"], "left").withColumn("created_at", F.coalesce("born", "created_at")).withColumn("active", F.lit(True)).drop("born")
    return kept.unionByName(fresh.select(*old.columns))


def legacy_paths(snapshot: DataFrame, wanted: DataFrame) -> DataFrame:
    """(collection, path, legacy_path): rows to move because only letter case differs and the right path is free."""
    free = wanted.join(snapshot.select("collection", "path"), ["collection", "path"], "left_anti")
    old = snapshot.where("active").select("collection", F.col("path").alias("legacy_path"), F.lower("path").alias("low"))
    found = free.withColumn("low", F.lower("path")).join(old, ["collection", "low"]).where("path <> legacy_path")
    return found.groupBy("collection", "path").agg(F.min("legacy_path").alias("legacy_path"))


def orphaned_content(content: DataFrame, documents: DataFrame, only_active: bool = False) -> DataFrame:
    used = documents.where("active") if only_active else documents
    return content.join(used.select("hash"), "hash", "left_anti")


def orphaned_vectors(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    return vectors.join(documents.where("active").select("hash"), "hash", "left_anti")


def exclusive_hashes(documents: DataFrame, collection: str) -> DataFrame:
    """Hashes that active documents of no other collection share."""
    active = documents.where("active").groupBy("hash").agg(F.countDistinct("collection").alias("n"), F.max(F.when(F.col("collection") == collection, 1).otherwise(0)).alias("own"))
    return active.where("n = 1 and own = 1").select("hash")


def incomplete(vectors: DataFrame) -> DataFrame:
    """(hash, model, chunks, expected) of embeddings whose chunks are not all there."""
    return vectors.groupBy("hash", "model").agg(F.countDistinct("seq").cast("int").alias("chunks"), F.max("total_chunks").alias("expected")).where("chunks <> expected")


def pending(documents: DataFrame, vectors: DataFrame, model: str, fingerprint: str) -> DataFrame:
    """(hash, path, bytes): active texts without all chunks under this model and fingerprint; one row a text, its least path."""
    done = vectors.where((F.col("model") == model) & (F.col("fingerprint") == fingerprint)).groupBy("hash").agg(F.countDistinct("seq").alias("chunks"), F.max("total_chunks").alias("expected"))
    texts = documents.where("active").groupBy("hash").agg(F.min("path").alias("path"), F.max(F.octet_length("body")).cast("long").alias("bytes"))
    return texts.join(done.where("chunks >= expected").select("hash"), "hash", "left_anti")


def fingerprint_groups(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("model", "fingerprint").agg(F.countDistinct("hash").alias("documents"), F.count("*").alias("chunks"))


def adopt_legacy(vectors: DataFrame, fingerprint: str) -> DataFrame:
    """Chunks without a fingerprint get this one."""
    return vectors.withColumn("fingerprint", F.when(F.coalesce("fingerprint", F.lit("")) == "", fingerprint).otherwise(F.col("fingerprint")))


def collection_listing(collections: DataFrame, documents: DataFrame) -> DataFrame:
    """(name, documents, active, last_modified) for every collection, also those without documents."""
    counts = documents.groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("documents"), F.count_if("active").alias("active"), F.max("modified_at").alias("last_modified"))
    return collections.select("name").join(counts, "name", "left").fillna(0, ["documents", "active"])


def status(documents: DataFrame, vectors: DataFrame, model: str, fingerprint: str) -> DataFrame:
    """(collection, active, last_modified, needs_embedding): a row a collection, and the total under null."""
    waits = pending(documents, vectors, model, fingerprint).select("hash", F.lit(1).alias("waits"))
    active = documents.where("active").join(waits, "hash", "left")
    parts = lambda d: (F.count("*").alias("active"), F.max("modified_at").alias("last_modified"), F.countDistinct(F.when(F.col("waits") == 1, F.col("hash"))).alias("needs_embedding"))
    return active.groupBy("collection").agg(*parts(active)).unionByName(active.agg(*parts(active)).withColumn("collection", F.lit(None).cast("string")))


def health(documents: DataFrame, vectors: DataFrame, model: str, fingerprint: str, today: Column) -> DataFrame:
    """One row: needs_embedding, total, days_stale."""
    total = documents.where("active").agg(F.count("*").alias("total"), F.datediff(today, F.to_date(F.left(F.max("modified_at"), F.lit(10)))).cast("int").alias("days_stale"))
    return total.crossJoin(pending(documents, vectors, model, fingerprint).agg(F.count("*").alias("needs_embedding")))  # one row each


def remove_collection(documents: DataFrame, name: str) -> DataFrame:
    return documents.where(F.col("collection") != name)


def rename_collection(documents: DataFrame, old: str, new: str) -> DataFrame:
    return documents.withColumn("collection", F.when(F.col("collection") == old, new).otherwise(F.col("collection")))


def deactivate(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows listed in ``gone`` (collection, path) become inactive."""
    marked = documents.join(gone.select("collection", "path", F.lit(True).alias("__gone")), ["collection", "path"], "left")
    return marked.withColumn("active", F.col("active") & F.col("__gone").isNull()).drop("__gone").select(*documents.columns)


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with ``new`` rows (hash, result, created_at) in place of those with their hash."""
    return cache.join(new.select("hash"), "hash", "left_anti").unionByName(new)


def batches_by_count(rows: DataFrame, partition: list[str], order: list, size: int = 64) -> DataFrame:
    from pyspark.sql.window import Window

    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1) / size).cast("int"))
