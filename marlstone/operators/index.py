"""Index tables and their maintenance: every change is a new DataFrame, written as a new version and swapped in by a manifest."""

from __future__ import annotations

import json
import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from marlstone.operators import retrieve

FORMAT = 1


def upsert(existing: DataFrame, new: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """existing with new's rows in place of those with the same key; of several new ones the last by order (or the greatest row)."""
    by = F.col(order) if order else F.struct(*[c for c in new.columns if c != key])
    new = new.groupBy(key).agg(F.max(F.struct(by.alias("_o"), F.struct(*new.columns).alias("_r"))).alias("_x")).select("_x._r.*")
    return existing.join(new, key, "left_anti").unionByName(new)


def delete(existing: DataFrame, keys: DataFrame, key: str = "chunk_id") -> DataFrame:
    return existing.join(keys, key, "left_anti")


def removed(existing: DataFrame, keys: DataFrame, key: str = "chunk_id") -> int:
    """How many rows delete() takes away; an unknown key counts none."""
    return existing.join(keys, key, "left_semi").count()


def delete_by_doc(existing: DataFrame, docs: DataFrame, keep: DataFrame | None = None, key: str = "chunk_id", doc: str = "doc_id") -> DataFrame:
    """existing without the rows of docs, but for those whose key is in keep."""
    gone = existing.join(docs, doc, "left_semi").select(key)
    return existing.join(gone.join(keep.select(key), key, "left_anti") if keep is not None else gone, key, "left_anti")


def orphans(existing: DataFrame, new: DataFrame, doc: str = "doc_id", key: str = "chunk_id") -> DataFrame:
    """Slots of documents in new that the new version no longer has."""
    return existing.join(new.select(doc).distinct(), doc, "left_semi").join(new.select(key), key, "left_anti").select(doc, key)


def latest_per_path(versions: DataFrame, path: str = "path", version: str = "version") -> DataFrame:
    """The newest version of each path."""
    newest = Window.partitionBy(path).orderBy(F.desc(version), "doc_id")
    return versions.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")


def superseded(versions: DataFrame, path: str = "path", version: str = "version", doc: str = "doc_id") -> DataFrame:
    """Documents that no path has as its newest version: those that may be forgotten. A document that two paths share stays while one of them has it."""
    return versions.select(doc).distinct().join(latest_per_path(versions, path, version), doc, "left_anti")


def forget(tables: dict[str, DataFrame], docs: DataFrame, doc: str = "doc_id") -> dict[str, DataFrame]:
    """Every table without the rows of docs."""
    return {name: t.join(docs, doc, "left_anti") if doc in t.columns else t for name, t in tables.items()}


def cache_misses(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return requests.join(cache.select(key), key, "left_anti")


def cache_hits(requests: DataFrame, cache: DataFrame, key: str = "key", max_age_s: float | None = None) -> DataFrame:
    live = cache if max_age_s is None else cache.filter(F.col("created_at") > F.current_timestamp() - F.make_dt_interval(secs=F.lit(max_age_s)))
    return requests.join(live.select(key, "value_json"), key)


def clear_namespace(cache: DataFrame, namespace: str) -> DataFrame:
    return cache.filter(F.col("namespace") != namespace)


def chunk_json(chunks: DataFrame) -> DataFrame:
    """(chunk_id, line): a chunk as one JSON line for interchange."""
    return chunks.select("chunk_id", F.to_json(F.struct(*chunks.columns), {"ignoreNullFields": "false"}).alias("line"))


def chunks_from_json(lines: DataFrame, schema: S.StructType) -> DataFrame:
    """Chunks of lines (line); a line that can't be parsed raises and names itself."""
    parsed = lines.select("line", F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("c"))
    checked = parsed.select(F.when(F.col("c.chunk_id").isNull(), F.raise_error(F.concat(F.lit("not a chunk: "), F.substring("line", 1, 80)))).otherwise(F.col("c")).alias("c"))
    return checked.select("c.*")


def check_dimension(existing: DataFrame, new: DataFrame, vector: str = "vector") -> None:
    """Raise if the vectors of both tables aren't of one size."""
    sizes = existing.select(F.size(vector).alias("d")).union(new.select(F.size(vector).alias("d"))).distinct().limit(2).collect()
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]['d']} and of {sizes[1]['d']} dimensions in one index")


def upsert_vectors(existing: DataFrame, new: DataFrame, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """upsert() of vectors, all of which must be of one size."""
    check_dimension(existing, new, vector)
    return upsert(existing, new, key)


def save(spark: SparkSession, folder: str, chunks: DataFrame, vectors: DataFrame, paths: DataFrame, chunk_max_tokens: int = 512) -> dict:
    """Write the tables under a new version, then the manifest that names it; readers see the old index until then."""
    versions = vectors.select("model_version", F.size("vector").alias("d")).distinct().limit(2).collect()
    if len(versions) > 1:
        raise ValueError("an index holds vectors of one model and size")
    version = uuid.uuid4().hex
    root = f"{folder.rstrip('/')}/{version}"
    # postings are sorted by term over all files, so that a question reads the row groups of its terms
    held = retrieve.with_frequency(retrieve.postings(chunks))
    lexical = held.repartitionByRange("term").sortWithinPartitions("term")
    for name, t in (("chunks", chunks), ("vectors", vectors), ("paths", paths), ("postings", lexical), ("stats", retrieve.corpus_stats(chunks))):
        t.write.parquet(f"{root}/{name}")
    read = lambda n: spark.read.parquet(f"{root}/{n}")
    manifest = {"format": FORMAT, "version": version, "chunks": read("chunks").count(), "documents": read("paths").select("doc_id").distinct().count(), "model_version": versions[0]["model_version"] if versions else None, "dimension": versions[0]["d"] if versions else 0, "chunk_max_tokens": chunk_max_tokens}
    _put(spark, posixpath.join(folder, "manifest.json"), json.dumps(manifest))
    return manifest


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file in one rename."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = jvm.org.apache.hadoop.fs.Path(path + "." + uuid.uuid4().hex)
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, target, options)


def load(spark: SparkSession, folder: str, model_version: str | None = None) -> tuple[dict, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(manifest, chunks, vectors, paths, chunks to embed again). Nothing is parsed again; vectors of another model are not used."""
    manifest = json.loads(spark.read.text(posixpath.join(folder, "manifest.json"), wholetext=True).first()[0])
    if manifest.get("format") != FORMAT:
        raise ValueError(f"format {manifest.get('format')} is not {FORMAT}")
    read = lambda n: spark.read.parquet(f"{folder.rstrip('/')}/{manifest['version']}/{n}")
    chunks, vectors = read("chunks"), read("vectors")
    if model_version is not None:
        vectors = vectors.filter(F.col("model_version") == model_version)
    return manifest, chunks, vectors, read("paths"), chunks.join(vectors, "chunk_id", "left_anti")


def load_lexical(spark: SparkSession, folder: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(postings with df, statistics) of a version: the stored inverted index."""
    root = f"{folder.rstrip('/')}/{version}"
    return spark.read.parquet(f"{root}/postings"), spark.read.parquet(f"{root}/stats")
