"""Scans of files: discovery, screening, dispatch, and the text and JSON-lines sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import doc_id, normalise_text

TEXT, PDF, RICH = (".txt", ".md", ".markdown", ".rst"), (".pdf",), (".docx", ".pptx", ".html", ".png", ".jpg", ".jpeg", ".tiff")


@dataclass(frozen=True)
class Limits:
    max_bytes: int = 64 << 20
    min_bytes: int = 1
    max_pages: int = 2000
    seconds: float = 300.0

    def __post_init__(self) -> None:
        if self.max_bytes < self.min_bytes or self.max_pages < 1:
            raise ValueError("limits contradict each other")


def scan(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of a folder's files. content is read only where a plan uses it. Files of no bytes are not listed by the engine's scan."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"(\.[a-z0-9]+)$", 1)


def source_of(path: Column) -> Column:
    """The source that claims a path: the first by its extension; null if none does."""
    ext = extension(path)
    return F.when(ext.isin(*TEXT), "text").when(ext.isin(*PDF), "pdf").when(ext.isin(*RICH), "rich")


def screen(length: Column, limits: Limits = Limits(), pages: Column | None = None) -> Column:  # noqa: B008
    """Why a file is refused, or null. Only the length is looked at, so a refused file is never read."""
    out = F.when(length.isNull(), "unreadable").when(length < limits.min_bytes, "empty").when(length > limits.max_bytes, "too_large")
    return out.when(pages > limits.max_pages, "too_many_pages") if pages is not None else out


def encrypted(path: Column, content: Column) -> Column:
    """Whether a file is locked by a password: a PDF that names an encryption dictionary, or an office file in the container that locked ones have. Other files are not read."""
    ext = extension(path)
    pdf = F.contains(F.decode(content, "ISO-8859-1"), F.lit("/Encrypt"))
    office = F.hex(F.substring(content, 1, 8)) == "D0CF11E0A1B11AE1"
    return F.coalesce(F.when(ext.isin(*PDF), pdf).when(ext.isin(".docx", ".pptx"), office), F.lit(False))


def empty_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, length, reason) of files of no bytes, which the engine's scan leaves out. Names are listed by the file system; no file is opened."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    listed, found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, recursive), []
    while listed.hasNext():
        one = listed.next()
        if not one.getLen() and not one.getPath().getName().startswith(("_", ".")):
            found.append((one.getPath().toString(), 0, "empty"))
    return spark.createDataFrame(found, "path string, length long, reason string")


def screened(files: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(accepted, quarantine)."""
    marked = files.withColumn("reason", screen(F.col("length"), limits))
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL").select("path", "length", "reason")


def text_blocks(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block_index, type, level, text, page) of Markdown-like texts: headings, list items, and paragraphs of the lines between, joined by a space. Every block is on page 1."""
    lines = texts.select(key, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("n", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", r"(?U)\s+", " ")))
    heading, item = F.col("line").rlike(r"^#{1,6}\s+\S"), F.col("line").rlike(r"^[-*+]\s+\S")
    kind = F.when(F.col("line") == "", "blank").when(heading, "heading").when(item, "list_item").otherwise("paragraph")
    typed = lines.withColumn("type", kind)
    w = Window.partitionBy(key).orderBy("n")
    begins = (F.col("type") != "paragraph") | (F.lag("type").over(w).isNull()) | (F.lag("type").over(w) != "paragraph")
    grouped = typed.withColumn("b", F.sum(begins.cast("int")).over(w)).filter("type != 'blank'")
    body = F.when(F.col("type") == "heading", F.regexp_replace("line", r"^#{1,6}\s+", "")).when(F.col("type") == "list_item", F.regexp_replace("line", r"^[-*+]\s+", "")).otherwise(F.col("line"))
    level = F.when(F.col("type") == "heading", F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1)))
    joined = grouped.withColumn("t", body).withColumn("level", level).groupBy(key, "b", "type", "level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), " ").alias("text"))
    return joined.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("b")) - 1).alias("block_index"), "type", F.col("level").cast("int").alias("level"), "text", F.lit(1).alias("page"))


def heading_paths(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """blocks with heading_path: for each level the last heading that no shallower one has closed since."""
    w = Window.partitionBy(key).orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(F.col("type") == "heading", F.coalesce("level", F.lit(1)))
    out = blocks
    for k in range(1, 7):
        out = out.withColumn(f"_h{k}", F.last(F.when(level == k, F.struct("block_index", "text")), ignorenulls=True).over(w)).withColumn(f"_s{k}", F.max(F.when(level < k, F.col("block_index"))).over(w))
    parts = [F.when(F.col(f"_s{k}").isNull() | (F.col(f"_h{k}.block_index") > F.col(f"_s{k}")), F.col(f"_h{k}.text")) for k in range(1, 7)]
    return out.select(*blocks.columns, F.array_compact(F.array(*parts)).alias("heading_path"))


def documents(spark: SparkSession, folder: str, limits: Limits = Limits(), recursive: bool = True) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(documents of the text source with doc_id, path and text; quarantine: empty, too large and encrypted files)."""
    good, bad = screened(scan(spark, folder, recursive), limits)
    locked = encrypted(F.col("path"), F.col("content"))
    bad = bad.unionByName(good.filter(locked).select("path", "length", F.lit("encrypted").alias("reason"))).unionByName(empty_files(spark, folder, recursive))
    texts = good.filter(source_of(F.col("path")) == "text").select("path", doc_id(F.col("content")).alias("doc_id"), normalise_text(True)(F.decode("content", "UTF-8")).alias("text"))
    return texts, bad


def json_lines(spark: SparkSession, path: str, schema: str, id_col: str | None = None, prefix: str = "case") -> DataFrame:
    """Rows of a JSON-lines file; blank lines and those that begin with # are skipped, a bad line raises with its number, and a missing id is named after its line."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\n")).alias("n", "line")).filter((F.trim("line") != "") & ~F.trim("line").startswith("#"))
    parsed = lines.select((F.col("n") + 1).alias("n"), F.from_json("line", schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    good = parsed.select("n", F.when(F.col("r._corrupt_record").isNotNull() | F.col("r").isNull(), F.raise_error(F.concat(F.lit("bad JSON in line "), F.col("n").cast("string")))).otherwise(F.col("r")).alias("r"))
    out = good.select("n", "r.*").drop("_corrupt_record")
    if id_col:
        out = out.withColumn(id_col, F.coalesce(F.col(id_col), F.concat(F.lit(prefix + "-"), F.col("n").cast("string"))))
    return out.drop("n")


CASES = "case_id string, query string, expected_snippets array<string>, expected_doc_ids array<string>, expected_pages array<int>, expected_answer_contains array<string>, unanswerable boolean, tags array<string>"


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    out = json_lines(spark, path, CASES, "case_id").withColumn("unanswerable", F.coalesce("unanswerable", F.lit(False)))
    if not out.limit(1).count():
        raise ValueError(f"no cases in {path}")
    return out


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)
