"""Reading the tables, JSON-lines chunk files, subtitles and pages; writing packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds that a knowledge chunk may name as its source_type (fixed values).
SOURCE_TYPES = ("global_documentation", "global_video", "client_documentation")
#: Fields of a knowledge chunk that hold arrays of strings.
ARRAYS = ("keywords", "concepts", "plugin_names", "form_names", "business_objects", "datasets", "tables", "packages", "shortcuts", "frames")
STRINGS = ("id", "source", "text", "summary", "module", "topic", "teta_version", "training_date", "knowledge_version")
CHUNK_SCHEMA = ", ".join([*(f"{c} string" for c in STRINGS), "source_type string, start double, end double", *(f"{c} array<string>" for c in ARRAYS)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value of all lines of text files, numbered from 1. Lines are numbered within the splits of a file, and the
    lines of the splits before are added, so no task orders a whole file."""
    from pyspark.sql import Window

    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), "value")
    sizes = rows.groupBy("file", "_b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("file", "_b").orderBy("_i"))).join(sizes.select("file", "_b", before.alias("_before")), ["file", "_b"])
    return rows.select("file", (F.col("_before") + F.col("_n")).alias("line"), "value")


def chunk_issues(spark: SparkSession, path: str) -> DataFrame:
    """file, line, problem of every line of JSON-lines files that isn't a valid chunk."""
    return _chunks(numbered_lines(spark, path), ("file", "line")).where("problem is not null").select("file", "line", "problem")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON-lines files, each with its problem (null: valid). Blank lines and those that begin with # are left out.

    Strings and members of arrays are trimmed, and empty members left out; a field that should hold an array of strings
    and doesn't is a problem.
    """
    return _chunks(spark.read.text(path))


def _chunks(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    lines = lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    parsed = lines.select(*keep, "value", F.from_json("value", CHUNK_SCHEMA).alias("c"))
    parsed = parsed.withColumn("v", F.try_parse_json("value"))
    trimmed = lambda c: F.regexp_replace(c, r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$", "")
    missing = lambda c: F.coalesce(trimmed(c), F.lit("")) == ""

    def odd(field: str) -> Column:
        held = F.try_variant_get("v", f"$.{field}", "variant")
        strings = F.schema_of_variant(held).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(F.try_variant_get("v", f"$.{field}", "array<string>"), lambda x: x.isNull())
        return held.isNotNull() & ~F.coalesce(strings, F.lit(False))

    problem = (
        F.when(F.col("v").isNull(), "not JSON")
        .when(missing(F.col("c.source")), "no source")
        .when(missing(F.col("c.text")), "no text")
        .when(F.col("c.source_type").isNotNull() & ~F.col("c.source_type").isin(*SOURCE_TYPES), "unknown source_type")
    )
    for c in ARRAYS:
        problem = problem.when(odd(c), f"{c} isn't an array of strings")
    strings = {c: trimmed(F.col(f"c.{c}")) for c in STRINGS}
    arrays = {c: F.filter(F.transform(f"c.{c}", trimmed), lambda x: x != "") for c in ARRAYS}
    return parsed.select(*keep, "c.*", "v", "c", problem.alias("problem")).withColumns(strings | arrays).drop("v", "c")


def numbered(chunks: DataFrame) -> DataFrame:
    """chunk_index: the running number of each chunk in its source, by start, then text."""
    from pyspark.sql import Window

    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy("source").orderBy("start", "text")) - 1)


def write_pack(chunks: DataFrame, path: str) -> DataFrame:
    """Writes chunks as gzipped JSON lines; returns manifest(chunks)."""
    chunks.write.json(f"{path}/chunks", compression="gzip")
    return manifest(chunks)


def manifest(chunks: DataFrame) -> DataFrame:
    """source_type, chunks, and the distinct sorted sources, modules and topics of each source_type; a column that chunks
    lack counts as empty."""
    names = [(c, f"{c}s") for c in ("source", "module", "topic")]
    kept = chunks.select("source_type", *(F.col(c) if c in chunks.columns else F.lit(None).cast("string").alias(c) for c, _ in names))
    return kept.groupBy("source_type").agg(F.count("*").alias("chunks"), *(F.array_sort(F.collect_set(c)).alias(n) for c, n in names))


def merge_by(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys that new has, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without(rows: DataFrame, gone: Column) -> DataFrame:
    """rows but for those of which a condition holds; where it is null they stay."""
    return rows.where(~F.coalesce(gone, F.lit(False)))


def import_chunks(old: DataFrame, new: DataFrame, key: str = "source", mode: str = "merge") -> DataFrame:
    """What a collection holds after an import: new alone (replace), or new and what old has under other keys (merge)."""
    if mode not in ("replace", "merge"):
        raise ValueError(f"unknown mode {mode}")
    return new if mode == "replace" else merge_by(old, new, key)


def read_pack(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """The chunks of a pack that write_pack wrote; with sha256, checked against the digest that pack_digest gives."""
    chunks = spark.read.json(f"{path}/chunks")
    if sha256 is not None and pack_digest(chunks) != sha256:
        raise ValueError("the pack isn't what its digest says")
    return chunks


def pack_digest(chunks: DataFrame) -> str:
    """A digest of a pack's chunks that doesn't depend on their order: sums of 64-bit hashes and the number of rows."""
    row = F.to_json(F.struct(*sorted(chunks.columns)))
    parts = chunks.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(F.xxhash64(F.lit(k), row).cast("decimal(38,0)")), F.lit(0)).alias(f"h{k}") for k in range(4)))
    return parts.select(F.sha2(F.concat_ws(":", *parts.columns), 256)).first()[0]


def store_assets(files: DataFrame, content: str = "content") -> DataFrame:
    """asset, content, files: each distinct content once, named by its sha256."""
    return files.groupBy(F.sha2(F.col(content), 256).alias("asset")).agg(F.first(content).alias("content"), F.count("*").alias("files"))


def walk(spark: SparkSession, path: str, endings: tuple[str, ...]) -> DataFrame:
    """path, length, content of all files below a folder with one of the endings that aren't empty, whatever their case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.where((F.col("length") > 0) & kind.isin(*endings)).select("path", "length", "content")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, name) and edges (id, type, src, dst) of a graph's JSON lines, told apart by `kind`; lines without an
    id are left out."""
    rows = spark.read.schema("kind string, id string, type string, name string, `from` string, `to` string").json(path).where("id is not null")
    return rows.where("kind = 'node'").select("id", "type", "name"), rows.where("kind = 'edge'").select("id", "type", F.col("from").alias("src"), F.col("to").alias("dst"))


def _files(spark: SparkSession, path: str):
    """A path of Hadoop's file systems and the system that it is on."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def import_graph(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Replaces the graph in the folder target by that of JSON-lines files, as a whole or not at all; returns fault, count.

    Nodes and edges are first written to a version of their own below target. There they are checked: ids that come again,
    edges without an end or whose ends are no nodes. With a fault that version is deleted and ValueError is raised, and what
    was there before stays. Otherwise the file CURRENT is replaced by one rename, which readers see before or after, never in
    between; older versions stay until drop_graph_versions().
    """
    import uuid

    version = f"version-{uuid.uuid4().hex}"
    nodes, edges = read_graph(spark, path)
    nodes.write.parquet(f"{target}/{version}/nodes")
    edges.write.parquet(f"{target}/{version}/edges")
    nodes, edges = (spark.read.parquet(f"{target}/{version}/{t}") for t in ("nodes", "edges"))
    again = lambda rows, name: rows.groupBy("id").count().where("count > 1").select(F.lit(name).alias("fault"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    lost = ends.where("id is not null").join(nodes.select("id"), "id", "left_anti").distinct().select(F.lit("missing_node").alias("fault"))
    faults = again(nodes, "repeated_node").unionByName(again(edges, "repeated_edge")).unionByName(lost).unionByName(ends.where("id is null").select(F.lit("edge_without_end").alias("fault")))
    found = faults.groupBy("fault").agg(F.count("*").alias("count")).orderBy("fault")
    rows = found.collect()  # four kinds
    staged, system = _files(spark, f"{target}/{version}")
    if rows:
        system.delete(staged, True)
        raise ValueError("; ".join(f"{r['fault']}: {r['count']}" for r in rows))
    fresh, _ = _files(spark, f"{target}/{version}/CURRENT")
    out = system.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark._jvm
    renames = spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    renames[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    place = _files(spark, f"{target}/CURRENT")[0]
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration()).rename(fresh.makeQualified(system.getUri(), system.getWorkingDirectory()), place.makeQualified(system.getUri(), system.getWorkingDirectory()), renames)
    return found


def current_graph(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the version that CURRENT names."""
    version = spark.read.text(f"{target}/CURRENT").first()["value"]
    return spark.read.parquet(f"{target}/{version}/nodes"), spark.read.parquet(f"{target}/{version}/edges")


def drop_graph_versions(spark: SparkSession, target: str) -> int:
    """Deletes all versions but the current one; how many there were."""
    kept = spark.read.text(f"{target}/CURRENT").first()["value"]
    place, system = _files(spark, target)
    old = [f.getPath() for f in system.listStatus(place) if f.getPath().getName().startswith("version-") and f.getPath().getName() != kept]
    for p in old:
        system.delete(p, True)
    return len(old)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """source, position, start, end, text, problem of each segment of transcript files, one JSON object a file with an array
    segments. A segment without text, with an end before its start or a start before the one before it is a problem."""
    from pyspark.sql import Window

    raw = spark.read.schema("segments array<struct<start: double, end: double, text: string>>").option("multiLine", True).json(path)
    rows = raw.select(F.col("_metadata.file_name").alias("source"), F.posexplode("segments").alias("position", "s")).select("source", "position", "s.*")
    before = F.lag("start").over(Window.partitionBy("source").orderBy("position"))
    problem = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "no text").when(F.col("end") < F.col("start"), "ends before it starts").when(F.col("start") < before, "out of order")
    return rows.withColumn("problem", problem)


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags out, blocks on lines of their own, entities resolved (numbers below 65536
    too), white space collapsed within lines."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)</?(p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|blockquote|pre)\b[^>]*>", "\u2028")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    number = r"&#(x[0-9A-Fa-f]{1,4}|[0-9]{1,4});"
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(number), 1))

    def sign(c: Column) -> Column:
        value = F.conv(F.when(c.startswith("x"), F.substring(c, F.lit(2), F.length(c))).otherwise(F.conv(c, 10, 16)), 16, 10).cast("int")
        two = F.when(value < 2048, F.concat(F.hex(F.lit(192) + F.floor(value / 64)), F.hex(F.lit(128) + value % 64)))
        three = F.concat(F.hex(F.lit(224) + F.floor(value / 4096)), F.hex(F.lit(128) + F.floor(value / 64) % 64), F.hex(F.lit(128) + value % 64))
        return F.decode(F.unhex(F.when(value < 128, F.lpad(F.hex(value), 2, "0")).otherwise(F.coalesce(two, three))), "UTF-8")

    text = F.aggregate(F.coalesce(codes, F.array().cast("array<string>")), text, lambda t, c: F.replace(t, F.concat(F.lit("&#"), c, F.lit(";")), F.coalesce(sign(c), F.lit(""))))
    text = F.replace(text, F.lit("&amp;"), F.lit("&"))
    lines = F.filter(F.transform(F.split(F.regexp_replace(text, r"[ \t\r\n]+", " "), "\u2028"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(lines, "\n")


def subtitle_text(raw: Column) -> Column:
    """Spoken lines of WEBVTT and SRT files: headers, cue numbers, time lines and inline tags out."""
    lines = F.transform(F.split(raw, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"<[^>]*>", "")))
    spoken = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(WEBVTT|NOTE|STYLE|Kind:|Language:)|^\d+$|-->"))
    return F.array_join(spoken, "\n")
