"""Folders of Markdown notes, in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """path, frontmatter, body, content_hash of every note below folder, at any depth; not those in processed/ or hidden ones.

    Bytes that are no UTF-8 are read as Latin-1.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(folder)
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^.*" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    kept = ~rel.rlike(r"(^|/)(\.|processed/)")
    utf8 = F.is_valid_utf8(F.col("content"))
    whole = F.when(utf8, F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    head, body = text.frontmatter(F.col("text"))
    return files.withColumn("path", rel).filter(kept).select("path", whole.alias("text")).select("path", head.alias("frontmatter"), body.alias("body"), text.body_hash(F.col("text")).alias("content_hash"))


def field(name: str) -> Column:
    """A scalar of the frontmatter, without quotes; null where it is not there."""
    found = F.regexp_extract("frontmatter", rf"(?m)^{name}:[ \t]*(.+?)[ \t]*$", 1)
    return F.nullif(F.regexp_replace(found, "^[\"']|[\"']$", ""), F.lit(""))


def write_notes(notes: DataFrame, folder: str) -> None:
    """notes (path, fields: map, body) as one file each. Each task writes its own notes; a file is there whole or not at all."""

    def put(rows) -> None:
        from pyarrow import fs

        for r in rows:
            store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
            target = f"{root}/{r.path}"
            store.create_dir(target.rsplit("/", 1)[0], recursive=True)
            head = "".join(f"{k}: {v}\n" for k, v in sorted((r.fields or {}).items()))
            with store.open_output_stream(target + ".tmp") as out:
                out.write(f"---\n{head}---\n{r.body}".encode())
            store.move(target + ".tmp", target)

    notes.select("path", "fields", "body").foreachPartition(put)


def imported(raw: DataFrame, known: DataFrame) -> DataFrame:
    """raw (path, content) with id and kind: the id of a known document (hash, id) with the same bytes, else of its first path here."""
    hashed = raw.select("path", F.sha2("content", 256).alias("hash"), F.when(F.lower("path").endswith(".pdf"), "paper").otherwise("notes").alias("kind"))
    first = hashed.groupBy("hash").agg(F.min("path").alias("first"))
    old = known.select("hash", "id")
    return hashed.join(first, "hash").join(old, "hash", "left").select("path", "hash", "kind", F.coalesce("id", text.slug(F.regexp_replace("first", r"^.*/|\.[^.]*$", ""))).alias("id"), (F.col("id").isNull() & (F.col("path") == F.col("first"))).alias("new"))


def index_lines(pages: DataFrame, most: int = 25) -> DataFrame:
    """section, k, line of index.md: concepts by title, sources by title, the newest `most` syntheses."""
    from pyspark.sql import Window

    low = F.lower("title")
    by_title = F.row_number().over(Window.partitionBy("kind").orderBy(low, "title", "path"))
    newest = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("updated"), "path"))
    p = pages.withColumn("k", F.when(F.col("kind") == "synthesis", newest).otherwise(by_title))
    p = p.filter("kind in ('concept', 'source') or (kind = 'synthesis' and k <= %d)" % most)
    return p.select(F.col("kind").alias("section"), "k", F.concat(F.lit("- [["), "title", F.lit("]]")).alias("line"))


def write_index(pages: DataFrame, folder: str) -> None:
    """INDEX.json: a JSON object a line, in ordered files below folder."""
    pages.orderBy("path").write.mode("overwrite").json(folder)


def append_log(entries: DataFrame, folder: str) -> None:
    entries.write.mode("append").json(folder)
