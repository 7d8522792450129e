"""Files as rows: inventory, text, artifacts and content routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File types by extension.
PROCESSABLE = ".pdf .docx .txt .md .rst .csv .tsv .json .yaml .yml .xml .html .htm .xlsx .xls .xlsm".split()
BINARY = (
    ".jpg .jpeg .png .gif .bmp .webp .svg .ico .tiff .tif .heic .raw .mp4 .avi .mkv .mov .wmv .flv .webm .m4v .mp3 .wav .aac .flac .ogg .m4a .wma .opus "
    ".zip .tar .gz .bz2 .rar .7z .xz .zst .exe .dll .so .dylib .bin .apk .ipa .iso .dmg .img .ttf .otf .woff .woff2 .psd .ai .sketch .fig .db .sqlite .mdb"
).split()
UNSUPPORTED = ".pptx .ppt .odt .ods .odp .eml .msg .log".split()
MIME = {".txt": "text/plain", ".md": "text/markdown", ".csv": "text/csv", ".json": "application/json", ".pdf": "application/pdf", ".html": "text/html", ".png": "image/png"}


def extension(name: Column) -> Column:
    """Last suffix of the last path component, lower-cased; dotfiles and trailing dots have none."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))


def file_gate(files: DataFrame, name: str = "filename") -> DataFrame:
    """Adds extension, verdict (processable, skipped, unsupported), reason, should_process, permanent_skip; no file is opened."""
    ext = F.col("extension")
    verdict = F.when(ext.isin(PROCESSABLE), "processable").when(ext.isin(BINARY), "skipped").otherwise("unsupported")
    reason = (
        F.when(ext.isin(PROCESSABLE), "supported file type")
        .when(ext.isin(BINARY), "binary or media file")
        .when(ext.isin(UNSUPPORTED), "no parser for this format")
        .when(ext == "", "no extension")
        .otherwise("unknown extension")
    )
    out = files.withColumn("extension", extension(F.col(name)))
    return out.withColumns({"verdict": verdict, "reason": reason, "should_process": ext.isin(PROCESSABLE), "permanent_skip": ext.isin(BINARY)})


def scan_inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """uri, size_bytes, modified of all files below root. The content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select(F.col("path").alias("uri"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def read_text_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """uri, filename, text of all files below root whose type may hold text; bad UTF-8 is replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    some = files.filter(~extension(F.col("path")).isin(BINARY))
    return some.select(F.col("path").alias("uri"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.expr("make_valid_utf8(cast(content as string))").alias("text"))


def derive_file_meta(files: DataFrame) -> DataFrame:
    """files (uri, text): filename, source_type, mime_type, size_bytes, content_hash."""
    name = F.element_at(F.split("uri", "/"), -1)
    types = F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))
    return files.withColumns({
        "filename": F.when(F.length(name) > 0, name).otherwise("unknown"),
        "source_type": F.when(F.startswith("uri", F.lit("cloudreve://")), "cloudreve").otherwise("local"),
        "mime_type": F.coalesce(F.try_element_at(types, extension(F.col("uri"))), F.lit("application/octet-stream")),
        "size_bytes": F.octet_length("text").cast("long"),
        "content_hash": F.sha2("text", 256),
    })


def parse_uri(rows: DataFrame, uri: str = "uri", scheme: str = "cloudreve") -> DataFrame:
    """Adds scheme, host, user, path (default /), query and valid (the wanted scheme, with a host)."""
    rest = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    out = rows.withColumns({
        "scheme": F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)),
        "host": F.lower(F.regexp_extract(rest, r"([^@:]*)(:[0-9]*)?$", 1)),
        "user": F.regexp_extract(rest, r"^([^@]*)@", 1),
        "path": F.regexp_extract(uri, r"^[^:]*://[^/?#]*(/[^?#]*)", 1),
        "query": F.regexp_extract(uri, r"\?([^#]*)", 1),
    })
    return out.withColumns({"path": F.when(F.col("path") == "", "/").otherwise(F.col("path")), "valid": (F.col("scheme") == scheme) & (F.col("host") != "")})


def artifact_key(content_hash: Column, filename: Column) -> Column:
    """parsed-text/<16 digits of the hash>/<base name>.txt; folders in the name are dropped."""
    return F.concat(F.lit("parsed-text/"), F.substring(content_hash, 1, 16), F.lit("/"), F.regexp_extract(filename, "[^/]*$", 0), F.lit(".txt"))


def write_artifacts(files: DataFrame, path: str | None = None) -> DataFrame:
    """files (uri, content_hash, filename, text): key, content_hash, uri, text; written as Parquet, by the hash's first two digits, where a path is given."""
    out = files.select(artifact_key(F.col("content_hash"), F.col("filename")).alias("key"), "content_hash", "uri", "text")
    if path:
        out.withColumn("part", F.substring("content_hash", 1, 2)).write.mode("overwrite").partitionBy("part").parquet(path)
    return out


def document_content(documents: DataFrame, artifacts: DataFrame, uris: DataFrame) -> DataFrame:
    """uris (uri): status, source and text by the scheme of the document's parsed_text_key; errors are rows with a status."""
    d = uris.join(documents.select("uri", "parsed_text_key", F.lit(True).alias("known")), "uri", "left").join(artifacts.select(F.col("key").alias("parsed_text_key"), "text"), "parsed_text_key", "left")
    key = F.col("parsed_text_key")
    scheme = F.regexp_extract(key, "^([a-z0-9]+)://", 1)
    stored = scheme.isin("s3", "local")
    status = F.when(F.col("known").isNull(), 404).when(key.isNull() | (key == ""), 404).when(scheme == "cloudreve", 410).when(~stored, 422).when(F.col("text").isNull(), 502).otherwise(200)
    return d.select("uri", status.alias("status"), F.when(status == 200, scheme).alias("source"), F.when(status == 200, F.col("text")).alias("text"))
