"""Where packages come from: folders, archives, pasted texts, repositories; and what is refused."""

from __future__ import annotations

import io
import subprocess
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.scratch import stash

# Text extensions, magic numbers, bounds, the name of a root document, cosmetic folders.
TEXT_EXTENSIONS = ("md", "markdown", "txt", "py", "sh", "bash", "zsh", "js", "ts", "json", "yaml", "yml", "toml", "cfg", "ini", "env", "rb", "ps1", "xml", "html", "htm", "cjs", "mjs")
MAGIC_HEX = ("89504E47", "FFD8FF", "47494638", "25504446", "504B0304", "7F454C46", "4D5A")
MAX_FILES, MAX_BYTES, MAX_UPLOAD = 5000, 200 * 1024 * 1024, 25 * 1024 * 1024
ROOT_DOCUMENT = "SKILL.md"
COSMETIC = "__MACOSX"
FILES = "pkg_id string, path string, content binary, size long, is_binary boolean"


def is_binary(path: Column, content: Column) -> Column:
    """A known text extension is text; else a magic number or an early NUL makes a file binary."""
    head = F.hex(F.substring(content, 1, 16))
    magic = F.lit(False)
    for m in MAGIC_HEX:
        magic = magic | head.startswith(m)
    pairs = F.regexp_like(head, F.lit("^(..)*00"))
    name = F.substring_index(path, "/", -1)
    known = name.contains(".") & F.lower(F.substring_index(name, ".", -1)).isin(*TEXT_EXTENSIONS) & ~name.rlike(r"^\.[^.]*$")
    return ~known & (magic | pairs)


def described(raw: DataFrame) -> DataFrame:
    """`raw` (pkg_id, path, content) as files, with size and is_binary."""
    return raw.select("pkg_id", "path", "content", F.octet_length("content").cast("long").alias("size"), is_binary(F.col("path"), F.col("content")).alias("is_binary"))


def from_folder(spark: SparkSession, root: str) -> DataFrame:
    """Each child of a folder is a package: a file, or a folder with all files below it but version control's."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    below = F.regexp_replace("path", "^.*?" + _quoted(base) + "/", "")
    rows = found.select(F.regexp_replace(below, "/.*$", "").alias("pkg_id"), F.when(below.contains("/"), F.regexp_replace(below, "^[^/]*/", "")).otherwise(below).alias("path"), "content")
    return described(rows.where(~F.concat(F.lit("/"), F.col("path")).contains("/.git/")))


def from_file(spark: SparkSession, path: str) -> DataFrame:
    """One file as a package of its own; its neighbours are not looked at."""
    name = F.substring_index("path", "/", -1)
    return described(spark.read.format("binaryFile").load(path).select(name.alias("pkg_id"), name.alias("path"), "content"))


def is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile()


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def from_texts(blobs: DataFrame) -> DataFrame:
    """Pasted texts (pkg_id, name, text), a package each; of a name only its last part counts."""
    last = F.substring_index(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("name", F.lit(""))), r"\\", "/"), "/+$", ""), "/", -1)
    name = F.when(last.isin("", ".", ".."), F.lit(ROOT_DOCUMENT)).otherwise(last)
    return described(blobs.select("pkg_id", name.alias("path"), F.encode("text", "UTF-8").alias("content")))


def unsafe_name(name: Column) -> Column:
    """Absolute, on a drive, or climbing out."""
    flat = F.regexp_replace(name, r"\\", "/")
    return flat.startswith("/") | flat.rlike("^[^/]:(/|$)") | flat.rlike(r"(^|/)\.\.(/|$)")


def members(data: bytes) -> Iterator[tuple[str, bytes | None, int]]:
    """(name, content, size) of the regular files of a zip or tar archive, declared sizes first checked against the bounds.

    A content of None tells why an archive is refused.
    """
    stream = io.BytesIO(data)
    if zipfile.is_zipfile(stream):
        with zipfile.ZipFile(stream) as archive:
            entries = [e for e in archive.infolist() if not e.is_dir()]
            if _beyond([e.file_size for e in entries]):
                yield "archive beyond its bounds", None, 0
                return
            for e in entries:
                yield e.filename, archive.read(e), e.file_size
        return
    stream.seek(0)
    with tarfile.open(fileobj=stream) as archive:
        entries = [e for e in archive.getmembers() if e.isfile()]
        if _beyond([e.size for e in entries]):
            yield "archive beyond its bounds", None, 0
            return
        for e in entries:
            yield e.name, archive.extractfile(e).read(), e.size


def _beyond(sizes: list[int]) -> bool:
    return len(sizes) > MAX_FILES or sum(sizes) > MAX_BYTES


def from_archives(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, refused) of `archives` (pkg_id, content); refused: pkg_id, reason.

    An archive is refused whole if it is no archive, is too large, or a member's name is unsafe. Wrapping folders go.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pkg_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = list(members(data or b""))
                except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError, NotImplementedError, RuntimeError) as error:
                    rows = [(f"not an archive: {type(error).__name__}", None, 0)]
                yield pa.RecordBatch.from_arrays([pa.array([pkg_id] * len(rows)), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["pkg_id", "path", "content"])

    bounded = archives.withColumn("_big", F.octet_length("content") > MAX_UPLOAD)
    unpacked = stash(bounded.where("not _big").select(F.col("pkg_id").cast("string"), "content").mapInArrow(per_batch, "pkg_id string, path string, content binary"), "members")
    broken = unpacked.where("content is null").select("pkg_id", F.col("path").alias("reason"))
    climbing = unpacked.where(F.col("content").isNotNull() & unsafe_name(F.col("path"))).select("pkg_id", F.concat(F.lit("unsafe member name: "), "path").alias("reason"))
    big = bounded.where("_big").select("pkg_id", F.lit("upload beyond its bound").alias("reason"))
    refused = broken.unionByName(climbing).unionByName(big).groupBy("pkg_id").agg(F.min("reason").alias("reason"))
    kept = unpacked.where("content is not null").join(refused, "pkg_id", "left_anti").where(~F.concat(F.lit("/"), F.col("path")).contains("/.git/"))
    return described(unwrapped(kept)), refused


def unwrapped(files: DataFrame) -> DataFrame:
    """Paths without the folders that wrap a whole package. Cosmetic folders don't count; a dot-named one is no wrapper.

    The common leading folders of a package are the prefix shared by its least and its greatest list of parts.
    """
    parts = F.split("path", "/")
    cosmetic = F.get(parts, 0) == COSMETIC
    seen = files.where(~cosmetic).groupBy("pkg_id").agg(F.min(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("_low"), F.max(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("_high"))
    same = F.zip_with("_low", "_high", lambda a, b: F.coalesce((a == b) & ~a.startswith("."), F.lit(False)))
    depth = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")
    joined = files.join(seen.select("pkg_id", depth.alias("_depth")), "pkg_id", "left")
    shorter = F.array_join(F.slice(parts, F.col("_depth") + 1, F.size(parts)), "/")
    return joined.select("pkg_id", F.when(cosmetic | F.col("_depth").isNull(), F.col("path")).otherwise(shorter).alias("path"), "content")


def repository_url(raw: Column) -> Column:
    """https://github.com/OWNER/NAME.git rebuilt from a url that means it, or null."""
    parts = r"^https://github\.com(?::443)?/+([A-Za-z0-9][A-Za-z0-9._-]{0,99})/+([^/?#]+?)(?:\.git)?(?:[/?#].*)?$"
    url = F.trim(raw)
    name = F.regexp_extract(url, parts, 2)
    return F.when(url.rlike(parts) & name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,99}$"), F.concat(F.lit("https://github.com/"), F.regexp_extract(url, parts, 1), F.lit("/"), name, F.lit(".git")))


def clone(url: str, into: str, seconds: int = 120) -> None:
    """A shallow clone on the driver, for from_folder; `url` must come from repository_url."""
    subprocess.run(["git", "clone", "--depth", "1", "--", url, into], check=True, timeout=seconds, capture_output=True)
