"""Page intake: folders, single images, archives and mixed listings."""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator, Sequence
from contextlib import ExitStack

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.names import ARCHIVE_EXTENSIONS, PAGE_EXTENSIONS, base_name, file_stem, source_kind
from foliospark.operators.order import unique_ids
from foliospark.session import cut_lineage
from foliospark.skew import number_rows
from foliospark.sources.storage import opened


def _folder(path: str):
    return F.regexp_replace(path, r"/[^/]*$", "")


def scan_page_folder(spark: SparkSession, path: str, *, unreadable: str = "skip") -> DataFrame:
    """Images of a folder (not below it): ``source_id, page_num, name, image`` in name order.

    Undecodable files are skipped, or kept with a null image (``unreadable="keep"``).
    """
    reader = spark.read.format("image").option("dropInvalid", unreadable == "skip")
    raw = reader.option("pathGlobFilter", _any_case(PAGE_EXTENSIONS)).load(path)
    pages = raw.select(F.col("image.origin").alias("_path"), "image")
    pages = pages.select(_folder("_path").alias("source_id"), base_name("_path").alias("name"),
                         F.when(F.col("image.height") > 0, F.col("image")).alias("image"))
    # Numbering needs names only; the image bytes stay out of its shuffle.
    return _numbered(pages)


def _numbered(pages: DataFrame) -> DataFrame:
    numbers = number_rows(pages.select("source_id", "name"), "source_id", ["name"], "page_num")
    return pages.join(numbers, ["source_id", "name"]).select("source_id", "page_num", "name", "image")


def scan_single_image(spark: SparkSession, path: str) -> DataFrame:
    """One image: ``name, image, error``; an undecodable file keeps its row and says so."""
    raw = spark.read.format("image").option("dropInvalid", False).load(path)
    bad = F.coalesce(F.col("image.height") < 1, F.lit(True))
    return raw.select(base_name("image.origin").alias("name"), F.when(~bad, F.col("image")).alias("image"),
                      F.when(bad, F.concat(F.lit("cannot decode image: "), base_name("image.origin"))).alias("error"))


ENTRIES = "path string, entry string, offset long, packed long, error string"
_PAGE = "path string, page_num long, entry string, name string, data binary, error string"
# Packed bytes of entries that one task reads, one entry after the other.
TASK_BYTES = 128 << 20
_UNREADABLE = (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, OSError, ValueError)


def _directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Central directories: the end of each archive is read, no entry."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            try:
                with opened(path or "") as file, zipfile.ZipFile(file) as archive:
                    rows = [(path, i.filename, i.header_offset, i.compress_size, None) for i in archive.infolist()]
            except _UNREADABLE as bad:
                rows = [(path, None, None, None, f"cannot read archive: {bad}")]
            types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["path", "entry", "offset", "packed", "error"])


def zip_entries(archives: DataFrame) -> DataFrame:
    """``path, entry, offset, packed, error``: the central directory of each archive (``path``), whose entries stay unread.

    An archive that cannot be read is one row with an error only.
    """
    return archives.select("path").mapInArrow(_directories, ENTRIES)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of entries, sorted by archive and place: a task seeks from entry to entry and holds one."""
    with ExitStack() as stack:
        current, archive, places = None, None, {}
        for batch in batches:
            for row in batch.to_pylist():
                data = None
                try:
                    if row["path"] != current:
                        stack.close()
                        current = row["path"]
                        archive = stack.enter_context(zipfile.ZipFile(stack.enter_context(opened(current))))
                        places = {(i.header_offset, i.filename): i for i in archive.infolist()}
                    data, error = archive.read(places[row["offset"], row["entry"]]), None
                except (KeyError, *_UNREADABLE) as bad:
                    error = f"cannot read entry: {bad}"
                values = (row["path"], row["page_num"], row["entry"], row["name"], data, error)
                types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["path", "page_num", "entry", "name", "data", "error"])


def _any_case(extensions: Sequence[str]) -> str:
    """File glob for the extensions in any case, so other files are never opened."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in extensions) + "}"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archive files below ``path`` as ``path, length``; their bytes are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return files.option("pathGlobFilter", _any_case(ARCHIVE_EXTENSIONS)).load(path).select("path", "length")


def expand_archives(archives: DataFrame, *, unique_names: bool = False, unreadable: str = "skip", task_bytes: int = TASK_BYTES) -> DataFrame:
    """Pages of archives (``path``): ``source_id, page_num, name, data``.

    Archives and entries that cannot be read are skipped, or kept without data and with a column ``error``
    (``unreadable="keep"``), so one bad file does not fail a folder.

    ``name`` is the full entry name, or with ``unique_names`` the base name made unique by ``_2``,
    ``_3``…; then ``cache_key`` (stem and twelve digits of the path hash) names the extraction.

    Directories are listed first, and names and numbers given to their entries.  The entries are then cut into ranges of
    about ``task_bytes``, wherever they lie: a large archive is read by many tasks, each seeking to its own range.
    """
    if unreadable not in ("skip", "keep"):
        raise ValueError("unreadable: skip | keep")
    entries = cut_lineage(zip_entries(archives))
    pages = entries.where("entry is not null").withColumn("_base", base_name("entry"))
    pages = pages.where(F.lower("_base").rlike(r"^.+\.(" + "|".join(PAGE_EXTENSIONS) + ")$")).drop("error")
    pages = number_rows(pages, "path", ["entry", "offset"], "page_num")
    if unique_names:
        ext = F.regexp_extract("_base", r"\.([^.]*)$", 1)
        split = pages.withColumns({"_ext": ext, "_name": F.expr("left(_base, length(_base) - length(regexp_extract(_base, '[.][^.]*$', 0)))")})
        pages = unique_ids(split, ["path", "_ext"], stem="_name", pos="page_num", name="_unique")
        pages = pages.withColumn("name", F.concat_ws(".", "_unique", "_ext"))
    else:
        pages = pages.withColumn("name", F.col("entry"))
    pages = cut_lineage(pages.select("path", "page_num", "entry", "name", "offset", "packed"))
    count, packed = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum("packed"), F.lit(0))).first()
    tasks = max(1, min(count, -(-packed // task_bytes)))
    placed = pages.repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset")
    found = placed.mapInArrow(_contents, _PAGE)
    if unreadable == "keep":
        bad = entries.where("error is not null").select("path", F.lit(None).cast("long").alias("page_num"), "entry", F.lit(None).cast("string").alias("name"),
                                                        F.lit(None).cast("binary").alias("data"), "error")
        found, more = found.unionByName(bad), ["error"]
    else:
        found, more = found.where("error is null"), []
    key = [cache_key("path").alias("cache_key")] if unique_names else []
    return found.select(F.col("path").alias("source_id"), F.col("page_num").cast("int").alias("page_num"), "name", "data", *key, *more)


def cache_key(path: str):
    return F.concat_ws("_", file_stem(path), F.substring(F.sha1(path), 1, 12))


def list_sources(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder (not below it), or one file: ``path, kind, length, modified``; their bytes are not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", source_kind("path").alias("kind"), "length", F.col("modificationTime").alias("modified"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    storage = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return storage.exists(place) and storage.getFileStatus(place).isDirectory()


def loose_pages(spark: SparkSession, path: str, *, one_source: bool) -> DataFrame:
    """Images of a folder, undecoded: one source with pages in name order, or each a source of its own."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", _any_case(PAGE_EXTENSIONS))
    loose = reader.load(path).where(source_kind("path") == "file").select("path", "content", base_name("path").alias("name"))
    if not one_source:
        return loose.select(F.col("path").alias("source_id"), F.lit(1).alias("page_num"), "name", F.col("content").alias("data"))
    pages = loose.select(_folder("path").alias("source_id"), "name", F.col("content").alias("image"))
    numbered = _numbered(pages)
    return numbered.select("source_id", F.col("page_num").cast("int").alias("page_num"), "name", F.col("image").alias("data"))


def read_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages, unsupported) of a folder or a file, told apart by extension.

    Pages are ``source_id, page_num, name, data`` with undecoded bytes.  The loose images of a folder are one source, numbered
    by name; each archive is one; an image given as a file is one page.  Other files are set aside.
    """
    listed = list_sources(spark, path)
    loose = loose_pages(spark, path, one_source=_is_folder(spark, path))
    packed = expand_archives(listed.where("kind = 'archive'").select("path"))
    return loose.unionByName(packed), listed.where("kind = 'unsupported'").select("path", "length")
