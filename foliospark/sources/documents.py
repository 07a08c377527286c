"""Project documents from and to JSON: one file per project, or JSON lines."""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from foliospark.operators.documents import BUBBLE_TYPE, DOCUMENT_SCHEMA, PART_SIZE
from foliospark.sources.storage import storage_of

FORMAT = "project_documents"
_LINES = "project string, pos bigint, slice bigint, panel_id string, image_path string, bubbles string"
_HEAD = re.compile(r'^\{"project":(.*),"panels":\[$')
_OPEN, _END = ',"bubbles":[', "]}"


def file_name(project: str | None) -> str:
    """File of a project: percent signs stand only where the quoting puts them, so names never clash."""
    if project is None:
        return "project.json"
    quoted = quote(project, safe="")
    if len(quoted) > 200:
        quoted = f"{quoted[:100]}%~{hashlib.sha256(project.encode()).hexdigest()}"
    return f"project-{quoted}.json"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class DocumentWriter(DataSourceWriter):
    """Appends the rows of a task, sorted by project and place, to one file per project, and moves them into place at the end."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        storage, root = storage_of(self.path)
        folder = posixpath.join(root, self.pending, uuid.uuid4().hex)
        storage.create_dir(folder, recursive=True)
        files, out, project, place = [], None, None, None
        for row in iterator:
            if out is None or row.project != project:
                if out is not None:
                    out.write(f"\n{_END}\n{_END}\n".encode())
                    out.close()
                project, place = row.project, None
                name = file_name(project)
                files.append((posixpath.join(folder, name), posixpath.join(root, name)))
                out = storage.open_output_stream(files[-1][0])
                out.write(f'{{"project":{json.dumps(project, ensure_ascii=False)},"panels":[\n'.encode())
            if place is None or row.pos != place or row.slice == 0:
                out.write((("" if place is None else f"\n{_END},\n") + row.head[:-1] + _OPEN + "\n" + row.body).encode())
                place = row.pos
            elif row.body:
                out.write((",\n" + row.body).encode())
        if out is not None:
            out.write(f"\n{_END}\n{_END}\n".encode())
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        storage, root = storage_of(self.path)
        placed = {final: made for m in messages if m is not None for made, final in m.files}
        if self.overwrite:
            for name in _files(storage, root):
                if name not in placed:
                    storage.delete_file(name)
        for final, made in placed.items():
            storage.move(made, final)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        storage, root = storage_of(self.path)
        folder = posixpath.join(root, self.pending)
        if storage.get_file_info(folder).type.name != "NotFound":
            storage.delete_dir(folder)


def _files(storage, root: str) -> list[str]:
    from pyarrow import fs

    found = storage.get_file_info(root)
    if found.type == fs.FileType.File:
        return [root]
    listed = storage.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in listed if f.type == fs.FileType.File and f.path.endswith(".json"))


@dataclass
class ProjectFile(InputPartition):
    path: str


class DocumentReader(DataSourceReader):
    """One partition per file, read line by line: a task holds one slice at a time."""

    def __init__(self, path: str, slice_size: int):
        self.path, self.slice_size = path, slice_size

    def partitions(self) -> list[ProjectFile]:
        storage, root = storage_of(self.path)
        return [ProjectFile(p) for p in _files(storage, root)] or [ProjectFile("")]

    def read(self, partition: ProjectFile) -> Iterator[tuple]:
        if not partition.path:
            return
        storage, _ = storage_of(self.path)
        with storage.open_input_stream(partition.path) as stream:
            lines = _decoded(stream)
            head = next(lines, "")
            found = _HEAD.match(head)
            if found:
                yield from self.own(json.loads(found[1]), lines)
                return
            whole = json.loads("\n".join([head, *lines]))
        for pos, panel in enumerate(whole.get("panels") or []):
            bubbles = panel.get("bubbles") or []
            for k in range(0, max(len(bubbles), 1), self.slice_size):
                text = json.dumps(bubbles[k : k + self.slice_size], ensure_ascii=False)
                yield whole.get("project"), pos, k // self.slice_size, panel.get("panel_id"), panel.get("image_path"), text

    def own(self, project: str | None, lines: Iterator[str]) -> Iterator[tuple]:
        """Files of :class:`DocumentWriter`: a panel's head, each bubble and each end are lines."""
        pos, number, panel, bubbles = -1, 0, None, []
        for line in lines:
            if panel is None:
                if line.endswith(_OPEN):
                    panel, pos, number = json.loads(line[: -len(_OPEN)] + "}"), pos + 1, 0
            elif line.startswith(_END):
                if bubbles or number == 0:
                    yield project, pos, number, panel["panel_id"], panel["image_path"], "[" + ",".join(bubbles) + "]"
                panel, bubbles = None, []
            elif line:
                if len(bubbles) == self.slice_size:
                    yield project, pos, number, panel["panel_id"], panel["image_path"], "[" + ",".join(bubbles) + "]"
                    number, bubbles = number + 1, []
                bubbles.append(line[:-1] if line.endswith("},") else line)


def _decoded(stream) -> Iterator[str]:
    """Lines of a byte stream without their ends."""
    rest = b""
    while block := stream.read(1 << 20):
        *lines, rest = (rest + block).split(b"\n")
        yield from (line.decode() for line in lines)
    if rest:
        yield rest.decode()


class ProjectDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _LINES

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(self.options["path"], int(self.options.get("slice_size", PART_SIZE)))

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], overwrite)


def write_documents(rows: DataFrame, path: str, *, overwrite: bool = True) -> None:
    """One JSON document per project from document rows (``project, pos, slice, panel_id, image_path, bubbles``).

    Bubbles become text before the shuffle; rows then meet by project in order, and a task appends them to the project's file
    without holding more than one row.  Files appear when all tasks have ended: a lost or repeated task leaves none half written.
    ``overwrite`` removes documents of other projects, otherwise only those of the written projects are replaced.
    """
    rows.sparkSession.dataSource.register(ProjectDocuments)
    plain = {"ignoreNullFields": "false"}
    head = F.to_json(F.struct("panel_id", "image_path"), plain)
    body = F.array_join(F.transform("bubbles", lambda b: F.to_json(b, plain)), ",\n")
    lines = rows.select("project", "pos", "slice", head.alias("head"), body.alias("body"))
    placed = lines.repartition("project").sortWithinPartitions("project", "pos", "slice")
    placed.write.format(FORMAT).mode("overwrite" if overwrite else "append").save(path)


def read_documents(spark: SparkSession, path: str, *, slice_size: int = PART_SIZE) -> DataFrame:
    """Document rows of a folder of project files, or of one file: at most ``slice_size`` bubbles in a row, panels in file order.

    Files written by :func:`write_documents` are read line by line; other JSON documents of the same shape are read whole.
    Missing panels are none, missing bubbles an empty list.
    """
    spark.dataSource.register(ProjectDocuments)
    rows = spark.read.format(FORMAT).option("slice_size", slice_size).load(path)
    return rows.withColumn("bubbles", F.from_json("bubbles", f"array<{BUBBLE_TYPE}>"))


def read_document_lines(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Nested documents from JSON lines; missing panels or bubbles are empty lists, missing parts part 0."""
    docs = spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", multi_line).json(path)
    panels = F.transform(
        F.coalesce("panels", F.array().cast(docs.schema["panels"].dataType)),
        lambda p: p.withField("bubbles", F.coalesce(p.getField("bubbles"), F.array().cast(f"array<{BUBBLE_TYPE}>"))))
    return docs.select("project", F.coalesce("part_no", F.lit(0).cast("long")).alias("part_no"), panels.alias("panels"))


def write_document_lines(docs: DataFrame, path: str) -> None:
    """One nested document part per line, with its number, replacing what was there."""
    text = F.to_json(F.struct("project", "part_no", "panels"), {"ignoreNullFields": "false"})
    docs.select(text.alias("value")).write.mode("overwrite").text(path)
