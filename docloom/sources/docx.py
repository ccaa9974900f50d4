"""Word-processor files as a data source: ``spark.read.format("docx").load(folder)`` and the same as a stream.

A .docx file is a zip archive with XML inside. Files are listed on the driver and dealt to tasks by size; each task opens
its own files by the folder's file system. A file that can't be read is a row with status ``failed``. Only what the
requested columns need is done: without a text column no archive is opened.

    spark.dataSource.register(DocxSource)
    spark.read.format("docx").schema("path string, size long").load("s3://bucket/folder")
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, size long, modified long, status string, error string, text string, chars int, tables array<array<array<string>>>"
#: Bytes of files in one task.
PARTITION_BYTES = 16 << 20
#: Of one archive's main part, unpacked; beyond it the file counts as failed rather than filling the task's memory.
MOST_BYTES = 512 << 20

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_MARKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}


def _paragraph(p: ElementTree.Element) -> str:
    return "".join((x.text or "") if x.tag == f"{_W}t" else _MARKS.get(x.tag, "") for x in p.iter())


def parse(data: bytes) -> tuple[str, list[list[list[str]]]]:
    """(text, tables): the body's paragraphs joined by line breaks, and the tables' cells, row by row."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        if archive.getinfo("word/document.xml").file_size > MOST_BYTES:
            raise ValueError(f"the document part is over {MOST_BYTES} bytes")
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    if body is None:
        raise ValueError("no document body")
    text = "\n".join(_paragraph(p) for p in body.iterfind(f"{_W}p"))
    cell = lambda c: "\n".join(_paragraph(p) for p in c.iterfind(f"{_W}p"))
    return text, [[[cell(c) for c in row.iterfind(f"{_W}tc")] for row in table.iterfind(f"{_W}tr")] for table in body.iterfind(f"{_W}tbl")]


def _listed(path: str) -> list[tuple[int, str, int]]:
    """(modified, path, size) of the .docx files below a folder, or of the one file, oldest first."""
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)
    info = system.get_file_info(at)
    infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    found = [i for i in infos if i.type == fs.FileType.File and i.base_name.lower().endswith(".docx") and not i.base_name.startswith(("_", ".", "~"))]
    return sorted((int(i.mtime_ns or 0), i.path, i.size) for i in found)


class Files(InputPartition):
    """Files of one task."""

    def __init__(self, files: list[tuple[int, str, int]]):
        super().__init__(None)
        self.files = files


def _dealt(files: list[tuple[int, str, int]], most: int) -> list[Files]:
    out: list[list] = []
    held = most + 1
    for f in files:
        if held + f[2] > most:
            out.append([])
            held = 0
        out[-1].append(f)
        held += f[2]
    return [Files(x) for x in out]


class _Reads:
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns = [f.name for f in schema.fields]
        self.arrow = pa.schema([_ARROW.field(name) for name in self.columns])
        self.path = options["path"]
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        opened = {"status", "error", "text", "chars", "tables"} & set(self.columns)
        system = (fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith(("/", "file:")) else (fs.LocalFileSystem(), None))[0]
        for modified, path, size in partition.files:
            row = {"path": path, "size": size, "modified": modified // 1_000_000, "status": "ok", "error": None, "text": None, "chars": None, "tables": None}
            if opened:
                try:
                    with system.open_input_stream(path) as f:
                        row["text"], row["tables"] = parse(f.read())
                    row["chars"] = len(row["text"])
                except Exception as failed:
                    row |= {"status": "failed", "error": f"{type(failed).__name__}: {failed}"[:500], "text": None, "tables": None}
            yield pa.RecordBatch.from_pylist([{c: row[c] for c in self.columns}], schema=self.arrow)


_ARROW = pa.schema(
    [
        ("path", pa.string()), ("size", pa.int64()), ("modified", pa.int64()), ("status", pa.string()), ("error", pa.string()),
        ("text", pa.string()), ("chars", pa.int32()), ("tables", pa.list_(pa.list_(pa.list_(pa.string())))),
    ]
)


class DocxReader(_Reads, DataSourceReader):
    def partitions(self) -> list[Files]:
        return _dealt(_listed(self.path), self.bytes) or [Files([])]


class DocxStreamReader(_Reads, DataSourceStreamReader):
    """Files in order of their time and path; the offset is the last one's. A file changed later comes again."""

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = _listed(self.path)
        return {"modified": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        place = lambda o: (o["modified"], o["path"])
        return _dealt([f for f in _listed(self.path) if place(start) < f[:2] <= place(end)], self.bytes)

    def commit(self, end: dict) -> None:
        pass


class DocxSource(DataSource):
    """The format ``docx``; ``path`` is the folder, ``partitionBytes`` the bytes of files in a task."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return DocxReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return DocxStreamReader(schema, self.options)


def document(paragraphs: list[str], tables: list[list[list[str]]] = ()) -> bytes:
    """A small .docx file of paragraphs and tables."""
    from xml.sax.saxutils import escape

    run = lambda x: f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>'
    grid = lambda t: "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{run(c)}</w:tc>" for c in row) + "</w:tr>" for row in t) + "</w:tbl>"
    body = "".join(map(run, paragraphs)) + "".join(map(grid, tables))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        archive.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()
