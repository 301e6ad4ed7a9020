"""Archives as a sink: one ZIP a document in a folder of any store that Arrow writes, all of them or none.

    spark.dataSource.register(Archives)
    docs.write.format("archives").mode("append").save("hdfs://host/folder")      # doc_id, json, md, images

Each task writes its archives straight to files of a temporary folder beside the others, part by part, so an archive is never
held whole in a row, and tells the driver their names. When all tasks have succeeded the files move into place; when the write
fails they are removed. A task that is tried again writes files of its own, and those of the attempt before are removed.
"""

from __future__ import annotations

import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Names of the parts, and bytes that are written at a time.
JSON, MARKDOWN, IMAGES, CHUNK = "document.json", "markdown.md", "images", 1 << 20


def filesystem(path: str):
    """(Arrow file system, path within it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + posixpath.abspath(path))


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: a folder of its own, and names."""

    folder: str
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, markdown: bool):
        self.path, self.overwrite, self.markdown, self.temporary = path, overwrite, markdown, f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        files, root = filesystem(self.path)
        folder = f"{self.temporary}/{uuid.uuid4().hex}"
        files.create_dir(f"{root}/{folder}", recursive=True)
        names = []
        for r in rows:
            name = f"{r['doc_id']}.zip"
            if name in names:
                raise ValueError(f"two rows of document {r['doc_id']}")
            with files.open_output_stream(f"{root}/{folder}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                self._part(z, JSON, (r["json"] or "{}").encode())
                if self.markdown and r["md"] is not None:
                    self._part(z, MARKDOWN, r["md"].encode())
                for image in r["images"] or ():
                    self._part(z, f"{IMAGES}/{posixpath.basename(image['filename'])}", bytes(image["bytes"]))
            names.append(name)
        return Written(folder, names)

    @staticmethod
    def _part(z: zipfile.ZipFile, name: str, data: bytes) -> None:
        with z.open(name, "w") as f:
            for at in range(0, len(data), CHUNK):
                f.write(data[at : at + CHUNK])

    def commit(self, messages: list[Written | None]) -> None:
        files, root = filesystem(self.path)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("two rows of one document")
        if self.overwrite:
            from pyarrow import fs

            for old in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.type == fs.FileType.File and old.path.endswith(".zip"):
                    files.delete_file(old.path)
        for m in done:
            for name in m.names:
                files.move(f"{root}/{m.folder}/{name}", f"{root}/{name}")
        self._clean(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*filesystem(self.path))

    def _clean(self, files, root: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{root}/{self.temporary}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.temporary}")


class Archives(DataSource):
    """Sink `archives`: doc_id, json, md, images array<struct<filename, bytes>>. Option markdown=false leaves markdown.md out. A
    null json becomes {}, a null md or null images give no such part; two rows of one document are an error."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return "doc_id long, json string, md string, images array<struct<filename: string, bytes: binary>>"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if "path" not in self.options:
            raise ValueError("archives need a path")
        return _Writer(self.options["path"].rstrip("/"), overwrite, self.options.get("markdown", "true").lower() != "false")


def write_archives(docs, path: str, markdown: bool = True) -> None:
    """docs (doc_id, json, md, images) as one archive a document below path, in place of those that are there."""
    docs.sparkSession.dataSource.register(Archives)
    docs.select("doc_id", "json", "md", "images").write.format("archives").option("markdown", str(markdown).lower()).mode("overwrite").save(path)
