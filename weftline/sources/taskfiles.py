"""Files that tasks write whole, with a commit: what a lost or repeated task has written never counts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def filesystem(uri: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri)


def files(uri: str, *suffixes: str) -> list[tuple[str, int]]:
    """Paths and sizes of the file at uri, or of a folder's files of these suffixes (all, if none is named), in order of path."""
    import pyarrow.fs as pafs

    fs, path = filesystem(uri)
    info = fs.get_file_info(path)
    found = [info] if info.is_file else [x for x in fs.get_file_info(pafs.FileSelector(path)) if x.is_file and not x.base_name.startswith(("_", ".")) and (not suffixes or x.path.endswith(suffixes))]
    return sorted((x.path, x.size) for x in found)


class Written(WriterCommitMessage):
    """[name in _temporary, key of the file or null] of each file of a task, as JSON."""

    def __init__(self, files: list) -> None:
        self.files = json.dumps(files)


class TaskFilesWriter(DataSourceWriter):
    """Each task writes into path/_temporary, under names of its own; a commit moves the files of the tasks that count to path."""

    def __init__(self, uri: str, suffix: str) -> None:
        self.uri, self.suffix = uri, suffix

    def new_file(self) -> tuple[str, object]:
        """A name and an open stream."""
        fs, path = filesystem(self.uri)
        fs.create_dir(f"{path}/_temporary", recursive=True)
        name = uuid.uuid4().hex
        return name, fs.open_output_stream(f"{path}/_temporary/{name}", compression=None)

    def commit(self, messages) -> None:
        fs, path = filesystem(self.uri)
        fs.create_dir(path, recursive=True)
        for k, m in enumerate(messages):
            for j, (name, key) in enumerate(json.loads(m.files) if m is not None else []):
                fs.move(f"{path}/_temporary/{name}", f"{path}/{f'part-{k:05d}-{j:03d}' if key is None else f'split_{key}'}{self.suffix}")
        self._clear(fs, path)
        with fs.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        self._clear(*filesystem(self.uri))

    def _clear(self, fs, path: str) -> None:
        import pyarrow.fs as pafs

        if fs.get_file_info(f"{path}/_temporary").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{path}/_temporary")


class _PiecesWriter(TaskFilesWriter):
    def write(self, iterator) -> Written:
        name, stream = self.new_file()
        for (value,) in iterator:
            stream.write((value or "").encode())
        stream.close()
        return Written([(name, None)])


class PiecesSource(DataSource):
    """text_pieces: writes the column value as it is, without anything between rows."""

    @classmethod
    def name(cls) -> str:
        return "text_pieces"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _PiecesWriter(self.options["path"], ".txt")


def write_pieces(rows: DataFrame, path: str) -> None:
    """Files of the pieces of text in value, in the order of the rows of each partition: a line can be put together from any number of rows."""
    rows.sparkSession.dataSource.register(PiecesSource)
    rows.select("value").write.format("text_pieces").option("path", path).mode("append").save()
