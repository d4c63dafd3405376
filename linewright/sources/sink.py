"""A data source that writes rows (file_name, value) as files of a folder, all of them or none.

A task writes into a staging folder of its own below the target; the commit moves what whole
tasks have written to its final names, and an abort removes the staging folder. So a task that
fails or runs twice leaves no file, and readers never see half a file.

Options: ``path``, a whole uri as ``html.write_folder`` makes it; ``existing``, what becomes of
a file that the folder has already: ``replace`` (default), ``keep`` it, or ``error``, which
moves nothing at all; ``font`` and ``family``, a font file that goes into pages made for it.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from linewright.sources import shared

EXISTING = ("replace", "keep", "error")
#: Stands in a page's style where the font goes; the quotes keep it out of any escaped text.
FONT_MARK = '/*"font"*/'


@dataclass
class Staged(WriterCommitMessage):
    folder: str


def font_rule(name: str, raw: bytes, family: str) -> str:
    """A font file's bytes as an embedded @font-face rule."""
    ending = name.lower().rsplit(".", 1)[-1]
    kind = {"otf": "font/otf", "woff2": "font/woff2"}.get(ending, "font/ttf")
    return f"@font-face {{ font-family: '{family}'; src: url(data:{kind};base64,{base64.b64encode(raw).decode()}); }}"


class FolderWriter(DataSourceWriter):
    def __init__(self, options):
        self.uri, self.existing = options["path"], options.get("existing", "replace")
        self.font, self.family = options.get("font"), options.get("family", "")
        if self.existing not in EXISTING:
            raise ValueError(f"existing must be one of {', '.join(EXISTING)}")
        self.stage = f".staging-{uuid.uuid4().hex}"

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def _rule(self) -> str:
        from pyarrow import fs

        if not self.font:
            return ""
        store, place = fs.FileSystem.from_uri(self.font)
        with store.open_input_stream(place) as file:
            return font_rule(place, file.read(), self.family)

    def write(self, iterator: Iterator) -> Staged:
        store, root = self._store()
        folder = f"{root}/{self.stage}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        rule = self._rule()
        for row in iterator:
            name, value = row["file_name"], row["value"]
            if not name or "/" in name or "\\" in name:
                raise ValueError(f"not the name of a file: {name!r}")
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(value.replace(FONT_MARK, rule, 1).encode())
        return Staged(folder)

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        store, root = self._store()
        folders = [m.folder for m in messages if m is not None]

        def there(name: str) -> bool:
            return store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound

        def names(folder: str) -> list[str]:
            return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(folder)))

        try:
            if self.existing == "error":
                for folder in folders:
                    for name in filter(there, names(folder)):
                        raise FileExistsError(name)
            for folder in folders:
                for name in names(folder):
                    if there(name):
                        if self.existing == "keep":
                            continue
                        store.delete_file(f"{root}/{name}")
                    store.move(f"{folder}/{name}", f"{root}/{name}")
        finally:
            self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        """Remove what is staged."""
        from pyarrow import fs

        store, root = self._store()
        if store.get_file_info(f"{root}/{self.stage}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.stage}")


class FolderSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "linewright_folder"

    def schema(self) -> str:
        return "file_name string, value string"

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options)


def uri(spark: SparkSession, path: str) -> str:
    """A path as a whole uri on Spark's default file system; local ones are refused on a cluster."""
    store, place = shared.store(spark, path)
    whole = store.makeQualified(place).toString()
    if whole.startswith("file:"):
        if not spark.sparkContext.getConf().get("spark.master", "").startswith("local"):
            raise ValueError(f"executors do not share {whole}")
        whole = "file://" + whole.removeprefix("file:").removeprefix("//")
    return whole


def write(rows: DataFrame, path: str, **options: str) -> None:
    """Write (file_name, value); of rows that share a name the greatest value stays."""
    rows.sparkSession.dataSource.register(FolderSink)
    ordered = rows.repartition("file_name").sortWithinPartitions("file_name", "value")
    ordered.write.format(FolderSink.name()).mode("append").options(**options).save(uri(rows.sparkSession, path))
