"""A sink for encoded images: ``df.write.format("images").mode("append").save(folder)`` with columns name and image.

Each row becomes a file. Tasks write a file under a name of their own and move it to its place when it is whole, so a
lost or repeated task leaves no half image; a row written twice replaces the same file. Any file system of pyarrow will do.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    n: int


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ImageWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows):
        system, base = file_system(self.folder)
        system.create_dir(base, recursive=True)
        n = 0
        for r in rows:
            if "/" in r.name:
                raise ValueError(f"an image's name holds no slash: {r.name}")
            own = f"{base}/.{uuid.uuid4().hex}.tmp"
            try:
                with system.open_output_stream(own) as f:
                    f.write(bytes(r.image))
                system.move(own, f"{base}/{r.name}")
            except BaseException:
                if system.get_file_info(own).type.name != "NotFound":
                    system.delete_file(own)
                raise
            n += 1
        return Written(n)

    def commit(self, messages):
        system, base = file_system(self.folder)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages):
        # Files that are in place are whole; without _SUCCESS the folder says that others are missing.
        system, base = file_system(self.folder)
        if system.get_file_info(f"{base}/_SUCCESS").type.name != "NotFound":
            system.delete_file(f"{base}/_SUCCESS")


class Images(DataSource):
    @classmethod
    def name(cls) -> str:
        return "images"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("images are added to a folder: write with mode append")
        if not {"name", "image"} <= set(schema.fieldNames()):
            raise ValueError("images need the columns name and image")
        return ImageWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Images)


def write_images(df: DataFrame, folder: str) -> None:
    register(df.sparkSession)
    df.select("name", "image").write.format("images").mode("append").save(folder)
