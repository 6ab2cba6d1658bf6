"""A Spark data source for zip archives, whole or cut into volumes."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Volumes(io.RawIOBase):
    """Files one after another as one that can be sought in."""

    def __init__(self, paths: list[str]):
        self.files = [open(p, "rb") for p in paths]
        self.ends, total = [], 0
        for f in self.files:
            total += f.seek(0, io.SEEK_END)
            self.ends.append(total)
        self.at = 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + (0, self.at, self.ends[-1] if self.ends else 0)[whence]
        return self.at

    def readinto(self, buffer) -> int:
        begin = 0
        for f, end in zip(self.files, self.ends, strict=True):
            if self.at < end:
                f.seek(self.at - begin)
                got = f.read(min(len(buffer), end - self.at))
                buffer[: len(got)] = got
                self.at += len(got)
                return len(got)
            begin = end
        return 0

    def close(self) -> None:
        for f in self.files:
            f.close()
        super().close()


def ordered(paths: list[str]) -> list[str]:
    """The volumes of one archive in order of their numbers; a single path stands for itself."""
    number = lambda p: int(m[1]) if (m := re.search(r"\.(\d+)$", p)) else 0
    return sorted((p.removeprefix("file://") for p in paths), key=number)


class Entries(InputPartition):
    def __init__(self, places: list[int]):
        super().__init__(None)
        self.places = places


class ZipReader(DataSourceReader):
    def __init__(self, options):
        self.paths = ordered(options["paths"].split("\n"))
        self.unpack = re.compile(options.get("unpack", ".*"))
        self.task_bytes = int(options.get("taskBytes", 64 << 20))

    def _open(self) -> zipfile.ZipFile:
        return zipfile.ZipFile(io.BufferedReader(Volumes(self.paths), 1 << 20))

    def _opens(self, entry: zipfile.ZipInfo) -> bool:
        return self.unpack.search(entry.filename) is not None

    def partitions(self) -> list[Entries]:
        """Entries in the order of the directory, cut where what is unpacked of them comes to task_bytes, or they are 10,000."""
        out, size = [[]], 0
        with self._open() as z:
            for k, entry in enumerate(z.infolist()):
                if entry.is_dir():
                    continue
                if size >= self.task_bytes or len(out[-1]) >= 10_000:
                    out.append([])
                    size = 0
                out[-1].append(k)
                size += entry.compress_size if self._opens(entry) else 0
        return [Entries(places) for places in out]  # one at least

    def read(self, partition: Entries) -> Iterator[tuple]:
        with self._open() as z:
            entries = z.infolist()
            for k in partition.places:
                entry = entries[k]
                yield entry.filename, entry.file_size, z.read(entry) if self._opens(entry) else None


class ZipSource(DataSource):
    """Entries of a zip archive: path, size, and content where the name matches option `unpack`. Option `paths`: the file or its volumes, by lines."""

    @classmethod
    def name(cls) -> str:
        return "zip"

    def schema(self) -> str:
        return "path string, size long, content binary"

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)
