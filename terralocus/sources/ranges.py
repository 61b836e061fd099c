"""Byte ranges of files and of ZIP members, on mounted paths and in object stores.

A path without scheme, or `file:`, is opened as a mounted file; any other one
through the store clients that Arrow brings (s3, gs, abfs, hdfs). Only the ranges
asked for are fetched.
"""

from __future__ import annotations

import os
import struct
import zipfile
from typing import BinaryIO
from urllib.parse import urlparse


def open_file(path: str) -> BinaryIO:
    """A seekable file; OSError or ValueError where it cannot be opened."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return open(parts.path if parts.scheme else path, "rb")
    from pyarrow import fs

    store, key = fs.FileSystem.from_uri(path)
    return store.open_input_file(key)


class Member:
    """One member of a ZIP: ranges straight from the archive where it is stored as it is, else by unpacking up to them.

    Packed members are cheap only while offsets rise, so their ranges belong in
    one task in order.
    """

    def __init__(self, path: str, name: str, file: BinaryIO | None = None):
        self.file = file or open_file(path)
        self.zip = zipfile.ZipFile(self.file)
        info = self.zip.getinfo(name)
        self.size, self.stored = info.file_size, info.compress_type == zipfile.ZIP_STORED
        self.packed = None
        if self.stored:
            self.file.seek(info.header_offset)
            names = struct.unpack_from("<HH", self.file.read(30), 26)
            self.start = info.header_offset + 30 + sum(names)
        else:
            self.packed = self.zip.open(info)

    def read_at(self, offset: int, n: int) -> bytes:
        if offset < 0 or n < 0 or offset + n > self.size:
            raise ValueError(f"bytes {offset} to {offset + n} lie outside the {self.size} of the member")
        if self.stored:
            self.file.seek(self.start + offset)
            return self.file.read(n)
        self.packed.seek(offset, os.SEEK_SET)
        return self.packed.read(n)

    def close(self) -> None:
        if self.packed is not None:
            self.packed.close()
        self.zip.close()
        self.file.close()
