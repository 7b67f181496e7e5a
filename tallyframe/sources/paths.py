"""Paths as people paste them."""

from __future__ import annotations

import os
import re
import tempfile
from typing import IO

#: Marks of text direction, which copying from file managers leaves in paths.
_MARKS = re.compile("[‎‏‪-‮⁦-⁩]")


def clean_path(path: str) -> str:
    """A path without quotes, direction marks and redundant parts. URLs keep their form."""
    bare = _MARKS.sub("", str(path)).strip().strip("\"'").strip()
    return bare if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:/", bare) else os.path.normpath(bare)


def spooled(buffer: IO, name: str, folder: str | None = None) -> str:
    """The path of a file with a buffer's content, from its start; folder must be one that executors see.

    Without a folder the file is in this machine's own temporary one, which only a local session reads.
    """
    if hasattr(buffer, "seek"):
        buffer.seek(0)
    data = buffer.read()
    path = os.path.join(tempfile.mkdtemp(dir=folder), os.path.basename(name))
    with open(path, "wb") as f:
        f.write(data.encode() if isinstance(data, str) else data)
    return path
