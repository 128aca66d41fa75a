"""Files in shared folders, opened through Arrow's filesystems on any worker."""

from __future__ import annotations

import re

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path of a URI; a bare path is local to the cluster's shared mount."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    if re.match(r"^\w[\w+.-]*://", uri):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri
