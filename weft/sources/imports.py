"""Files that programs and schemas import: read on the driver, from under one folder only."""

from __future__ import annotations

import os

#: How deep imports may nest, and how many one text may make.
DEEPEST, MOST = 32, 1000


class ImportRefused(ValueError):
    pass


def loader(root: str, suffixes: tuple = (".txt", ".weft")):
    """load(name) of a file under ``root``: no way leads out of the folder, by .., links or a scheme; a name without a suffix takes the
    first of ``suffixes``; other suffixes are refused."""
    root, made = os.path.realpath(root), [0]

    def load(name: str) -> str:
        made[0] += 1
        if made[0] > MOST:
            raise ImportRefused(f"over {MOST} imports")
        if "://" in name or os.path.isabs(name):
            raise ImportRefused(f"no relative path: {name!r}")
        name = name if os.path.splitext(name)[1] else name + suffixes[0]
        path = os.path.realpath(os.path.join(root, name))
        if os.path.splitext(path)[1] not in suffixes or os.path.commonpath((root, path)) != root:
            raise ImportRefused(f"not under the folder, or of another kind: {name!r}")
        with open(path, encoding="utf-8") as f:
            return f.read()

    return load
