"""Workflow records: folders of result files with their digests (a driver-side helper)."""

from __future__ import annotations

import hashlib
import logging
import os
import re
import shutil
from pathlib import Path

RECORDS = "EMBERFRAME_RECORDS"
log = logging.getLogger("emberframe")


def record_folder(name: str, create: bool = False) -> Path:
    """Folder of a record below the one that EMBERFRAME_RECORDS names."""
    base = os.environ.get(RECORDS)
    if not base:
        raise OSError(f"{RECORDS} is not set")
    path = Path(base, name)
    if create:
        path.mkdir(parents=True, exist_ok=True)
    elif not path.is_dir():
        raise OSError(f"no record {name}")
    return path


def file_sha256(path: str | Path) -> str:
    """Digest of a file; empty if it cannot be read."""
    try:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()
    except OSError:
        log.exception("cannot read %s", path)
        return ""


def copy_to_record(source: str | Path, name: str, overwrite: bool = False) -> str:
    """Copies a file into a record and returns its digest."""
    target = record_folder(name) / Path(source).name
    if not Path(source).is_file():
        raise OSError(f"no file {source}")
    if target.exists() and not overwrite:
        raise OSError(f"{target} exists")
    shutil.copy2(source, target)
    return file_sha256(target)


def update_markdown(path: str | Path, digests: dict[str, str], date: str | None = None) -> None:
    """Rewrites '**name**: digest' lines and the 'Date:' line of a page."""
    text = Path(path).read_text(encoding="utf-8")
    for name, digest in digests.items():
        text = re.sub(rf"(\*\*{re.escape(name)}\*\*:\s*).*", lambda m, d=digest: m[1] + d, text)
    if date:
        text = re.sub(r"(?m)^(Date:\s*).*$", lambda m: m[1] + date, text)
    Path(path).write_text(text, encoding="utf-8")


def log_to_file(path: str | Path, level: int = logging.INFO) -> logging.Handler:
    handler = logging.FileHandler(path)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    log.addHandler(handler)
    set_level(level)
    return handler


def set_level(level: int) -> None:
    log.setLevel(level)
    for h in log.handlers:
        h.setLevel(level)
