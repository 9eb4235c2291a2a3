"""Fetching source files by their checksum."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import urllib.request
import uuid
import warnings
from urllib.parse import unquote, urlparse


def _file_name(url: str, disposition: str | None) -> str:
    found = re.search(r"filename\*?=(?:UTF-8'')?\"?([^\";]+)", disposition or "")
    name = unquote(found[1]) if found else os.path.basename(unquote(urlparse(url).path))
    return os.path.basename(name) or "download"


def download_and_verify(sources: list[dict], directory: str, overwrite: bool = False) -> list[str]:
    """Each source ({url, md5sum}) into a folder named by its sum; the files' paths. A folder that has its
    file is used again, a wrong sum warns, more than one file in a folder is an error."""
    out = []
    for s in sources:
        folder = os.path.join(directory, s.get("md5sum") or hashlib.md5(s["url"].encode()).hexdigest())
        os.makedirs(folder, exist_ok=True)
        held = sorted(f for f in os.listdir(folder) if not f.startswith("."))
        if len(held) > 1:
            raise ValueError(f"{folder} has more than one file")
        if held and not overwrite:
            path = os.path.join(folder, held[0])
        else:
            part = os.path.join(folder, f".{uuid.uuid4().hex}")
            with urllib.request.urlopen(s["url"]) as r, open(part, "wb") as f:  # noqa: S310 - the caller's URL
                shutil.copyfileobj(r, f)
                name = _file_name(s["url"], r.headers.get("Content-Disposition"))
            for old in held:
                os.remove(os.path.join(folder, old))
            path = os.path.join(folder, name)
            os.replace(part, path)
        if s.get("md5sum"):
            with open(path, "rb") as f:
                found = hashlib.file_digest(f, "md5").hexdigest()
            if found != s["md5sum"]:
                warnings.warn(f"{path} has the checksum {found}, not {s['md5sum']}", stacklevel=2)
        out.append(path)
    return out
