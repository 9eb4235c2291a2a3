"""The external allocator's scripts and its console."""

from __future__ import annotations

import base64
import datetime
import os
import re
import shlex
import subprocess
from collections.abc import Mapping, Sequence
from urllib.parse import urlparse

#: A block of R or Python code in a script: what is between the quotes is the code, plain or in base 64.
_CODE = re.compile(r'(:= Calculate(?:Python|R)Expression ")(.*?)(" (?:\.no )?\{\{)', re.S)
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+=\n/]")


def recode_script(text: str, mode: str = "encode", check: bool = True) -> str:
    """A script with its code blocks in base 64, as its console reads them (encode), or plain (decode). With
    ``check`` ValueError where a block looks as if it already were."""
    if mode not in ("encode", "decode"):
        raise ValueError(f"unknown mode {mode}")

    def block(m: re.Match) -> str:
        plain = bool(_NOT_BASE64.search(m[2]))
        if check and plain != (mode == "encode"):
            raise ValueError(f"a code block seems to be {'plain' if plain else 'in base 64'} already; check=False overrides this")
        code = base64.b64encode(m[2].encode()).decode() if mode == "encode" else base64.b64decode(m[2]).decode()
        return m[1] + code + m[3]

    return _CODE.sub(block, text)


def fill_script(template: str, values: Mapping[str, object]) -> str:
    """A model script with its {placeholders} filled; KeyError on one without a value."""
    return re.sub(r"\{(\w+)\}", lambda m: str(values[m[1]]), template)


def local_folder(path: str) -> str:
    """The folder as this machine's programs name it; ValueError if it lies elsewhere."""
    found = urlparse(path)
    if found.scheme not in ("", "file"):
        raise ValueError(f"the external allocator runs on the driver and can't reach {path}")
    return found.path if found.scheme else path


def run_console(binary: str, script: str, folder: str, parallel: bool = False, log_level: int | None = None, extra: Sequence[str] = (), home: str | None = None, log: bool = True) -> str:
    """Runs the allocator's console on a script in ``folder`` and returns what it said, without colour codes,
    which also goes to a log file there. RuntimeError if it fails or says that it did."""
    args = [binary, *([] if parallel else ["-disable-parallel-steps"]), *([] if log_level is None else ["-log-level", str(log_level)]), *extra, script]
    env = os.environ | ({"LD_LIBRARY_PATH": os.path.join(home, "usr", "lib")} if home else {})
    done = subprocess.run(args, cwd=folder, env=env, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, check=False)
    said = re.sub(r"\x1b\[[0-9;]*m", "", done.stdout.decode("utf-8", "replace"))
    if log:
        stamp = datetime.datetime.now().strftime("%Y-%m-%d_%Hh%Mm%Ss")
        with open(os.path.join(folder, f"{stamp}_allocator.log"), "w") as f:
            f.write(said)
    if done.returncode or "exited with an error" in said:
        raise RuntimeError(f"{shlex.join(args)} failed: {said[-500:]}")
    return said
