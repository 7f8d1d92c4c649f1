"""Optional external programs."""

from __future__ import annotations

import shutil
import subprocess

from strandloom.config import StrandloomError, ToolMissing

#: Seconds that a program may run.
LIMIT_S = 3600


def run(command: list[str], limit: float = LIMIT_S, stdin: bytes | None = None) -> bytes:
    """The program's output; a missing one, one that fails and one that takes too long are errors of their own kind."""
    if shutil.which(command[0]) is None:
        raise ToolMissing(f"{command[0]} isn't installed")
    try:
        done = subprocess.run(command, input=stdin, capture_output=True, timeout=limit, check=False)
    except subprocess.TimeoutExpired as slow:
        raise StrandloomError(f"{command[0]} took longer than {limit} s and was ended") from slow
    if done.returncode:
        raise StrandloomError(f"{command[0]} failed with {done.returncode}: {done.stderr[-500:].decode(errors='replace')}")
    return done.stdout
