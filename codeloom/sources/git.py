"""Version of a working tree."""

from __future__ import annotations

import os
import subprocess


def version(root: str) -> tuple[str | None, bool]:
    """(commit, whether the tree has changes or untracked files); (None, False) outside git."""
    if not os.path.exists(os.path.join(root, ".git")):
        return None, False
    try:
        run = lambda *args: subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True, timeout=60).stdout.strip()
        return run("rev-parse", "HEAD"), bool(run("status", "--porcelain"))
    except (OSError, subprocess.SubprocessError):
        return None, False


def behind(root: str, commit: str) -> int | None:
    """How many commits the checked-out one has beyond this ancestor; None if it isn't one."""
    run = lambda *args: subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
    if run("merge-base", "--is-ancestor", commit, "HEAD").returncode:
        return None
    found = run("rev-list", "--count", f"{commit}..HEAD")
    return int(found.stdout) if found.returncode == 0 else None
