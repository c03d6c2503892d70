"""Data versions on disk: which one is active, what is missing of it, what may go."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Sequence

ACTIVE = "active_version"


def set_active(root: str, version: str) -> None:
    os.makedirs(root, exist_ok=True)
    with open(os.path.join(root, ACTIVE), "w") as f:
        f.write(version)


def active(root: str, default: str, environment: str = "QUILLON_VERSION") -> str:
    """From the environment, else the pointer file, else the default."""
    if os.environ.get(environment):
        return os.environ[environment]
    try:
        with open(os.path.join(root, ACTIVE)) as f:
            return f.read().strip() or default
    except OSError:
        return default


def missing(path: str, required: Sequence[str]) -> list[str]:
    """Required parts that aren't there, in order."""
    return [r for r in required if not os.path.exists(os.path.join(path, r))]


def fetch(path: str, parts: Sequence[str], download: Callable[[str, str], None]) -> list[str]:
    """Download the parts that aren't there, each to a temporary name first; the first failure ends it. What was fetched."""
    done = []
    for part in missing(path, parts):
        to = os.path.join(path, part)
        os.makedirs(os.path.dirname(to), exist_ok=True)
        download(part, f"{to}.part")
        os.replace(f"{to}.part", to)
        done.append(part)
    return done


def clean(root: str, keep: str | None = None) -> list[str]:
    """Remove the versions but one."""
    gone = [n for n in sorted(os.listdir(root)) if os.path.isdir(os.path.join(root, n)) and n != keep] if os.path.isdir(root) else []
    for n in gone:
        shutil.rmtree(os.path.join(root, n), ignore_errors=True)
    return gone
