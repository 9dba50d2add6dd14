"""A tree of data files as datasets: what a checked-out repository holds. Fetching it is not Spark's business."""

from __future__ import annotations

import os
import re

from .readers import SUFFIXES

MAX_FILE_BYTES, MAX_FILES = 50 << 20, 20
#: fixed: folders that hold no data of the project
SKIPPED = {"node_modules", "vendor", "third_party", "dist", "build", "target", "site-packages", "__pycache__", "venv", "env"}


def discover(root: str, max_bytes: int = MAX_FILE_BYTES, max_files: int = MAX_FILES) -> tuple[list[str], dict[str, int]]:
    """(the smallest data files first, what was skipped and why)."""
    found, skipped = [], {"too_large": 0, "over_limit": 0}
    for folder, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in SKIPPED and not d.startswith("."))
        for f in files:
            if f.lower().endswith(SUFFIXES):
                path = os.path.join(folder, f)
                size = os.path.getsize(path)
                if size > max_bytes:
                    skipped["too_large"] += 1
                else:
                    found.append((size, path))
    found.sort()
    skipped["over_limit"] = max(0, len(found) - max_files)
    return [p for _, p in found[:max_files]], skipped


def dataset_id(owner: str, repo: str, path: str) -> str:
    stem = os.path.splitext(os.path.basename(path))[0]
    return re.sub(r"[^A-Za-z0-9_.-]", "-", f"{owner}--{repo}--{stem}").lower()
