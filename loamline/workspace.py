"""Where indexes lie, which of several roots is meant, and repositories that are opened in the background."""

from __future__ import annotations

import hashlib
import os
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

OPENING, LOADING, SCANNING, EMBEDDING, STORING = "opening", "loading", "scanning", "embedding", "storing"
#: Called with a phase and how much of it is done.
Progress = Callable[[str, int, int], None]


def match_root(want: str, roots: list[str]) -> str | None:
    """The root that is meant: the path itself, its last part, or the first that holds the words, in any case."""
    if os.path.abspath(want) in roots:
        return os.path.abspath(want)
    low = want.lower()
    for test in (lambda r: os.path.basename(r.rstrip("/")).lower() == low, lambda r: low in r.lower()):
        for r in roots:
            if test(r):
                return r
    return None


def index_folder(root: str, base: str | None = None) -> str:
    """The folder of a root's index: inside it, or under ``base`` by name and a hash of the whole path."""
    if not base or not base.strip():
        return os.path.join(root, ".loamline")
    full = os.path.abspath(root)
    return os.path.join(base, f"{os.path.basename(full)}-{hashlib.sha256(full.encode()).hexdigest()[:8]}")


def phase_message(phase: str, done: int, total: int) -> str:
    percent = done * 100 // total if total > 0 else 0
    if phase == SCANNING:
        return f"scanned {total} files" if 0 < total <= done else f"scanning {done} files"
    if phase == EMBEDDING:
        return f"embedding {done}/{total} chunks ({percent:3d}%)" if total > 0 else "embedding chunks"
    if phase == STORING:
        return f"stored {total} chunks" if 0 < total <= done else f"writing {total} chunks"
    return phase


@dataclass
class _Entry:
    phase: str = OPENING
    done: int = 0
    total: int = 0
    value: object = None
    error: Exception | None = None
    ready: threading.Event = field(default_factory=threading.Event)


class Workspaces:
    """Repositories by root.  ``acquire`` never waits: it gives the repository, or a note on how far it is."""

    def __init__(self, open_root: Callable[[str, Progress], object]):
        self._open, self._known, self._lock = open_root, {}, threading.Lock()

    def acquire(self, root: str) -> tuple[object, str]:
        root = os.path.abspath(root)
        with self._lock:
            entry = self._known.get(root)
            if entry is None:
                entry = self._known[root] = _Entry()
                threading.Thread(target=self._run, args=(root, entry), daemon=True).start()
                return None, f"{root}: {phase_message(OPENING, 0, 0)}; try again in a moment"
            if entry.ready.is_set() and entry.error is not None:
                del self._known[root]  # the next call tries again
                raise entry.error
            if entry.ready.is_set():
                return entry.value, ""
            return None, f"{root}: {phase_message(entry.phase, entry.done, entry.total)}; try again in a moment"

    def wait(self, root: str, seconds: float) -> bool:
        entry = self._known.get(os.path.abspath(root))
        return entry is not None and entry.ready.wait(seconds)

    def _run(self, root: str, entry: _Entry) -> None:
        def progress(phase: str, done: int, total: int) -> None:
            entry.phase, entry.done, entry.total = phase, done, total

        try:
            entry.value = self._open(root, progress)
        except Exception as e:  # noqa: BLE001  (told to whoever asks next)
            entry.error = e
        entry.ready.set()
