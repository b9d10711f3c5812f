"""References of a local repository and of an advertisement: head, refs, peeled tags."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

from histlake.sources.packfmt import packets, whole_packets

_ID = re.compile(r"[0-9a-fA-F]{40}")


def git_dir(path: str) -> str:
    """The folder of the object database: <path>/.git, or path itself if it is bare."""
    inner = os.path.join(path, ".git")
    found = inner if os.path.isdir(inner) else path
    if not os.path.isdir(os.path.join(found, "objects")):
        raise FileNotFoundError(f"no repository at {path}")
    return found


def _packed(folder: str) -> list[tuple[str, str, str | None]]:
    """(name, id, peeled id) of packed-refs."""
    out: list[tuple[str, str, str | None]] = []
    path = os.path.join(folder, "packed-refs")
    if os.path.isfile(path):
        with open(path, encoding="utf-8", errors="replace") as lines:
            for line in lines:
                if line.startswith("^") and out:
                    name, sha, _ = out[-1]
                    out[-1] = (name, sha, line[1:].strip())
                elif not line.startswith(("#", "^")) and len(words := line.split()) >= 2 and _ID.fullmatch(words[0]):
                    out.append((words[1], words[0].lower(), None))
    return out


def list_refs(path: str) -> list[tuple[str, str, str | None]]:
    """(name, id, peeled id) of all references; a loose one goes before a packed one of its name."""
    folder = git_dir(path)
    found = {name: (sha, peeled) for name, sha, peeled in _packed(folder)}
    top = os.path.join(folder, "refs")
    for where, _, names in os.walk(top):
        for name in names:
            full = os.path.join(where, name)
            with open(full, encoding="utf-8", errors="replace") as f:
                said = f.read().strip()
            if _ID.fullmatch(said):
                name = os.path.relpath(full, folder).replace(os.sep, "/")
                was = found.get(name)
                found[name] = (said.lower(), was[1] if was and was[0] == said.lower() else None)
    return sorted((name, sha, peeled) for name, (sha, peeled) in found.items())


def head(path: str) -> str | None:
    """What HEAD points at: by name (loose or packed) or directly; None if that does not exist."""
    folder = git_dir(path)
    with open(os.path.join(folder, "HEAD"), encoding="utf-8") as f:
        said = f.read().strip()
    if _ID.fullmatch(said):
        return said.lower()
    name = said.removeprefix("ref:").strip()
    return next((sha for n, sha, _ in list_refs(path) if n == name), None)


class Advertisement:
    """What a server advertises, read in pieces: no more is held than a packet line that is still to be completed."""

    def __init__(self):
        self.head: str | None = None
        self.capabilities = ""
        self._first, self._rest = True, b""

    def feed(self, data: bytes) -> list[tuple[str, str]]:
        """(name, id)... of the packet lines that these bytes complete."""
        data = self._rest + data
        end = whole_packets(data)
        self._rest = data[end:]
        return self.take(packets(data[:end]))

    def take(self, payloads: Iterable[bytes]) -> list[tuple[str, str]]:
        found = []
        for payload in payloads:
            said, _, extra = payload.partition(b"\0")
            sha, _, name = said.decode("utf-8", "replace").rstrip("\n").partition(" ")
            if not _ID.fullmatch(sha) or not name:
                continue
            if self._first:
                self.capabilities, self._first = extra.decode("utf-8", "replace").strip(), False
            if name == "HEAD":
                self.head = sha.lower()
            else:
                found.append((name, sha.lower()))
        return found


def parse_advertisement(data: bytes) -> tuple[str | None, str, list[tuple[str, str]]]:
    """(head, capabilities, (name, id)...) of what a server advertises; peeled entries keep their ^{}."""
    read = Advertisement()
    found = read.take(packets(data))
    if read.head is None and not found:
        raise ValueError("no refs advertised")
    return read.head, read.capabilities, found
