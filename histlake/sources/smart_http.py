"""The smart HTTP protocol: advertised refs, and a pack staged as a local file."""

from __future__ import annotations

import os
import urllib.request

from histlake.sources.packfmt import FLUSH, demultiplex, pack_id, packet
from histlake.sources.refs import parse_advertisement

#: Seconds that one socket operation may take.
TIMEOUT = 60


def is_url(location: str) -> bool:
    return location.startswith(("http://", "https://"))


def partial_filter(kinds: set[str] | None) -> str | None:
    """The leanest filter for the wanted kinds: no trees, no blobs, or none (kinds None: everything)."""
    if kinds is None or "blob" in kinds:
        return None
    return "blob:none" if "tree" in kinds else "tree:0"


def discover(url: str) -> tuple[str | None, str, list[tuple[str, str]]]:
    with urllib.request.urlopen(f"{url.rstrip('/')}/info/refs?service=git-upload-pack", timeout=TIMEOUT) as answer:
        return parse_advertisement(answer.read())


def pack_request(want: str, spec: str | None) -> bytes:
    capabilities = "side-band-64k ofs-delta no-progress" + (" filter" if spec else "")
    body = packet(f"want {want} {capabilities}\n")
    if spec:
        body += packet(f"filter {spec}\n")
    return body + FLUSH + packet("done\n")


def fetch_pack(url: str, folder: str, kinds: set[str] | None = None) -> tuple[str, str, list[tuple[str, str]]]:
    """Stage the pack of HEAD's history below folder: (path, head, refs)."""
    top, capabilities, refs = discover(url)
    if top is None:
        raise ValueError(f"{url} has no HEAD")
    spec = partial_filter(kinds) if "filter" in capabilities.split() else None
    request = urllib.request.Request(
        f"{url.rstrip('/')}/git-upload-pack",
        data=pack_request(top, spec),
        headers={"Content-Type": "application/x-git-upload-pack-request", "Accept": "application/x-git-upload-pack-result"},
    )
    with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
        pack = demultiplex(answer.read())
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"pack-{pack_id(pack)}.pack")
    with open(path, "wb") as f:
        f.write(pack)
    return path, top, refs
