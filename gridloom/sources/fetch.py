"""Downloads: resumed, verified by size and digest, renamed when whole. Driver-side, outside the engine."""

from __future__ import annotations

import contextlib
import hashlib
import html
import re
import shutil
import urllib.parse
import urllib.request
import zipfile
from dataclasses import dataclass
from pathlib import Path

CHUNK = 8 << 20
ATTEMPTS = 3


@dataclass(frozen=True)
class Source:
    name: str
    url: str
    archive_name: str
    expected_bytes: int | None = None
    sha256: str | None = None
    #: Whether a page in place of the archive is a form to confirm.
    confirm: bool = False


def file_sha256(path: Path, length: int | None = None) -> str:
    with open(path, "rb") as data:
        return hashlib.file_digest(data, "sha256").hexdigest()[:length]


def verified(path: Path, expected_bytes: int | None, sha256: str | None) -> bool:
    return path.is_file() and (expected_bytes is None or path.stat().st_size == expected_bytes) and (sha256 is None or file_sha256(path) == sha256)


def form_values(page: str) -> dict[str, str]:
    return dict(re.findall(r'name="([^"]+)"\s+value="([^"]*)"', page))


def confirmed_url(page: str, url: str) -> str:
    """Where a page that asks for confirmation sends its form: its action (or ``url``) with the form's fields as query."""
    action = re.search(r'<form[^>]*\saction="([^"]+)"', page)
    fields = form_values(page)
    if not action and not fields:
        raise ValueError(f"{url} answered with a page that has no form")
    base = html.unescape(action[1]) if action else url
    place = urllib.parse.urlsplit(base)
    query = dict(urllib.parse.parse_qsl(place.query)) | {k: html.unescape(v) for k, v in fields.items()}
    return urllib.parse.urlunsplit(place._replace(query=urllib.parse.urlencode(query)))


def selected_sources(sources: dict[str, Source], modes: dict[str, list[str]], mode: str) -> list[Source]:
    """The sources that a mode needs, in its order; an unknown mode or source is refused."""
    if mode not in modes:
        raise ValueError(f"unknown mode {mode!r}: one of {sorted(modes)}")
    return [sources[key] for key in modes[mode]]


def target_for(source: Source, folders: dict[str, Path]) -> Path:
    """The folder into which a source is unpacked; one that is not configured is refused."""
    if source.name not in folders:
        raise ValueError(f"no folder is configured for {source.name}")
    return folders[source.name]


def verify_extracted(folder: Path, least: dict[str, int] | None = None, folders: list[str] | None = None, suffixes: tuple[str, ...] = (".jpg", ".jpeg", ".png")) -> dict[str, int]:
    """Images below each folder of ``least``; too few, or a folder of ``folders`` that is not there, are refused."""
    lost = [name for name in folders or [] if not (folder / name).is_dir()]
    found = {name: sum(p.suffix.lower() in suffixes for p in (folder / name).rglob("*") if p.is_file()) for name in least or {}}
    few = [f"{name}: {found[name]} of {n}" for name, n in (least or {}).items() if found[name] < n]
    if lost or few:
        raise ValueError(f"{folder} is not whole: {[*lost, *few]}")
    return found


def obtain(source: Source, archives: Path, folder: Path, least: dict[str, int] | None = None, folders: list[str] | None = None, force: bool = False, opener=urllib.request.urlopen) -> Path:
    """The unpacked source: as it is where it is whole already, else from its archive, fetched if need be.

    The archive is unpacked beside the folder, member by member, and takes its name once it is whole.
    """
    if not force and folder.is_dir():
        with contextlib.suppress(ValueError):
            verify_extracted(folder, least, folders)
            return folder
    archive = fetch(source, archives, force, opener)
    beside = folder.with_name(f".{folder.name}.part")
    shutil.rmtree(beside, ignore_errors=True)
    with zipfile.ZipFile(archive) as packed:
        root = beside.resolve()
        for member in packed.infolist():
            if not (root / member.filename).resolve().is_relative_to(root):
                raise ValueError(f"{archive}: {member.filename} lies outside the archive")
            packed.extract(member, beside)
    verify_extracted(beside, least, folders)
    shutil.rmtree(folder, ignore_errors=True)
    beside.replace(folder)
    return folder


def fetch(source: Source, folder: Path, force: bool = False, opener=urllib.request.urlopen) -> Path:
    """The archive, reused where size and digest agree; else fetched into ``.part``, resumed by range up to ATTEMPTS times."""
    target = folder / source.archive_name
    if not force and target.exists() and verified(target, source.expected_bytes, source.sha256):
        return target
    folder.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f"{target.name}.part")
    url, asked = source.url, False
    for attempt in range(ATTEMPTS):
        start = part.stat().st_size if part.exists() else 0
        try:
            while True:
                answer = opener(urllib.request.Request(url, headers={"Range": f"bytes={start}-"} if start else {}))
                if "text/html" not in (answer.headers.get("Content-Type") or ""):
                    break
                with answer:
                    if asked or not source.confirm:
                        raise ValueError(f"{url} answered with a page, not with an archive")
                    url, asked = confirmed_url(answer.read().decode("utf-8", "replace"), url), True
            with answer:
                with open(part, "ab" if start and answer.status == 206 else "wb") as out:
                    while data := answer.read(CHUNK):
                        out.write(data)
            break
        except OSError:
            if attempt == ATTEMPTS - 1:
                raise
    if not verified(part, source.expected_bytes, source.sha256):
        part.unlink(missing_ok=True)
        raise ValueError(f"{source.archive_name}: size or digest differs from what is expected")
    part.replace(target)
    return target
