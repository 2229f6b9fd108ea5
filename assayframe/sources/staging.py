"""Staging of raw archives: guarded extraction and whole downloads, on one machine.

Both leave either nothing or the whole result: work is done beside the final
place and renamed at the end.
"""

from __future__ import annotations

import os
import shutil
import tarfile
import urllib.request
import zipfile

MARKER = ".extracted"


def _inside(root: str, name: str) -> str:
    place = os.path.realpath(os.path.join(root, name))
    if place != os.path.realpath(root) and not place.startswith(os.path.realpath(root) + os.sep):
        raise ValueError(f"archive member leaves its folder: {name}")
    return place


def extract(archive: str, folder: str) -> bool:
    """Unpack a zip or tar archive once; False where its marker says that it was done.

    A member that would land outside the folder, or a link, is an error before
    anything is written.
    """
    marker = os.path.join(folder, f"{MARKER}-{os.path.basename(archive)}")
    if os.path.exists(marker):
        return False
    os.makedirs(folder, exist_ok=True)
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            for name in z.namelist():
                _inside(folder, name)
            z.extractall(folder)
    else:
        with tarfile.open(archive) as t:
            for member in t.getmembers():
                _inside(folder, member.name)
                if not (member.isfile() or member.isdir()):
                    raise ValueError(f"archive member is no file: {member.name}")
            t.extractall(folder, filter="data")
    with open(marker, "w", encoding="utf-8") as f:
        f.write("done\n")
    return True


def download(url: str, place: str, size: int | None = None, overwrite: bool = False, chunk: int = 1 << 20) -> bool:
    """Fetch a file in chunks; False where it is there already with the right size."""
    if os.path.exists(place) and not overwrite and (size is None or os.path.getsize(place) == size):
        return False
    os.makedirs(os.path.dirname(place) or ".", exist_ok=True)
    part = f"{place}.part"
    with urllib.request.urlopen(url) as source, open(part, "wb") as out:
        shutil.copyfileobj(source, out, chunk)
    if size is not None and os.path.getsize(part) != size:
        os.remove(part)
        raise ValueError(f"{url}: {size} bytes expected")
    os.replace(part, place)
    return True
