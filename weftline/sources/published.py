"""Files that a job makes visible at once, without a move: tasks write under final names, and one list in `_published` says which of them count.

A name begins with its job. A file of a job without a list (it still runs, it failed, or a lost task was run again) is never read, and
nothing is copied, as object stores do for a move. Files of other origin in the same folder are always read.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable

from pyarrow import fs

LISTS = "_published"
OWN = re.compile(r"part-[0-9a-f]{32}-[0-9a-f]{32}\.")


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    system, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inside.rstrip("/")


def new_job() -> str:
    return uuid.uuid4().hex


def new_name(job: str, suffix: str) -> str:
    return f"part-{job}-{uuid.uuid4().hex}{suffix}"


def publish(folder: str, names: Iterable[str], key: str) -> bool:
    """Makes files (names in the folder) visible under a key. False, and no change, if something was published under it before."""
    system, inside = file_system(folder)
    target = f"{inside}/{LISTS}/{key}.json"
    if system.get_file_info(target).type == fs.FileType.File:
        return False
    system.create_dir(f"{inside}/{LISTS}", recursive=True)
    draft = f"{inside}/{LISTS}/.{key}-{uuid.uuid4().hex}"
    with system.open_output_stream(draft, compression=None) as out:
        out.write(json.dumps(sorted(names)).encode())
    system.move(draft, target)
    return True


def discard(folder: str, names: Iterable[str]) -> None:
    """Deletes files that were not published; those already gone are passed."""
    system, inside = file_system(folder)
    for name in names:
        try:
            system.delete_file(f"{inside}/{name}")
        except FileNotFoundError:
            continue


def listing(folder: str, suffix: str) -> tuple[list[str], list[str]]:
    """The folder's files of a suffix, with those below: what readers see, and what no list names. Sorted whole paths."""
    system, inside = file_system(folder)
    start = folder[: len(folder.rstrip("/")) - len(inside)] if folder.rstrip("/").endswith(inside) else ""
    found = [f.path for f in system.get_file_info(fs.FileSelector(inside, recursive=True, allow_not_found=True)) if f.type == fs.FileType.File]
    listed = set()
    for path in found:
        parent, _, name = path.rpartition("/")
        if parent.endswith(f"/{LISTS}") and name.endswith(".json") and not name.startswith("."):
            with system.open_input_stream(path, compression=None) as stream:
                listed |= {f"{parent.removesuffix(LISTS)}{n}" for n in json.loads(stream.read())}
    files = sorted(p for p in found if p.endswith(suffix))
    seen = [start + p for p in files if p in listed or not OWN.match(p.rpartition("/")[2])]
    shown = set(seen)
    return seen, [start + p for p in files if start + p not in shown]


def discard_job(folder: str, job: str, suffix: str) -> None:
    """Deletes a job's files that no list names: those of its killed tasks too, whose names nobody was told."""
    system, inside = file_system(folder)
    if system.get_file_info(inside).type == fs.FileType.Directory:
        discard(folder, [n for n in (p.rpartition("/")[2] for p in listing(folder, suffix)[1]) if n.startswith(f"part-{job}-")])


def sweep(folder: str, suffix: str) -> int:
    """Deletes files of jobs that no list names, for when no job is writing; how many they were."""
    left = listing(folder, suffix)[1]
    inside = file_system(folder)[1]
    discard(folder, [file_system(p)[1].removeprefix(f"{inside}/") for p in left])
    return len(left)
