"""Extraction of validated plans, one task per archive.

A task writes into a folder of its own attempt and reads everything back; only a
verified tree is renamed to its final name, which must not exist. A retried or
doubled task therefore never meets a half-written tree of another attempt. Folders
must be on a file system that all executors mount.
"""

from __future__ import annotations

import hashlib
import os
import stat
import time
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.policies import ExtractLimits
from .wire import Budget, Extent, Listing, Ranged, Rejected, extents, member_chunks, scan

ROW = "archive string, plan_id string, status string, error string, files long, directories long, bytes long, cleanup string, removed_files long, removed_directories long, written array<struct<entry_id:string,target_path:string,kind:string,size:long,crc32:long,sha256:string>>"


def _identity(info: os.stat_result) -> tuple[int, int, int]:
    return info.st_dev, info.st_ino, stat.S_IFMT(info.st_mode)


class Tree:
    """A folder that only this attempt writes, made of regular files and directories."""

    def __init__(self, final: str, limits: ExtractLimits):
        if os.path.lexists(final):
            raise ValueError("OUTPUT_ALREADY_EXISTS_OR_INPUT")
        self.final, self.root, self.limits = final, f"{final}.attempt-{uuid.uuid4().hex}", limits
        os.makedirs(os.path.dirname(final) or ".", exist_ok=True)
        os.mkdir(self.root)
        self.made = {self.root: _identity(os.lstat(self.root))}
        self.folders: set[tuple[str, ...]] = set()
        self.files: set[tuple[str, ...]] = set()

    def path(self, parts: tuple[str, ...]) -> str:
        if not 0 < len(parts) <= 64 or any(p in ("", ".", "..") or "/" in p or "\0" in p or len(os.fsencode(p)) > 255 for p in parts):
            raise ValueError("HOST_NAME_UNSUPPORTED")
        return os.path.join(self.root, *parts)

    def folder(self, parts: tuple[str, ...]) -> None:
        for k in range(1, len(parts) + 1):
            if parts[:k] in self.files:
                raise ValueError("HOST_PATH_CONFLICT")
            if parts[:k] not in self.folders:
                if len(self.folders) >= self.limits.directories:
                    raise ValueError("ACTUAL_DIRECTORY_LIMIT")
                path = self.path(parts[:k])
                os.mkdir(path)
                self.made[path] = _identity(os.lstat(path))
                self.folders.add(parts[:k])

    def write(self, parts: tuple[str, ...], chunks: Iterator[bytes]) -> tuple[int, int, str]:
        if len(self.files) >= self.limits.files:
            raise ValueError("ACTUAL_FILE_LIMIT")
        self.folder(parts[:-1])
        size, crc, digest = 0, 0, hashlib.sha256()
        with open(self.path(parts), "xb") as out:
            self.made[out.name] = _identity(os.fstat(out.fileno()))
            self.files.add(parts)
            for chunk in chunks:
                out.write(chunk)
                size, crc = size + len(chunk), zlib.crc32(chunk, crc)
                digest.update(chunk)
        return size, crc, digest.hexdigest()

    def listing(self) -> tuple[dict[str, tuple[int, int, str]], set[str]]:
        """What is on disk: digests of the files, and the directories."""
        files, folders = {}, set()
        for base, names, leaves in os.walk(self.root):
            for name in [*names, *leaves]:
                full = os.path.join(base, name)
                if os.path.islink(full):
                    raise ValueError("OUTPUT_SET_CHANGED")
                inner = os.path.relpath(full, self.root)
                if name in names:
                    folders.add(inner)
                    continue
                size, crc, digest = 0, 0, hashlib.sha256()
                with open(full, "rb") as stream:
                    while chunk := stream.read(self.limits.chunk_bytes):
                        size, crc = size + len(chunk), zlib.crc32(chunk, crc)
                        digest.update(chunk)
                files[inner] = size, crc, digest.hexdigest()
        return files, folders

    def finish(self) -> None:
        try:
            os.rename(self.root, self.final)
        except OSError:
            raise ValueError("OUTPUT_ALREADY_EXISTS") from None

    def untouched(self) -> bool:
        """Whether the folder holds the files and directories that this attempt made, and nothing else."""

        def stop(error: OSError) -> None:
            raise error

        found = {self.root}.union(*({os.path.join(base, name) for name in names + leaves} for base, names, leaves in os.walk(self.root, onerror=stop)))
        return found == set(self.made) and all(_identity(os.lstat(path)) == known for path, known in self.made.items())

    def remove(self) -> tuple[str, int, int]:
        """Removes what this attempt made, deepest first: how that went, and the files and directories removed.

        A folder with anything else in it, or with something put in the place of its own, is left as it is.
        """
        gone = [0, 0]
        try:
            if not self.untouched():
                return "retained_ownership_unknown", *gone
        except OSError:
            return "retained_ownership_unknown", *gone
        try:
            for path in sorted(self.made, key=lambda p: (p.count(os.sep), p), reverse=True):
                if _identity(os.lstat(path)) != self.made[path]:
                    return "retained_ownership_unknown", *gone
                folder = stat.S_ISDIR(self.made[path][2])
                (os.rmdir if folder else os.unlink)(path)
                gone[folder] += 1
        except OSError:
            return "cleanup_failed", *gone
        return "removed", *gone


def extract_archive(source: Ranged, plan: dict, accept_plan_id: str, final: str, limits: ExtractLimits = ExtractLimits()) -> dict:
    """Writes a validated plan's members under `final`. `plan` has plan_id, archive_id, extractable, resolved (entry id to path) and kinds (entry id to type)."""
    began = time.monotonic()
    result = {"status": "failed", "error": None, "files": 0, "directories": 0, "bytes": 0, "cleanup": "not_created", "removed_files": 0, "removed_directories": 0, "written": []}
    tree: Tree | None = None

    def timed(chunks: Iterator[bytes]) -> Iterator[bytes]:
        for chunk in chunks:
            if time.monotonic() - began > limits.seconds:
                raise ValueError("WORKER_TIMEOUT")
            yield chunk

    try:
        if accept_plan_id != plan["plan_id"]:
            raise ValueError("PLAN_ACCEPTANCE_REQUIRED")
        listing: Listing = scan(source)
        if listing.archive_id != plan["archive_id"] or not listing.archive_id:
            raise ValueError("SOURCE_OR_PLAN_CHANGED")
        if not plan["extractable"]:
            raise ValueError("PLAN_NOT_EXTRACTABLE")
        kept = [e for e in listing.entries if e.entry_id in plan["resolved"]]
        paths = {e.entry_id: tuple(plan["resolved"][e.entry_id].split("/")) for e in kept}
        is_file = lambda e: plan["kinds"][e.entry_id] == "file"
        sizes = [e.declared_bytes for e in kept if is_file(e)]
        wanted = {paths[e.entry_id][:k] for e in kept for k in range(1, len(paths[e.entry_id]) + (not is_file(e)))}
        if len(sizes) > limits.files or len(wanted) > limits.directories or sum(sizes) > limits.total_bytes or max(sizes, default=0) > limits.file_bytes:
            raise ValueError("DECLARED_EXTRACTION_LIMIT")
        places: dict[str, Extent] = extents(source, listing, set(paths))  # every range is checked before anything is written
        budget = Budget(limits.total_bytes)
        tree = Tree(final, limits)
        for entry in kept:
            chunks = timed(member_chunks(source, places[entry.entry_id], limits, budget))
            target = "/".join(paths[entry.entry_id])
            if is_file(entry):
                size, crc, digest = tree.write(paths[entry.entry_id], chunks)
                result["bytes"] += size
                result["written"].append({"entry_id": entry.entry_id, "target_path": target, "kind": "file", "size": size, "crc32": crc, "sha256": digest})
            else:
                if any(chunks):
                    raise ValueError("DIRECTORY_HAS_CONTENT")
                tree.folder(paths[entry.entry_id])
                result["written"].append({"entry_id": entry.entry_id, "target_path": target, "kind": "directory", "size": 0, "crc32": None, "sha256": None})
        files, folders = tree.listing()
        expected = {w["target_path"]: (w["size"], w["crc32"], w["sha256"]) for w in result["written"] if w["kind"] == "file"}
        if set(files) != set(expected) or folders != {"/".join(p) for p in wanted}:
            raise ValueError("OUTPUT_SET_MISMATCH")
        if files != expected:
            raise ValueError("OUTPUT_CONTENT_MISMATCH")
        named = {w["target_path"] for w in result["written"]}
        result["written"] += [{"entry_id": None, "target_path": p, "kind": "directory", "size": 0, "crc32": None, "sha256": None} for p in sorted(folders - named)]
        tree.finish()
        result |= {"status": "verified", "cleanup": "not_needed"}
    except (ValueError, Rejected, OSError) as error:
        result["error"] = "EXTRACTION_IO_ERROR" if isinstance(error, OSError) else getattr(error, "code", str(error))
        if tree:
            result["cleanup"], result["removed_files"], result["removed_directories"] = tree.remove()
    if tree:
        result |= {"files": len(tree.files), "directories": len(tree.folders)}
    return result


def extract(contents: DataFrame, plans: DataFrame, entries: DataFrame, output: str, limits: ExtractLimits = ExtractLimits()) -> DataFrame:
    """Extracts every archive that has a plan, each under `output`/<plan id>: one row per archive with status, counts and what was written.

    `contents` has archive and content (or a null content and a path as archive); `plans` has archive,
    archive_id, plan_id, accept_plan_id, extractable and resolved; `entries` gives entry types.
    Nothing is written before the whole plan is checked against the archive.
    """
    kinds = entries.groupBy("archive").agg(F.map_from_entries(F.collect_list(F.struct("entry_id", "entry_type"))).alias("kinds"))
    jobs = plans.where("plan_id IS NOT NULL").join(kinds, "archive").join(contents.select("archive", "content"), "archive")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for job in frame.itertuples(index=False):
                plan = {"plan_id": job.plan_id, "archive_id": job.archive_id, "extractable": job.extractable, "resolved": dict(job.resolved), "kinds": dict(job.kinds)}
                final = os.path.join(output, job.plan_id)
                if job.content is not None:
                    result = extract_archive(Ranged.of(bytes(job.content)), plan, job.accept_plan_id, final, limits)
                else:
                    with os.fdopen(os.open(job.archive, os.O_RDONLY | os.O_NOFOLLOW), "rb") as stream:
                        result = extract_archive(Ranged(stream, os.fstat(stream.fileno()).st_size), plan, job.accept_plan_id, final, limits)
                yield pd.DataFrame([{"archive": job.archive, "plan_id": job.plan_id, **result}], dtype=object)

    columns = ["archive", "content", "archive_id", "plan_id", "accept_plan_id", "extractable", "resolved", "kinds"]
    return jobs.select(*columns).mapInPandas(run, ROW)
