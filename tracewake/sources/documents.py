"""Canonical JSON, journals, locks and files that are never overwritten."""

from __future__ import annotations

import contextlib
import hashlib
import json
import math
import os
import tempfile
from collections.abc import Iterator


def _number(x: float) -> str:
    """A double as ECMAScript prints it, which canonical JSON asks for."""
    if not math.isfinite(x):
        raise ValueError(f"{x} has no JSON form")
    if x == 0:
        return "0"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    mantissa, _, exponent = repr(x).partition("e")
    if not exponent:
        return mantissa
    power = int(exponent)
    if -7 < power < 0:
        sign, digits = ("-", mantissa[1:]) if mantissa[0] == "-" else ("", mantissa)
        return f"{sign}0.{'0' * (-power - 1)}{digits.replace('.', '')}"
    return f"{mantissa.removesuffix('.0')}e{'+' if power > 0 else '-'}{abs(power)}"


def canonical(value) -> str:
    """RFC 8785: keys in UTF-16 order, no spaces, shortest numbers."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, str):
        value.encode("utf-8")
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        if abs(value) > 2**53 - 1:
            raise ValueError(f"{value} is not exact as a double")
        return str(value)
    if isinstance(value, float):
        return _number(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise TypeError("keys must be strings")
        return "{" + ",".join(f"{canonical(k)}:{canonical(v)}" for k, v in sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be"))) + "}"
    raise TypeError(f"{type(value).__name__} has no JSON form")


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def publish(files: dict[str, bytes], folder: str) -> dict[str, str]:
    """Writes files that do not exist; equal ones are unchanged, and if any differs nothing is written."""
    state = {}
    for name, data in files.items():
        path = os.path.join(folder, name)
        if os.path.exists(path):
            with open(path, "rb") as f:
                if f.read() != data:
                    raise FileExistsError(f"{name} exists with other content")
            state[name] = "unchanged"
        else:
            state[name] = "written"
    os.makedirs(folder, exist_ok=True)
    for name, data in files.items():
        if state[name] == "written":
            path = os.path.join(folder, name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path))
            with os.fdopen(handle, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(temporary, path)
            finally:
                os.unlink(temporary)
    return state


def release(documents: dict[str, object], folder: str) -> dict:
    """Canonical documents and a manifest of their bytes and digests."""
    files = {name: canonical(value).encode() for name, value in documents.items()}
    manifest = {"files": [{"name": n, "bytes": len(d), "sha256": hashlib.sha256(d).hexdigest()} for n, d in sorted(files.items())]}
    publish(files | {"manifest.json": canonical(manifest).encode()}, folder)
    return manifest


def verify_release(folder: str) -> list[str]:
    """Files of a release that are missing, changed or not canonical."""
    with open(os.path.join(folder, "manifest.json"), encoding="utf-8") as f:
        manifest = json.load(f)
    out = []
    for entry in manifest["files"]:
        try:
            with open(os.path.join(folder, entry["name"]), "rb") as f:
                data = f.read()
        except FileNotFoundError:
            out.append(f"{entry['name']}: missing")
            continue
        if hashlib.sha256(data).hexdigest() != entry["sha256"] or len(data) != entry["bytes"]:
            out.append(f"{entry['name']}: changed")
        elif canonical(json.loads(data)).encode() != data:
            out.append(f"{entry['name']}: not canonical")
    return out


class Journal:
    """An append-only file: a header, then one canonical line for each key, in the order of ``keys``.

    A line is on disk before ``append`` returns. A torn last line, as a crash leaves it, is cut off on opening; any
    other line that is not canonical, out of order, repeated or foreign is an error.
    """

    def __init__(self, path: str, header: dict, keys: list[str]):
        self.path, self.keys, self.records = path, keys, {}
        first = canonical(header) + "\n"
        if not os.path.exists(path):
            with open(path, "x", encoding="utf-8") as f:
                f.write(first)
                f.flush()
                os.fsync(f.fileno())
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if not text.startswith(first):
            raise ValueError("the journal belongs to another run")
        whole, _, torn = text.rpartition("\n")
        if torn:
            with open(path, "r+", encoding="utf-8") as f:
                f.truncate(len((whole + "\n").encode()))
        for line in whole.split("\n")[1:]:
            record = json.loads(line)
            if canonical(record) != line:
                raise ValueError("a line is not canonical")
            self._accept(record["key"])
            self.records[record["key"]] = record["value"]
        self.size = os.path.getsize(path)

    def _accept(self, key: str) -> None:
        if len(self.records) >= len(self.keys) or self.keys[len(self.records)] != key:
            raise ValueError(f"{key} is not the next key")

    @property
    def missing(self) -> list[str]:
        return self.keys[len(self.records) :]

    def append(self, key: str, value) -> None:
        self._accept(key)
        if os.path.getsize(self.path) != self.size:
            raise RuntimeError("another writer changed the journal")
        line = (canonical({"key": key, "value": value}) + "\n").encode()
        with open(self.path, "ab") as f:
            f.write(line)
            f.flush()
            os.fsync(f.fileno())
        self.size += len(line)
        self.records[key] = value


@contextlib.contextmanager
def lock(path: str, owner: str) -> Iterator[None]:
    """Holds a lock file; a file held by another is an error, and so is finding it changed at the end."""
    with open(path, "x", encoding="utf-8") as f:
        f.write(owner)
    try:
        yield
    finally:
        with open(path, encoding="utf-8") as f:
            same = f.read() == owner
        if same:
            os.unlink(path)
    if not same:
        raise RuntimeError("the lock was taken over")
