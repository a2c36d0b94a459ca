"""Ignore files in gitignore syntax, for the scanner's walk."""

from __future__ import annotations

import os
import posixpath
import re
from dataclasses import dataclass, field

from tessera.sources import files as places


def _translate(pattern: str) -> str:
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        if pattern.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif pattern.startswith("**", at):
            out, at = out + ".*", at + 2
        elif c == "*":
            out, at = out + "[^/]*", at + 1
        elif c == "?":
            out, at = out + "[^/]", at + 1
        elif c == "[" and (end := pattern.find("]", at + 2)) > 0:
            body = pattern[at + 1 : end].replace("\\", "\\\\")
            out, at = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "\\" and at + 1 < len(pattern):
            out, at = out + re.escape(pattern[at + 1]), at + 2
        else:
            out, at = out + re.escape(c), at + 1
    return out


@dataclass
class Rules:
    """The rules of one ignore file, or of extra patterns; the last that matches decides."""

    base: str
    rules: list[tuple[bool, bool, re.Pattern]] = field(default_factory=list)

    def add(self, line: str) -> None:
        line = line.rstrip("\n").rstrip("\r")
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if not line or line.startswith("#"):
            return
        keep = line.startswith("!")
        line = line[1:] if keep else line
        folder = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        line = line.lstrip("/")
        if not line:
            return
        try:
            found = re.compile(("" if anchored else "(?:.*/)?") + _translate(line) + r"\Z", re.S)
        except re.error:
            return
        self.rules.append((keep, folder, found))

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored; False: kept explicitly; None: no rule matches."""
        relative = path.removeprefix(self.base).lstrip("/")
        for keep, folder, found in reversed(self.rules):
            if (is_dir or not folder) and found.match(relative):
                return not keep
        return None


def read_rules(path: str, base: str) -> Rules | None:
    if places.kind(path) != "file":
        return None
    rules = Rules(base)
    with places.opened(path) as found:
        for line in found.read().decode("utf-8", errors="replace").split("\n"):
            rules.add(line)
    return rules


def global_rules(root: str) -> list[Rules]:
    """The user's global ignore file and the repository's exclude file."""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    found = [read_rules(os.path.join(home, "git", "ignore"), root), read_rules(os.path.join(root, ".git", "info", "exclude"), root)]
    return [r for r in found if r]


def in_repository(root: str) -> bool:
    at = places.absolute(root)
    while True:
        if places.kind(posixpath.join(at, ".git")):
            return True
        at, before = places.parent(at), at
        if at == before:
            return False


#: A folder still to be read: its path and the rules from above it.
Open = tuple[str, list[Rules]]


def _entries(folder: str, above: list[Rules], extra: Rules, versioned: bool, hidden: bool) -> tuple[list[str], list[Open]]:
    """(files, folders) of one folder that nothing excludes; both empty where it can't be read."""
    own = [read_rules(posixpath.join(folder, ".ignore"), folder), read_rules(posixpath.join(folder, ".gitignore"), folder) if versioned else None]
    rules, files, folders = above + [r for r in reversed(own) if r], [], []
    try:
        entries = places.entries(folder)
    except OSError:
        return [], []
    for name, path, kind in entries:
        is_dir = kind == "dir"
        if name == ".git" or (name.startswith(".") and not hidden):
            continue
        if extra.verdict(path, is_dir):
            continue
        if next((v for r in reversed(rules) if (v := r.verdict(path, is_dir)) is not None), None):
            continue
        if is_dir:
            folders.append((path, rules))
        else:
            files.append(path)
    return files, folders


class Walk:
    """Files below ``root`` that no ignore file and no extra pattern excludes; links are not followed.

    Folders that can't be read are skipped.  ``spread`` reads the uppermost folders
    and leaves the others, with the rules that hold for them, to ``below``, which
    can run elsewhere.
    """

    def __init__(self, root: str, patterns=(), hidden: bool = False):
        self.root, self.hidden, self.versioned = root, hidden, in_repository(root)
        self.extra = Rules(root)
        for pattern in patterns:
            self.extra.add(pattern)

    def top(self) -> Open:
        return self.root, global_rules(self.root) if self.versioned else []

    def spread(self, least: int) -> tuple[list[str], list[Open]]:
        """(files met, folders left), as soon as ``least`` folders are left or none."""
        files, left = [], [self.top()]
        while left and len(left) < least:
            met, deeper = [], []
            for folder in left:
                own, inner = _entries(*folder, self.extra, self.versioned, self.hidden)
                met += own
                deeper += inner
            files, left = files + met, deeper
        return files, left

    def below(self, todo: list[Open]):
        """Paths of the files in and below the folders ``todo``."""
        todo = list(todo)
        while todo:
            files, folders = _entries(*todo.pop(), self.extra, self.versioned, self.hidden)
            yield from files
            todo += folders


def walk(root: str, patterns=(), hidden: bool = False):
    """All paths of ``Walk``, read here."""
    whole = Walk(root, patterns, hidden)
    return whole.below([whole.top()])
