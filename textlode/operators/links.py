"""Links around printed paths (OSC 8): a format with variables, or one of the known names of formats."""

from __future__ import annotations

import os
import re
import socket
import subprocess
from dataclasses import dataclass

#: Formats by name.
FORMATS = {
    "cursor": "cursor://file{path}:{line}:{column}",
    "default": "file://{host}{path}",
    "file": "file://{host}{path}",
    "grep+": "grep+://{path}:{line}",
    "kitty": "file://{host}{path}#{line}",
    "macvim": "mvim://open?url=file://{path}&line={line}&column={column}",
    "none": "",
    "textmate": "txmt://open?url=file://{path}&line={line}&column={column}",
    "vscode": "vscode://file{path}:{line}:{column}",
    "vscode-insiders": "vscode-insiders://file{path}:{line}:{column}",
    "vscodium": "vscodium://file{path}:{line}:{column}",
}
VARIABLES = ("path", "line", "column", "host", "wslprefix")
OPEN, MIDDLE, CLOSE = "\x1b]8;;", "\x1b\\", "\x1b]8;;\x1b\\"
_PIECE = re.compile(r"\{\{|\}\}|\{([^}{][^}]*|)\}|[^{}]+")
_ODD = re.compile(r"[^0-9A-Za-z/:._~\x80-\U0010ffff-]")
_SCHEME = re.compile(r"[0-9A-Za-z+.-]+:")


def escaped(path: str) -> str:
    """A path within a link: ASCII characters with a meaning of their own by their codes."""
    return _ODD.sub(lambda m: f"%{ord(m[0]):02X}", path)


@dataclass(frozen=True)
class Links:
    """A format as text and (variable,) pieces; relative paths begin at `base`."""

    pieces: tuple[str | tuple[str], ...]
    base: str
    host: str

    @classmethod
    def of(cls, form: str, hostname_bin: str = "") -> Links | None:
        """The links of a format or of its name; None for none. Formats without sense raise ValueError."""
        form = FORMATS.get(form, form)
        pieces: list[str | tuple[str]] = []
        at = 0
        while at < len(form):
            m = _PIECE.match(form, at)
            if not m:
                raise ValueError(f"hyperlink format {form!r}: a variable is not {'closed' if form[at] == '{' else 'opened'}")
            if m[1] is None:
                pieces.append(m[0][0] if m[0] in ("{{", "}}") else m[0])
            elif m[1] in VARIABLES:
                pieces.append((m[1],))
            else:
                raise ValueError(f"hyperlink format {form!r}: no variable {m[1]!r} (there are {', '.join(VARIABLES)})")
            at = m.end()
        if not pieces:
            return None
        used = {p[0] for p in pieces if isinstance(p, tuple)}
        if "path" not in used:
            raise ValueError(f"hyperlink format {form!r}: the variable path is needed, or a name of {', '.join(FORMATS)}")
        if "column" in used and "line" not in used:
            raise ValueError(f"hyperlink format {form!r}: a column needs a line")
        first = next(k for k, p in enumerate(pieces) if isinstance(p, tuple))
        if not _SCHEME.match("".join(pieces[:first])):
            raise ValueError(f"hyperlink format {form!r} must begin with a scheme")
        return cls(tuple(pieces), os.getcwd(), host_name(hostname_bin) if "host" in used else "")

    def opened(self, path: str, line: int | None = None, column: int | None = None) -> str:
        """What begins a link; `CLOSE` ends it."""
        values = {"path": escaped(os.path.realpath(os.path.join(self.base, path))), "line": str(line or 1), "column": str(column or 1), "host": self.host, "wslprefix": ""}
        return OPEN + "".join(p if isinstance(p, str) else values[p[0]] for p in self.pieces) + MIDDLE


def host_name(program: str = "") -> str:
    """What `program` says, or the name of the driver's host."""
    if program:
        try:
            done = subprocess.run([program], capture_output=True, text=True, timeout=10, check=True)
            if done.stdout.strip():
                return done.stdout.strip()
        except (OSError, subprocess.SubprocessError):
            pass
    return socket.gethostname()
