"""What is done with a model's reply: the code in it goes to a file."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

FENCE = "```"
#: The line between what a file holds and what is added to it, by language of the fence.
SEPARATORS = {
    "go": "\n\n// ---- AI GENERATED CODE ----\n\n",
    "js": "\n\n// ---- AI GENERATED CODE ----\n\n",
    "ts": "\n\n// ---- AI GENERATED CODE ----\n\n",
    "python": "\n\n# ---- AI GENERATED CODE ----\n\n",
}


@dataclass(frozen=True)
class Code:
    content: str
    language: str = ""

    @classmethod
    def of(cls, reply: str) -> Code:
        """The first fenced block as it stands, line end included; without a fence the whole reply."""
        _, fence, rest = reply.partition(FENCE)
        if not fence:
            return cls(reply)
        language, newline, body = rest.partition("\n")
        code, closed, _ = body.partition(FENCE)
        if not newline or not closed:
            raise ValueError("the fenced block has no end")
        return cls(code, language.strip())

    def append(self, path: str) -> None:
        """At the end of a file, after a separator; a file that isn't there is made, with its folders."""
        p = _given(path)
        p.parent.mkdir(parents=True, exist_ok=True)
        with p.open("a", encoding="utf-8", newline="") as f:
            f.write((SEPARATORS.get(self.language, "\n\n") if f.tell() or p.stat().st_size else "") + self.content)

    def replace(self, path: str, start: int, end: int) -> None:
        """In place of lines start to end, from 1, both included; beyond the last line they mean the last."""
        p = _given(path)
        if not 1 <= start <= end:
            raise ValueError(f"no such lines: {start}-{end}")
        lines = p.read_bytes().decode().split("\n")
        start, end = min(start, len(lines)), min(end, len(lines))
        head = "".join(x + "\n" for x in lines[: start - 1])
        own = self.content if self.content.endswith("\n") else self.content + "\n"
        p.write_bytes((head + own + "\n".join(lines[end:])).encode())


def _given(path: str) -> Path:
    if not path:
        raise ValueError("a path is needed")
    return Path(path)


def append_to(path: str):
    """A handler of replies, for Options.handlers."""
    return lambda reply: Code.of(reply).append(path)


def line_numbers(text: str) -> tuple[int, int] | None:
    """(start, end) of "start-end"; None of an empty text."""
    if not text.strip():
        return None
    parts = text.strip().split("-")
    if len(parts) != 2:
        raise ValueError(f"lines are given as start-end, not {text!r}")
    return int(parts[0]), int(parts[1])
