"""Settings from TOML, with defaults."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from spindrift.functions.text import config_hash
from spindrift.sources.files import EXTENSIONS


@dataclass
class Config:
    root: str = "."
    store: str = ".spindrift"
    model: str = "llama3"
    embedding_model: str = "nomic-embed-text"
    temperature: float = 0.2
    extensions: list[str] = field(default_factory=lambda: list(EXTENSIONS))
    ignore: list[str] = field(default_factory=list)

    def __post_init__(self):
        if not 0 <= self.temperature <= 1:
            raise ValueError("temperature must be from 0 to 1")
        for name in ("root", "store", "model", "embedding_model"):
            if not getattr(self, name):
                raise ValueError(f"{name} must be set")
        self.extensions = [(e if e.startswith(".") else "." + e).lower() for e in map(str.strip, self.extensions)]

    @property
    def hash(self) -> str:
        return config_hash(self.extensions, self.ignore, self.embedding_model)

    @classmethod
    def load(cls, path: str) -> Config:
        """Defaults are written where there is no file."""
        p = Path(path)
        if not p.exists():
            c = cls()
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text("".join(f"{k} = {v!r}\n" if not isinstance(v, str) else f'{k} = "{v}"\n' for k, v in vars(c).items()))
            return c
        return cls(**tomllib.loads(p.read_text()))


def project_root(start: str = ".") -> str:
    """The nearest folder upward with .git, else where it starts."""
    p = Path(start).resolve()
    return str(next((d for d in (p, *p.parents) if (d / ".git").exists()), p))
