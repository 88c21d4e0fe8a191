"""The engine from a command line: python -m spindrift <verb> ..."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable
from pathlib import Path
from typing import TextIO

from spindrift.plans.output import append_to, line_numbers

#: Verbs, and the options each of them takes. What they work on: a prompt, a file, or nothing.
PROMPT = {"ask": ("web",), "search": ("k", "mmr"), "query": ("v", "mode")}
FILE = {
    "summarize": ("rng", "rag"), "explain": ("fn", "rng", "mode"), "test": ("fn", "rag", "out"), "edit": ("fn", "rng", "rag"),
    "fix": ("fn", "rng", "rag"), "refactor": ("fn", "rng", "rag"), "comment": ("fn",),
}
OTHER = {"index": (), "chat": ("mode",), "flush": ()}
MODES = {"explain": "balanced", "query": "fast", "chat": "fast"}
#: The fewest and the most web results.
WEB = (1, 10)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("spindrift", description="index a source tree and ask about it")
    out.add_argument("--config", default=".spindrift.toml")
    verbs = out.add_subparsers(dest="verb", required=True)
    for verb, options in (PROMPT | FILE | OTHER).items():
        p = verbs.add_parser(verb)
        if verb in FILE:
            p.add_argument("file")
        if verb in PROMPT or verb == "edit":
            p.add_argument("prompt", nargs="+")
        for o in options:
            if o in ("rag", "mmr", "v"):
                p.add_argument(f"--{o}", action="store_true")
            elif o in ("k", "web"):
                p.add_argument(f"--{o}", type=int, default={"k": 5, "web": 0}[o])
            else:
                p.add_argument(f"--{o}", default=MODES.get(verb) if o == "mode" else "")
    return out


def run(engine, argv: list[str], out: TextIO = sys.stdout, read: Callable[[], str] = sys.stdin.readline) -> None:
    """One command on an engine. Verbs that need the index build it if it is missing or stale."""
    a = parser().parse_args(argv)
    say = lambda text: print(text, file=out)
    prompt = " ".join(getattr(a, "prompt", [])).strip()
    retrieves = a.verb in ("search", "query", "chat", "explain") or getattr(a, "rag", False)
    if retrieves:
        engine.ensure_index()
    if a.verb == "index":
        began = time.monotonic()
        say(f"Indexing project at {engine.config.root}")
        say(f"Indexed {engine.index()} chunks in {engine.config.store} [elapsed: {time.monotonic() - began:.1f}s]")
    elif a.verb == "flush":
        n = engine.flush_memory()
        say("No memory updates" if not n else f"Memory updated ({n} item{'s' if n > 1 else ''})")
    elif a.verb == "chat":
        say("Starting a chat. Type 'exit' to quit.")
        chat = engine.chat(mode=a.mode)
        while (line := read()) and line.strip() != "exit":
            if line.strip():
                say(chat.send(line.strip()))
    elif a.verb == "ask":
        say(engine.ask(prompt, **({"web": min(max(a.web, WEB[0]), WEB[1])} if a.web > 0 else {})))
    elif a.verb in ("search", "query"):
        try:
            got = engine.search(prompt, k=a.k, mmr=a.mmr) if a.verb == "search" else engine.query(prompt, mode=a.mode, structured=a.v)
        except LookupError:
            got = ""
        say(got or "No relevant results found")
    else:
        options = {"function": getattr(a, "fn", "").strip(), "lines": line_numbers(getattr(a, "rng", ""))}
        if "rag" in a:
            options["rag"] = a.rag
        if "mode" in a:
            options["mode"] = a.mode
        if getattr(a, "out", ""):
            options["handlers"] = (append_to(a.out),)
        if a.verb == "edit":
            options["prompt"] = prompt
        verb = {"test": "generate_tests"}.get(a.verb, a.verb)
        say(getattr(engine, verb)(a.file.strip(), **options))


def main(argv: list[str] | None = None) -> int:
    from spindrift.plans.engine import Engine
    from spindrift.plans.provider import HttpProvider
    from spindrift.session import get_session
    from spindrift.sources.config import Config, project_root
    from spindrift.sources.web import get_page

    argv = sys.argv[1:] if argv is None else argv
    c = Config.load(parser().parse_args(argv).config)
    c.root = project_root(c.root)
    c.store = str(Path(c.store).resolve())
    provider = HttpProvider("http://localhost:11434", c.model, c.embedding_model)
    try:
        if not provider.ping():
            raise LookupError(f"the model server has not both of {c.model} and {c.embedding_model}")
        run(Engine(get_session(), c, provider, get_page), argv)
    except (LookupError, ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0
