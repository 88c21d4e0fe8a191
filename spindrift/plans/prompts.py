"""Prompt texts and their rendering; driver-side strings over at most k results."""

from __future__ import annotations

from spindrift.streaming.memory import memory_text

ROLE = "You are an experienced software engineer who helps with a code base."
STRUCTURE = "Answer with short headed sections: summary, details with file references, next steps."
FORMATTING = "Use Markdown. Keep code in fenced blocks with the language named."
_CODE = "Reply with one fenced code block that holds the complete code, and nothing else."
CONTENT = {
    "ask": "Answer the question. Use the context where there is some; say so if you don't know.",
    "chat": "Go on with the conversation. Use the context where it helps, and don't invent code that isn't shown.",
    "query": "Answer from the context alone: be exact, name files and lines, and say so if the context doesn't answer it.",
    "explain": "Explain the target: its purpose, how it works step by step, what it depends on, and what is easy to get wrong.",
    "summarize": "Summarise the target: its responsibility, its main parts, and how they work together.",
    "edit": "Change the target as the request asks, and nothing beyond it. " + _CODE,
    "fix": "Find and mend the faults of the target; keep its behaviour otherwise. " + _CODE,
    "refactor": "Improve the structure of the target without changing what it does. " + _CODE,
    "comment": "Add documentation comments to the target; leave the code as it is. " + _CODE,
    "test-go": "Write table-driven Go tests for the target with the standard testing package. " + _CODE,
    "test-generic": "Write unit tests for the target in the usual framework of its language. " + _CODE,
}


def test_template(path: str) -> str:
    return "test-go" if path.endswith(".go") else "test-generic"


def render(template: str, prompt: str = "", *, system: str = "", memory: dict | None = None, structured: bool = False, summary: str = "", target: dict | None = None, chunks: list[dict] = ()) -> str:
    """memory shows only with a summary; target: type, name, body; chunks: source, score, text."""
    if template not in CONTENT:
        raise KeyError(f"template {template} not found")
    kind = f"TARGET {target['type'].upper()}: {target['name']}\n" if target else ""
    if template == "test-generic":  # stands alone
        return f"{kind}\n{CONTENT[template]}\n"
    out = [system or ROLE]
    if memory and memory["project_summary"]:
        out.append("PROJECT MEMORY:\n" + memory_text(memory))
    out.append(kind + CONTENT[template])
    if structured:
        out.append("STRUCTURE:\n" + STRUCTURE)
    out.append("FORMATTING:\n" + FORMATTING)
    if summary:
        out.append("REPOSITORY OVERVIEW:\n" + summary)
    if target and target.get("body"):
        out.append(f"TARGET BODY:\n```\n{target['body']}\n```")
    if chunks:
        parts = [f"[{i}] {c['source']}" + (f"\nScore: {c['score']:.3f}" if c["score"] > 0 else "") + f"\n\n{c['text']}\n\n---" for i, c in enumerate(chunks, 1)]
        out.append("CONTEXT:\n\n" + "\n\n".join(parts))
    if prompt:
        out.append("USER REQUEST:\n" + prompt)
    return "\n\n".join(out) + "\n"


def memory_prompt(user: str, assistant: str, memory: dict) -> str:
    return (
        "Update the long-term memory of a project from one interaction. Keep only what lasts: decisions, goals, stated "
        'preferences, recurring topics. Reply with JSON alone: {"summary_update": "", "topics_add": [], "preferences_add": []}, '
        f"with new information only.\n\nUSER_INPUT:\n{user}\n\nASSISTANT_OUTPUT:\n{assistant}\n\nCURRENT_PROJECT_MEMORY:\n{memory_text(memory)}\n"
    )
