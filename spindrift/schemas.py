"""Fixed schemas of stored tables, and enumerations."""

from enum import StrEnum

ITEMS = "file_path string, symbol string, kind string, start_line int, end_line int, content string, embedding array<double>"
SEGMENTS = ITEMS + ", generation string"
FILES = "path string, digest string, generation string"
META = "id int, project_root string, config_hash string, version string, created_at timestamp"
SUMMARY = "project_root string, content string, updated_at timestamp"
MEMORY = "id int, project_summary string, topics array<string>, preferences array<string>, updated_at timestamp, folded array<string>"
QUEUE = "id string, payload string, created_at timestamp"
DONE = "id string"
QUEUE_PAYLOAD = "user_input string, assistant_output string"
EXTRACTION = "summary_update string, topics_add array<string>, preferences_add array<string>"
CHUNKS = "start_line int, end_line int, text string, symbol string, kind string"
META_VERSION = "v2"


class Mode(StrEnum):
    NONE = "none"
    FAST = "fast"
    BALANCED = "balanced"
    DEEP = "deep"

    def settings(self) -> tuple[int, bool]:
        """(k, mmr); anything else counts as fast."""
        return {Mode.NONE: (0, False), Mode.BALANCED: (8, False), Mode.DEEP: (12, True)}.get(self, (5, False))

    @classmethod
    def _missing_(cls, value):
        return cls.FAST


class IndexStatus(StrEnum):
    MISSING = "missing"
    STALE = "stale"
    OK = "ok"


class Role(StrEnum):
    SYSTEM = "system"
    USER = "user"
    ASSISTANT = "assistant"
