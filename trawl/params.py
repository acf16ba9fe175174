"""Job parameters with the validation rules of the search tool's options.  A page limit applies only when asked for."""

from __future__ import annotations

from dataclasses import dataclass

MODES = ("default", "exact", "fuzzy")
OUTPUTS = ("text", "json")


@dataclass(frozen=True)
class SearchParams:
    keyword: str
    mode: str = "default"
    url: str | None = None
    file: str | None = None
    folder: str | None = None
    depth: int = 1
    max_pages: int | None = None
    max_bytes: int = 10 * 1024 * 1024
    max_hits: int = 0
    delay_ms: int = 100
    timeout_ms: int = 20000
    output: str = "text"
    allow_external: bool = False
    all_urls: bool = False

    def __post_init__(self):
        inputs = [x for x in (self.url, self.file, self.folder) if x]
        if len(inputs) != 1:
            raise ValueError("exactly one of url, file or folder is required")
        if self.keyword is None or not self.keyword.strip():
            raise ValueError("keyword must not be blank")
        if self.depth < 0:
            raise ValueError("depth must be >= 0")
        if self.delay_ms < 0:
            raise ValueError("delay must be >= 0")
        if self.max_hits < 0:
            raise ValueError("max hits must be >= 0")
        if self.max_pages is not None and self.max_pages <= 0:
            raise ValueError("max pages must be > 0")
        if self.max_bytes <= 0:
            raise ValueError("max bytes must be > 0")
        if self.timeout_ms <= 0:
            raise ValueError("timeout must be > 0")
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.output not in OUTPUTS:
            raise ValueError(f"output must be one of {OUTPUTS}")
