"""Defaults of all jobs, and the character classes that decide white space and CJK text."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    chunk_chars: int = 3000
    max_chunks: int = 40
    max_file_mb: float = 50
    max_output_chars: int = 8000
    max_pages: int = 1000
    expansion_count: int = 6
    expand_queries: bool = False
    refresh_seconds: int = 15
    case_insensitive: bool = False
    prompt_version: str = "1"

    def refresh_interval(self) -> int:
        """Seconds between refreshes, one at least."""
        return max(1, self.refresh_seconds)


# White space as scripts trim it, and the CJK ranges of the tokeniser, as regular expression classes.
WS = r"[ \t-\r\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CJK = r"[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
WS_CHARS = " \t\n\x0b\x0c\r ﻿ " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
