"""Where the public tokenizer files are; they are read, never copied."""

from __future__ import annotations

from pathlib import Path


def byte_bpe(path: str | None = None) -> tuple[str, str]:
    """JSON text of the byte-level vocabulary and its word pattern; the driver reads the file once."""
    import public_tokenizers

    return Path(path or public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8"), public_tokenizers.PATTERN
