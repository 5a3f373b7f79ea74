"""Where the public vocabulary files are; their path is a parameter, they are never copied."""

from __future__ import annotations

import base64


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    """The expression that splits text into pre-tokens, as the vocabulary's package states it."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
