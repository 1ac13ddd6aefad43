"""Driver-side options: presets, shell words."""

from __future__ import annotations

import shlex

#: Options a preset fills in where none is given (fixed values).
PRESETS = {
    "blog": {"format": "markdown", "no_warnings": True, "no_paths": True, "no_metadata": True, "frontmatter": "mdx"},
    "review": {"format": "markdown", "no_warnings": False, "no_paths": False, "no_metadata": False},
    "debug": {"format": "markdown", "no_warnings": False, "no_paths": False, "no_metadata": False, "explain": True},
    "llm": {"format": "plain", "no_warnings": True, "no_paths": False, "no_metadata": True, "plain_file_contents": True},
}


def with_preset(options: dict, name: str) -> dict:
    """options, and the preset's values for what they leave out."""
    if name and name not in PRESETS:
        raise ValueError(f"unknown preset: {name!r}")
    return PRESETS.get(name, {}) | {k: v for k, v in options.items() if v is not None}


def strand_source(text: str) -> list[str]:
    """Words of a strand's source, quotes kept together."""
    return shlex.split(text)
