"""Settings from the environment or a file of NAME=value lines."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Where the store, the documents and the models lie, and from where models come.

    INKWELL_STORE and so on in the environment come before the file, and both before the defaults.
    Relative local paths are below `root`; paths with a scheme stay as they are.
    """

    store: str = "store"
    documents: str = "data"
    embedding_model: str = "models/embedding"
    pair_model: str = "models/pairs"
    model_source: str = ""

    @classmethod
    def load(cls, root: str = ".", file: str | None = None, environment: Mapping[str, str] | None = None) -> Settings:
        environment = os.environ if environment is None else environment
        at = Path(file) if file else Path(root) / ".env"
        lines = at.read_text(encoding="utf-8").splitlines() if at.is_file() else []
        said = dict(x.strip().split("=", 1) for x in lines if "=" in x and not x.lstrip().startswith("#"))
        found = {}
        for f in fields(cls):
            name = f"INKWELL_{f.name.upper()}"
            value = environment.get(name, said.get(name, f.default)).strip().strip("\"'")
            local = f.name != "model_source" and "://" not in value
            found[f.name] = str((Path(root) / value).resolve()) if local else value
        return cls(**found)
