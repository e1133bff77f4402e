"""Settings: a TOML file or the environment, and the folders of a project."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    """What an engine needs to know. Unknown settings in a file are ignored.

    ``data_dir`` is a folder all executors reach; the default is for one machine. ``stand_ins`` lets consolidation run with an embedder that doesn't
    tell texts apart (mock, local): it merges by similarity, so only tests want that.
    """

    project: str = "default"
    data_dir: str = "~/.mnestra"
    reasoning_provider: str = "none"
    reasoning_model: str = ""
    embedding_provider: str = "local"
    embedding_model: str = ""
    embedding_dim: int = 768
    merge_similarity: float = 0.92
    link_updates: bool = False
    stand_ins: bool = False

    @property
    def project_dir(self) -> str:
        return f"{os.path.expanduser(self.data_dir)}/projects/{self.project}"


def load(project: str | None = None, directory: str = ".", environ: dict[str, str] | None = None) -> Config:
    """``<directory>/.mnestra/config.toml`` if it exists, else ``MNESTRA_<SETTING>`` variables; ``project`` goes before both."""
    env = os.environ if environ is None else environ
    file = Path(directory) / ".mnestra" / "config.toml"
    given = tomllib.loads(file.read_text()) if file.exists() else {f.name: env[f"MNESTRA_{f.name.upper()}"] for f in fields(Config) if f"MNESTRA_{f.name.upper()}" in env}
    flat = {k: v for part in (given, *(x for x in given.values() if isinstance(x, dict))) for k, v in part.items() if not isinstance(v, dict)}
    kinds = {"str": str, "int": int, "float": float, "bool": lambda x: x if isinstance(x, bool) else str(x).lower() in ("1", "true", "yes")}
    own = {f.name: kinds[f.type](flat[f.name]) for f in fields(Config) if f.name in flat}
    return Config(**own | ({"project": project} if project else {}))
