"""Settings from a YAML file and the environment."""

from __future__ import annotations

import os
from pathlib import Path


def load_env(path: str | Path = ".env") -> None:
    """KEY=value lines into the environment; what is set there already, and empty values, are left alone."""
    p = Path(path)
    for line in p.read_text().splitlines() if p.exists() else ():
        name, sep, value = line.partition("=")
        value = value.strip().strip("'\"")
        if sep and value and not line.lstrip().startswith("#"):
            os.environ.setdefault(name.strip(), value)


def load_config(path: str | Path | None = None) -> dict:
    """The settings of path, or of $BOARDLENS_CONFIG, or of config.yaml; `data_dir` may be set by $BOARDLENS_DATA; it, `work_dir` and `output_dir` are relative to the file."""
    import yaml

    at = Path(path or os.environ.get("BOARDLENS_CONFIG", "config.yaml")).resolve()
    cfg = yaml.safe_load(at.read_text()) or {}
    data = Path(os.environ.get("BOARDLENS_DATA", cfg.get("data_dir", "data")))
    cfg["data_dir"] = str(data if data.is_absolute() else at.parent / data)
    for key in ("work_dir", "output_dir"):
        if key in cfg:
            cfg[key] = str(at.parent / cfg[key])
    return cfg


def path_in(cfg: dict, key: str, *parts: str) -> Path:
    """A path under the folder that key names, work_dir or output_dir, whose parents are there."""
    p = Path(cfg[key], *parts)
    p.parent.mkdir(parents=True, exist_ok=True)
    return p


def model_path(cfg: dict, labels: str, code: str) -> Path:
    """Where a text model is kept: one for all codes with weak or pooled labels, one per code with labels of its own."""
    return path_in(cfg, "work_dir", "models", labels if labels in ("weak", "pooled") else f"{labels}_{code}")


def target_suffix(target: str) -> str:
    """What file names of results end with, so that those of one target don't overwrite another's: close_to_close has none."""
    return "" if target == "close_to_close" else "_oc"
