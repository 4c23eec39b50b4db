"""Operators named in configurations."""

from __future__ import annotations

import importlib
import pathlib

from pyspark.sql import DataFrame


def load(module: str, name: str):
    return getattr(importlib.import_module(module), name)


def pipeline(df: DataFrame, spec: list[dict]) -> DataFrame:
    """Apply transforms in turn; each entry has ``module``, ``name`` and the transform's own arguments."""
    for step in spec:
        options = {k: v for k, v in step.items() if k not in ("module", "name")}
        df = df.transform(load(step["module"], step["name"]), **options)
    return df


def configuration(name: str, folder: str) -> dict:
    """A YAML file by its name, with or without suffix, in a folder or below it."""
    wanted = name if name.endswith((".yml", ".yaml")) else f"{name}.yml"
    found = sorted(pathlib.Path(folder).rglob(wanted))
    if not found:
        raise FileNotFoundError(f"no configuration {wanted} in {folder}")
    import yaml

    return yaml.safe_load(found[0].read_text())
