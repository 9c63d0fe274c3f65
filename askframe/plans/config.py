"""Configuration: defaults, a YAML file, ASKFRAME_* environment variables and overrides, each stronger than the one before."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, fields
from pathlib import Path
from typing import Any, get_type_hints


@dataclass
class Config:
    database_dir: str = "data"
    tables_path: str = ""
    train_path: str = ""
    dev_path: str = ""
    map_path: str = ""
    output_dir: str = "outputs"
    cache_dir: str = "cache"
    embedding_model: str = "hashed-ngrams"
    retrieval_top_k: int = 10
    retrieval_alpha: float = 1.0
    retrieval_beta: float = 0.0
    use_mmr: bool = False
    mmr_lambda: float = 0.7
    token_budget: int = 3000
    use_schema_linking: bool = True
    use_value_translation: bool = False
    max_cell_values: int = 50
    cell_value_fuzzy_threshold: float = 0.8
    sql_timeout_seconds: float = 5.0
    sql_max_rows: int = 1000
    repair_max_attempts: int = 3
    repair_empty_results: bool = True
    repair_max_values_per_column: int = 20
    repair_max_total_chars: int = 3000
    test_limit: int = 0
    llm_url: str = ""
    llm_model: str = ""
    llm_key: str = ""
    llm_max_tokens: int = 512
    llm_temperature: float = 0.0
    llm_timeout_seconds: float = 60.0
    llm_attempts: int = 3


_KINDS = get_type_hints(Config)


def _cast(name: str, value: Any) -> Any:
    kind = _KINDS[name]
    if kind is bool and isinstance(value, str):
        if value.strip().lower() not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
            raise ValueError(f"{name}: {value!r} is no truth value")
        return value.strip().lower() in ("1", "true", "yes", "on")
    return kind(value)


def load(path: str | None = None, **overrides: Any) -> Config:
    """The merged configuration; an unknown key is an error."""
    given: dict[str, Any] = {}
    if path:
        import yaml

        given |= yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    names = {f.name for f in fields(Config)}
    given |= {k.removeprefix("ASKFRAME_").lower(): v for k, v in os.environ.items() if k.startswith("ASKFRAME_")}
    given |= {k: v for k, v in overrides.items() if v is not None}
    if unknown := sorted(set(given) - names):
        raise KeyError(f"unknown settings: {', '.join(unknown)}")
    return Config(**{k: _cast(k, v) for k, v in given.items()})


def save(config: Config, path: str) -> None:
    import yaml

    Path(path).write_text(yaml.safe_dump(asdict(config), allow_unicode=True, sort_keys=True), encoding="utf-8")
