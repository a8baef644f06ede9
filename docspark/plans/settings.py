"""Configuration: defaults as data, coercion by the type of the default. Driver-side only."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path
from types import SimpleNamespace
from typing import Any

# Sections, keys and defaults of the configuration file.
DEFAULTS: dict[str, dict[str, Any]] = {
    "project": {"name": "docspark", "output_dir": "output/docspark"},
    "source": {
        "urls": [], "url_file": "", "sitemap_urls": [], "local_files": [], "renderer": "static", "extractor": "basic", "wait_until": "networkidle",
        "content_selector": "", "title_selector": "", "remove_selectors": [], "max_scrolls": 0, "headers": {}, "storage_state": "",
        "request_delay_seconds": 0.0, "timeout_seconds": 30, "user_agent": "docspark/0.1",
    },
    "crawl": {"start_urls": [], "max_pages": 0, "same_domain": True, "include_patterns": [], "exclude_patterns": []},
    "translation": {
        "enabled": True, "provider": "ollama", "model": "gemma4:31b", "target_language": "zh", "chunk_chars": 2800, "timeout_seconds": 900, "retries": 2,
    },
    "tts": {
        "enabled": True, "provider": "vibevoice", "model_path": "", "device": "mps", "voice_sample": "", "isolate_process": True, "inference_steps": 5,
        "cfg_scale": 1.5, "max_new_tokens": 220, "max_length_times": 1.2, "timeout_seconds": 1800, "retries": 2, "target_chars": 80, "max_chars": 120,
        "sample_audio_leak_policy": "trim", "sample_audio_leak_corr_threshold": 0.88, "sample_text_leak_policy": "off", "sample_text_leak_phrases": "",
    },
    "output": {"naming": "official-title", "audio_format": "m4a", "bitrate": "128k", "keep_wav": False},
}
_PLAIN_LISTS = ("urls", "local_files")


def as_list(value: Any) -> list:
    if value is None or value == "":
        return []
    return list(value) if isinstance(value, (list, tuple)) else [value]


def _coerce(key: str, value: Any, default: Any) -> Any:
    """A missing or empty value is the default, except that a flag is only replaced where it is missing."""
    if isinstance(default, bool):
        return default if value is _MISSING else bool(value)
    if isinstance(default, list):
        items = as_list(None if value is _MISSING else value)
        return items if key in _PLAIN_LISTS else [str(x) for x in items]
    if isinstance(default, dict):
        return {str(k): str(v) for k, v in value.items()} if isinstance(value, dict) else {}
    return type(default)(default if value is _MISSING or not value else value)


_MISSING = object()


@dataclass(frozen=True)
class Settings:
    project: SimpleNamespace
    source: SimpleNamespace
    translation: SimpleNamespace
    tts: SimpleNamespace
    output: SimpleNamespace
    path: Path | None = None


def from_mapping(raw: dict[str, Any], path: Path | None = None) -> Settings:
    def section(name: str, data: Any) -> SimpleNamespace:
        data = data if isinstance(data, dict) else {}
        return SimpleNamespace(**{k: _coerce(k, data.get(k, _MISSING), d) for k, d in DEFAULTS[name].items()})

    parts = {name: section(name, raw.get(name) or {}) for name in ("project", "source", "translation", "tts", "output")}
    parts["source"].crawl = section("crawl", (raw.get("source") or {}).get("crawl") or {})
    return Settings(**parts, path=path)


def load_config(path: Path | str) -> Settings:
    """Read a JSON or YAML file that holds a mapping."""
    path = Path(path)
    text = path.read_text(encoding="utf-8")
    if path.suffix.lower() == ".json":
        data = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("reading YAML needs PyYAML") from error
        data = yaml.safe_load(text)
    if not isinstance(data, dict):
        raise ValueError("the configuration must be a mapping")
    return from_mapping(data, path)


def resolve_path(value: str, settings: Settings) -> Path:
    """As given if absolute or there, else beside the configuration if there, else as given."""
    path = Path(value).expanduser()
    if path.is_absolute() or path.exists() or settings.path is None:
        return path
    beside = settings.path.parent / path
    return beside if beside.exists() else path


STARTER = """project:
  name: {name}
  output_dir: {out}

source:
  renderer: static
  urls:
    - url: {url}
      title: {title}
      section: "1. Articles"
      order: 1

translation:
  enabled: true
  target_language: zh

tts:
  enabled: true

output:
  audio_format: m4a
"""
