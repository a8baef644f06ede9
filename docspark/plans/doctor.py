"""Preflight: facts about the environment, the checks that a configuration asks for, and what is amiss."""

from __future__ import annotations

import importlib.util
import platform
import shutil
from collections.abc import Callable
from pathlib import Path
from typing import NamedTuple

from docspark.plans import models
from docspark.plans.settings import Settings, load_config

TOOLS = ("ffmpeg", "ffprobe", "git", "gh", "ollama")
MODULES = ("pyspark", "pyarrow", "pandas", "numpy")
SPEECH_MODEL = "microsoft/VibeVoice-1.5B"


class Check(NamedTuple):
    """A check that holds where ``applies``; ``passes`` is looked at only then."""

    name: str
    applies: bool
    passes: Callable[[], bool]
    good: str
    bad: str


def _installed(module: str) -> bool:
    return importlib.util.find_spec(module) is not None


def _facts(speech_model: str) -> dict:
    held = models.listed(["ollama", "list"])
    path = models.model_path(speech_model)
    return {
        "python": platform.python_version(), **{tool: bool(shutil.which(tool)) for tool in TOOLS}, "service_running": models.listed(["ollama", "ps"]) is not None,
        "service_models": [row[0] for row in held or []], "speech_model_path": path, "speech_model_local": models.is_local(path)}


def _checks(facts: dict, s: Settings | None, sample: str) -> list[Check]:
    always = [Check(t, True, lambda t=t: facts[t], f"{t} is available", f"{t} is needed for audio") for t in TOOLS[:2]]
    always += [Check(m, True, lambda m=m: _installed(m), f"{m} is installed", f"{m} is not installed") for m in MODULES]
    if s is None:
        return always
    src, tr, tts = s.source, s.translation, s.tts
    state = Path(src.storage_state).expanduser()
    state = state if state.is_absolute() or s.path is None else s.path.parent / state
    own_model, speaks = tr.enabled and tr.provider == "ollama", tts.enabled and tts.provider == "vibevoice"
    path = tts.model_path or facts["speech_model_path"]
    return always + [
        Check("browser", src.renderer in ("playwright", "browser"), lambda: _installed("playwright"), "the browser is installed", "the browser is not installed"),
        Check("browser_optional", src.renderer == "auto", lambda: True, "pages can be fetched without a browser", ""),
        Check("storage_state", bool(src.storage_state), state.exists, "the storage state is there", f"no storage state at {state}"),
        Check("trafilatura", src.extractor == "trafilatura", lambda: _installed("trafilatura"), "the extractor is installed", "the extractor is not installed"),
        Check("trafilatura_optional", src.extractor == "auto", lambda: True, "pages can be read without the extractor", ""),
        Check("translation_tool", own_model, lambda: facts["ollama"], "the translation tool is available", "the translation tool is not installed"),
        Check("translation_service", own_model, lambda: facts["service_running"], "the translation service runs", "the translation service does not run"),
        Check("translation_model", own_model, lambda: tr.model in facts["service_models"], f"the model {tr.model} is there", f"the model {tr.model} is not there"),
        Check("speech_package", speaks, lambda: _installed("vibevoice"), "the speech package is installed", "the speech package is not installed"),
        Check("speech_model", speaks, lambda: models.is_local(path), "the speech model is on this machine", "the speech model is not on this machine; the first run may fetch it"),
        Check("voice_sample", speaks, lambda: bool(sample) and Path(sample).expanduser().exists(), "the voice sample is there", f"no voice sample at {sample}" if sample else "no voice sample is named"),
    ]


def doctor_report(config_path: str | None = None, *, voice_sample: str = "", strict: bool = False) -> dict:
    """``ready`` if every check passes; ``ok`` if ready, or if it need not be (not ``strict``)."""
    settings = load_config(config_path) if config_path else None
    facts = _facts(SPEECH_MODEL)
    sample = (voice_sample or (settings.tts.voice_sample if settings else "")).strip()
    results = [(c, bool(c.passes())) for c in _checks(facts, settings, sample) if c.applies]
    issues = [{"check": c.name, "message": c.bad} for c, passed in results if not passed]
    return {
        **facts, "config_path": str(config_path or ""), "strict": bool(strict),
        "checks": {c.name: {"ok": passed, "message": c.good if passed else c.bad} for c, passed in results},
        "issues": issues, "ready": not issues, "ok": not issues or not strict}
