"""Models and samples that providers need: where a model lies, waiting for a service, the voice sample of a run."""

from __future__ import annotations

import os
import shutil
import subprocess
import time
from collections.abc import Callable
from pathlib import Path

#: Seconds to wait for a service that is putting its model away, and between two looks.
WAIT_SECONDS, LOOK_EVERY = 180.0, 2.0


def model_path(model: str, variable: str = "DOCSPARK_MODEL_PATH", hub: Path | None = None) -> str:
    """What the environment names, else the newest snapshot of ``owner/name`` in the hub's cache, else the id as it is."""
    named = os.environ.get(variable, "").strip()
    if named:
        return named
    hub = hub or Path.home() / ".cache" / "huggingface" / "hub"
    held = (hub / ("models--" + model.replace("/", "--")) / "snapshots").glob("*/")
    return str(max(held, key=lambda p: p.stat().st_mtime, default=model))


def is_local(path: str) -> bool:
    """Whether a model's path is one of this machine, and there; an id of a hub or a URL is not."""
    return path.startswith(("/", "~", ".")) and Path(path).expanduser().exists()


def wait_while(busy: Callable[[], bool], seconds: float = WAIT_SECONDS, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> None:
    """Return once ``busy`` is false; an error if it still is after so many seconds."""
    end = clock() + max(0.0, seconds)
    while busy():
        if clock() >= end:
            raise TimeoutError("the service is still putting its model away")
        sleep(LOOK_EVERY)


def listed(command: list[str], seconds: float = 10.0) -> list[list[str]] | None:
    """The rows that a tool lists below its heading, as words; none if it is missing or fails."""
    if not shutil.which(command[0]):
        return None
    try:
        done = subprocess.run(command, text=True, capture_output=True, timeout=seconds)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return [row.split() for row in done.stdout.splitlines()[1:] if row.strip()] if done.returncode == 0 else None


def to_wav(source: Path, target: Path, rate: int = 24_000) -> None:
    target.parent.mkdir(parents=True, exist_ok=True)
    subprocess.run(["ffmpeg", "-y", "-loglevel", "error", "-i", str(source), "-ac", "1", "-ar", str(rate), "-sample_fmt", "s16", str(target)], check=True)


def voice_sample(sample: str, root: Path | str, convert: Callable[[Path, Path], None] = to_wav) -> str:
    """The run's own copy of a voice sample, made once; without a sample nothing, and an error if there is no such file."""
    if not sample.strip():
        return ""
    source, target = Path(sample.strip()).expanduser(), Path(root) / "00_voice" / "voice_sample_24k.wav"
    if not source.exists():
        raise FileNotFoundError(f"no voice sample at {source}")
    if not target.exists():
        convert(source, target)
    return str(target)
