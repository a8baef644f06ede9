"""``python -m docspark.plans.cli run | status | doctor | init-config``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from docspark.plans.settings import STARTER, load_config


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("docspark").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="docspark")
    verbs = top.add_subparsers(dest="verb", required=True)
    run = verbs.add_parser("run")
    run.add_argument("--config", required=True)
    for flag in ("--voice-sample", "--output-dir"):
        run.add_argument(flag, default="")
    run.add_argument("--force", action="store_true")
    run.add_argument("--dry-run", action="store_true")
    run.add_argument("--from-phase", default="source")
    run.add_argument("--to-phase", default="package")
    doctor = verbs.add_parser("doctor")
    doctor.add_argument("--config")
    doctor.add_argument("--voice-sample", default="")
    doctor.add_argument("--strict", action="store_true")
    status = verbs.add_parser("status")
    status.add_argument("--output-dir", required=True)
    status.add_argument("--expect-audio", action="store_true")
    init = verbs.add_parser("init-config")
    init.add_argument("--output", required=True)
    init.add_argument("--name", default="my-resource")
    init.add_argument("--url", default="https://example.com/article")
    init.add_argument("--title", default="")
    args = top.parse_args(argv)
    say = lambda x: print(json.dumps(x, ensure_ascii=False, indent=2, default=str))
    if args.verb == "doctor":
        from docspark.plans.doctor import doctor_report

        report = doctor_report(args.config, voice_sample=args.voice_sample, strict=args.strict)
        say(report)
        return 0 if report["ok"] else 1
    if args.verb == "init-config":
        path = Path(args.output)
        if path.exists():
            raise SystemExit(f"there is already a file at {path}")
        path.parent.mkdir(parents=True, exist_ok=True)
        quote = lambda s: json.dumps(s, ensure_ascii=False)
        name = "-".join(args.name.lower().split()) or "my-resource"
        path.write_text(STARTER.format(name=quote(args.name), out=quote(f"output/{name}"), url=quote(args.url), title=quote(args.title)), encoding="utf-8")
        return 0
    if args.verb == "status":
        from docspark.plans.status import inspect_run

        report = inspect_run(_session(), args.output_dir, args.expect_audio)
        say(report)
        return 0 if report["ok"] else 1
    from docspark.plans.pipeline import run_pipeline

    settings = load_config(args.config)
    if args.output_dir:
        settings.project.output_dir = args.output_dir
    if args.voice_sample:
        settings.tts.voice_sample = args.voice_sample
    if args.dry_run:
        settings.translation.enabled = settings.tts.enabled = False
    if settings.tts.enabled and settings.tts.provider == "vibevoice":
        from docspark.plans.models import voice_sample

        settings.tts.voice_sample = voice_sample(settings.tts.voice_sample, settings.project.output_dir)
    manifest = run_pipeline(_session(), settings, force=args.force, from_phase=args.from_phase, to_phase=args.to_phase)
    say({"manifest": str(Path(settings.project.output_dir) / "manifest.json"), "summary": manifest["summary"]})
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
