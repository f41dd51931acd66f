"""Command line: audit, poison, drift, fix, checks, fixes. Exit codes: 0 fine, 1 findings, 2 wrong use, 3 an error."""

from __future__ import annotations

import argparse
import sys

from plumbline.model import ROLE_NAMES, SEVERITIES
from plumbline.session import get_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plumbline")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("audit", "poison", "drift", "domain", "fix"):
        p = sub.add_parser(name)
        p.add_argument("path")
        for role in ROLE_NAMES:
            p.add_argument(f"--{role.replace('_', '-')}-col", dest=f"role_{role}")
        p.add_argument("--profile")
        p.add_argument("--row-id")
        p.add_argument("--seed", type=int, default=42)
        if name == "fix":
            p.add_argument("--apply", action="append", required=True)
            p.add_argument("--out", required=True)
        else:
            p.add_argument("--checks", action="append")
            p.add_argument("--out")
            p.add_argument("--fail-on", choices=SEVERITIES)
        if name == "audit":
            p.add_argument("--shortcut-threshold", type=float)
            p.add_argument("--time-format")
        if name == "drift":
            p.add_argument("--reference", required=True)
            p.add_argument("--psi-threshold", type=float)
        if name == "poison":
            p.add_argument("--top", type=int, default=20)
            p.add_argument("--min-detectors", type=int, default=2)
    sub.add_parser("checks")
    sub.add_parser("fixes")
    sub.add_parser("version")
    return top


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as stop:
        return 0 if stop.code == 0 else 2
    from plumbline import __version__
    from plumbline.plans import audit, checks, fixes
    from plumbline.sources.readers import load, quarantine_path, write_table

    if args.command == "version":
        print(__version__)
        return 0
    if args.command == "checks":
        print("\n".join(f"{c.module}\t{c.id}" for c in checks.all_checks()))
        return 0
    if args.command == "fixes":
        print("\n".join(fixes.available_fixes()))
        return 0
    roles = {r: v for r in ROLE_NAMES if (v := getattr(args, f"role_{r}"))}
    options = {k: v for k in ("shortcut_threshold", "time_format", "psi_threshold", "row_id") if (v := getattr(args, k, None)) is not None}
    try:
        data = load(get_session(), args.path, roles=roles, profile=args.profile, seed=args.seed, reference=getattr(args, "reference", None), **options)
        if args.command == "fix":
            if args.out == args.path:
                raise ValueError("the result must not overwrite its source")
            done = 0
            for name in args.apply:
                try:
                    result = fixes.apply_fix(data, name, args.row_id)
                except fixes.FixNotApplicable as why:
                    print(f"{name}: {why}")
                    continue
                done, data = done + 1, result.dataset
                if result.quarantine is not None:
                    write_table(result.quarantine, quarantine_path(args.out))
            if not done:
                print("nothing was applied", file=sys.stderr)
                return 2
            write_table(data.df, args.out)
            return 0
        module = {"audit": "auditor"}.get(args.command, args.command)
        report = audit.run_audit(data, args.checks or "all", module)
        print(report.to_json())
        if args.out:
            audit.write_report(report, args.out)
        if args.command == "poison" and (ranked := audit.suspects(report, args.top, args.min_detectors)) is not None:
            ranked.show(args.top, truncate=False)
        if report.errors:
            return 3
        return int(bool(args.fail_on) and report.exceeds(args.fail_on))
    except (ValueError, KeyError, FileNotFoundError) as wrong:
        print(wrong, file=sys.stderr)
        return 2
    except Exception as error:  # noqa: BLE001  the exit code tells callers that the run itself failed
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
