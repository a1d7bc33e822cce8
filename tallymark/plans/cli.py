"""Command line: audit, scan-code, calibrate, migrate. Exit codes: 0 done, 1 nothing usable, 2 wrong usage."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.signals import LIKELY, MAYBE
from tallymark.operators import calibration, codescan, migrate, selfcheck
from tallymark.operators.audit import Audit
from tallymark.operators.pricing import CONSERVATIVE, OPTIMISTIC, load_prices
from tallymark.operators.scoring import check_thresholds
from tallymark.plans import report
from tallymark.session import ship, staged
from tallymark.sources.calls import CALLS, expand, read_all, read_decisions
from tallymark.sources.demo import demo_calls, demo_sources


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallymark")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("audit")
    a.add_argument("paths", nargs="*")
    a.add_argument("--scan-code", action="append", default=[], help="a folder of sources to scan as well; may be given several times")
    a.add_argument("--demo", action="store_true", help="audit made-up logs and sources")
    a.add_argument("--format", choices=["litellm", "langfuse", "generic"])
    a.add_argument("--min-score", type=float, default=LIKELY)
    a.add_argument("--maybe-threshold", type=float, default=MAYBE)
    a.add_argument("--top", type=int, default=10)
    a.add_argument("--price-file")
    a.add_argument("--divisor", type=float, default=CONSERVATIVE)
    a.add_argument("--divisor-optimistic", type=float, default=OPTIMISTIC)
    a.add_argument("--no-redact", action="store_true")
    a.add_argument("--self-check", action="store_true")
    a.add_argument("--base-url", help="the service that the self-check asks; without it a stand-in answers")
    a.add_argument("--key-variable", help="the environment variable that holds the service's key")
    a.add_argument("--markdown")
    a.add_argument("--html")
    a.add_argument("--rows", help="folder to write the scored rows to, as Parquet")
    s = sub.add_parser("scan-code")
    s.add_argument("roots", nargs="+")
    c = sub.add_parser("calibrate")
    c.add_argument("path")
    c.add_argument("--baseline")
    c.add_argument("--bins", type=int, default=10)
    c.add_argument("--markdown")
    c.add_argument("--html")
    m = sub.add_parser("migrate")
    m.add_argument("root")
    m.add_argument("--out-dir", default="migration")
    m.add_argument("--min-score", type=float, default=0.60)
    m.add_argument("--apply", action="store_true")
    return p


def _write(path: str | None, text: str) -> None:
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


def _audit(spark: SparkSession, o: argparse.Namespace) -> int:
    check_thresholds(o.min_score, o.maybe_threshold)
    trees = {"demo": demo_sources(spark)} if o.demo else {r: codescan.read_tree(spark, r) for r in o.scan_code}
    scan = codescan.scan_roots(trees) if trees else None
    if o.demo:
        calls, skipped = demo_calls(spark)
    elif o.paths:
        calls, skipped = read_all(spark, o.paths, o.format)
    else:
        calls, skipped = spark.createDataFrame([], CALLS), None
    calls = staged(calls)
    if calls.isEmpty() and not (scan and scan[1]["sites"]):
        return 1
    audit = Audit(spark, calls, load_prices(o.price_file, spark) if o.price_file else None, o.min_score, o.maybe_threshold).cache()
    checked = None
    if o.self_check:  # of code sites if there are any, else of calls
        of_code = bool(scan and scan[1]["sites"])
        asked = selfcheck.of_sites(scan[0]) if of_code else selfcheck.of_calls(audit.rows)
        checked = staged(selfcheck.opinions(asked, base_url=o.base_url, token=os.environ.get(o.key_variable or "", ""), site="code site" if of_code else "log call"))
    _summary(audit, o, skipped.first()[0] if skipped else 0, scan[1] if scan else None, checked)
    _write(o.markdown, report.audit_markdown(audit, o.top, not o.no_redact, scan, checked) if o.markdown else "")
    _write(o.html, report.audit_html(audit, not o.no_redact, scan, checked) if o.html else "")
    if o.rows:
        audit.rows.write.mode("overwrite").parquet(o.rows)
    audit.release()
    return 0


def _summary(audit: Audit, o: argparse.Namespace, skipped: int, scanned: dict | None, checked: DataFrame | None) -> None:
    """What an audit found, in a few lines."""
    t = audit.totals().first()
    calls, spend = t["total_calls"], t["total_spend"]
    share = lambda x, of: f"{100 * x / of if of else 0:.1f}%"
    print(f"{calls:,} calls, {spend:,.2f} USD ({t['logged_calls']:,} with logged costs, {t['estimated_calls']:,} estimated), {skipped} records skipped")
    for r in audit.by_verdict.collect():
        print(f"  {r['verdict']}: {r['calls']:,} calls ({share(r['calls'], calls)}), {r['spend']:,.2f} USD")
    print(f"  could move: {t['migratable_spend']:,.2f} USD")
    for r in audit.savings(o.divisor, o.divisor_optimistic).collect():
        print(f"  {r['scenario']} (divisor {r['divisor']:g}): {r['saved']:,.2f} USD saved ({share(r['saved'], spend)})")
    if scanned:
        print("code: " + ", ".join(f"{k} {n:,}" for k, n in scanned.items()))
    if checked is not None:
        a = selfcheck.agreement(checked).first()
        print(f"self-check: {a['n']} rows, {a['agreement']:.0%} agreement, {a['errors']} without an answer, {'a stand-in' if a['mock'] else 'a service'} answered")


def _scan(spark: SparkSession, o: argparse.Namespace) -> int:
    findings, totals = codescan.scan_roots({r: codescan.read_tree(spark, r) for r in o.roots})
    print(", ".join(f"{k} {n:,}" for k, n in totals.items()))
    for r in findings.toLocalIterator():
        print(f"  {r['path']}:{r['line']} {r['verdict']} {r['score']:.2f} {r['api']}")
    return 0


def _calibrate(spark: SparkSession, o: argparse.Namespace) -> int:
    calibration.check_bins(o.bins)
    sets = {}
    for path in filter(None, (o.path, o.baseline)):
        decisions, skipped = read_decisions(spark, path)
        if decisions.isEmpty():
            return 1
        name = decisions.agg(F.min_by("model", "ordinal")).first()[0] or os.path.splitext(os.path.basename(path))[0]
        sets[name if name not in sets else f"{name} (baseline)"] = decisions
        print(name, calibration.summary(decisions, o.bins).first().asDict(), f"skipped {skipped.first()[0]}")
    _write(o.markdown, report.calibration_markdown(sets, o.bins) if o.markdown else "")
    _write(o.html, report.calibration_html(sets, o.bins) if o.html else "")
    return 0


def _migrate(spark: SparkSession, o: argparse.Namespace) -> int:
    change = migrate.generate(spark, o.root, o.out_dir, o.min_score)
    print(f"{change.sites} site(s), {change.maps} map(s): {', '.join(change.files)}")
    if not change.sites:
        return 1
    if o.apply:
        done, said = migrate.apply_patch(os.path.join(o.out_dir, migrate.PATCH), o.root)
        print("applied" if done else said)
        return 0 if done else 1
    return 0


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        o = _parser().parse_args(args)
    except SystemExit as e:
        return 2 if e.code else 0
    paths = {"audit": lambda: [*o.paths, *o.scan_code], "scan-code": lambda: o.roots, "calibrate": lambda: [o.path, *filter(None, [o.baseline])], "migrate": lambda: [o.root]}[o.command]()
    missing = [p for p in paths if "://" not in p and not os.path.exists(p)]
    demo = o.command == "audit" and o.demo
    if missing or not (paths or demo):
        print(f"no such path: {', '.join(missing) or 'none given'}", file=sys.stderr)
    there = [p for p in paths if p not in missing]
    if not (there or demo) or missing and o.command in ("calibrate", "migrate"):
        return 2
    if o.command == "audit":
        o.paths, o.scan_code = ([p for p in given if p in there] for given in (o.paths, o.scan_code))
        for p in (p for p in o.paths if not expand(p)):
            print(f"nothing to read in {p}", file=sys.stderr)
    elif o.command == "scan-code":
        o.roots = there
    spark = spark or SparkSession.builder.appName("tallymark").getOrCreate()
    try:
        return {"audit": _audit, "scan-code": _scan, "calibrate": _calibrate, "migrate": _migrate}[o.command](ship(spark), o)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
