"""Reports of audits and calibrations, as Markdown and as self-contained HTML, from small aggregates."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.signals import WEIGHTS
from tallymark.functions.text import cell, redacted
from tallymark.operators import calibration, selfcheck
from tallymark.operators.audit import Audit

#: Names of the report's sections.
SECTIONS = ["Summary", "Verdict breakdown", "Signals observed", "Top migration candidates", "Suggested decision maps", "Costs and savings", "Privacy", "Disclaimers"]
#: Sections that a scan of source code and a self-check add.
CODE, CHECK = "Code call sites", "Self-check"
#: Candidates that the HTML page lists.
HTML_TOP = 50


@dataclass
class Section:
    """A part of a report: notes, then a table. Rows may be an iterator; ``bar`` is the column that HTML shows as a bar."""

    title: str
    notes: list[str] = field(default_factory=list)
    heads: list[str] = field(default_factory=list)
    rows: Iterable[list] = ()
    bar: int | None = None
    level: int = 2


def _money(x: float) -> str:
    return f"${x:,.2f}"


def _share(x: float, total: float) -> str:
    return f"{100 * x / total if total else 0:.1f}%"


def by_value(signals: Column) -> Column:
    """The signals above 0 as ``name value`` in one string, the largest first."""
    pairs = F.array(*(F.struct((-signals[n]).alias("v"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(WEIGHTS)))
    return F.array_join(F.transform(F.array_sort(F.filter(pairs, lambda p: p["v"] < 0)), lambda p: F.concat(p["n"], F.format_string(" %.2f", -p["v"]))), ", ")


def candidates(audit: Audit, n: int, redact: bool = True) -> list[dict]:
    """The n best rows, of them the likely ones, with their place and what speaks for them."""
    show = (lambda c: redacted(F.col(c))) if redact else F.col
    rows = audit.top(n).select("source", "model", "input_tokens", "output_tokens", "score", "cost_usd", "verdict", by_value(F.col("signals")).alias("why"), cell(show("prompt_excerpt"), 160).alias("prompt"), cell(show("output_excerpt"), 80).alias("output")).collect()
    return [{**r.asDict(), "place": place} for place, r in enumerate(rows, 1) if r["verdict"] == "likely"]


def site_rows(findings: DataFrame, redact: bool = True) -> Iterator[list]:
    """A table row for each finding of a code scan; they come in parts."""
    prompt = F.col("prompt_excerpt")
    shown = findings.withColumn("prompt", cell(redacted(prompt) if redact else prompt, 80))
    for r in shown.toLocalIterator():
        yield [f"{r['path']}:{r['line']}", r["language"], r["model"] or "?", r["api"], ", ".join(r["handling"]) or "none", f"{r['score']:.2f}", r["verdict"], r["prompt"]]


def check_section(opinions: DataFrame) -> Section:
    """What a second opinion said of each row it was asked about."""
    a, rows = selfcheck.agreement(opinions).first(), opinions.collect()  # at most as many as were asked about
    asked = "a stand-in that reads the score" if a["mock"] else "a service"
    note = f"Answers of {asked}: {a['agreement']:.0%} agreement over {a['n']} row(s), {a['errors']} without an answer."
    return Section(CHECK, [note], ["Place", "Verdict", "Answer", "p", "Agrees"], [[r["origin"], r["verdict"], r["choice"], f"{r['p']:.2f}", "yes" if r["agrees"] else "no"] for r in rows if r["choice"]])


def audit_sections(audit: Audit, top: int, redact: bool, scan: tuple[DataFrame, dict] | None, checked: DataFrame | None) -> Iterator[Section]:
    """The parts of an audit's report; all models and maps, and ``top`` candidates."""
    t, verdicts = audit.totals().first(), audit.by_verdict.collect()
    calls, spend = t["total_calls"], t["total_spend"]
    saved = [f"{r['scenario']} (divisor {r['divisor']:g}): {_money(r['saved'])} saved, {_share(r['saved'], spend)}" for r in audit.savings().collect()]
    yield Section("Summary", [f"{calls:,} calls, {_money(spend)}; {_money(t['migratable_spend'])} could move.", *saved])
    rows = [[r["verdict"], f"{r['calls']:,}", _share(r["calls"], calls), _money(r["spend"]), _share(r["spend"], spend)] for r in verdicts]
    yield Section("Verdict breakdown", [], ["Verdict", "Calls", "Share", "Spend", "Share of spend"], [*rows, ["total", f"{calls:,}", "100.0%", _money(spend), "100.0%"]], 2)
    rows = ([r["model"], f"{r['calls']:,}", _money(r["cost"]), _share(r["cost"], spend), f"{r['likely']:,}"] for r in audit.models_table().toLocalIterator())
    yield Section("By model", [], ["Model", "Calls", "Cost", "Share of cost", "Likely"], rows, 3, 3)
    repeats = ", ".join(f"{r['model']} {r['dup_rate']:.0%}" for r in audit.duplication().toLocalIterator())
    rows = [[r["signal"], f"{WEIGHTS[r['signal']]:.2f}", f"{r['calls']:,}", _share(r["calls"], calls)] for r in audit.signal_tally().collect()]
    yield Section("Signals observed", [f"Outputs that repeat, by model: {repeats or 'none'}."], ["Signal", "Weight", "Calls", "Share"], rows, 3)
    rows = [[c["place"], c["source"], c["model"], "/".join("?" if c[n] is None else str(c[n]) for n in ("input_tokens", "output_tokens")), _money(c["cost_usd"]), f"{c['score']:.2f}", c["prompt"], c["output"], c["why"]] for c in candidates(audit, top, redact)]
    yield Section("Top migration candidates", [], ["#", "Source", "Model", "In/out", "Cost", "Score", "Prompt", "Output", "Why"], rows)
    if scan is not None:
        findings, stats = scan
        note = f"{stats['files_scanned']:,} file(s) read, {stats['errors']:,} of them not parsed; {stats['sites']:,} call site(s), {stats['decision_shaped']:,} shaped like a decision."
        yield Section(CODE, [note], ["Place", "Language", "Model", "Call", "Handling", "Score", "Verdict", "Prompt"], site_rows(findings, redact))
    if checked is not None:
        yield check_section(checked)
    yield Section("Suggested decision maps", ["Sketches to adapt: one typed question for each cluster of likely calls."])
    example = redacted(F.col("example")) if redact else F.col("example")
    for m in audit.maps().withColumn("example", cell(example, 160)).toLocalIterator():
        answers = f"{m['range']['lo']:g} to {m['range']['hi']:g}" if m["range"] else ", ".join(m["options"]) if m["options"] else m["note"] or "none seen"
        yield Section(f"{m['role']}: {m['template']} ({m['calls']} calls)", [f"{m['kind']}, score {m['score_low']:.2f} to {m['score_high']:.2f}", f"e.g. {m['example']}", f"answers: {answers}"], level=3)
    yield Section("Costs and savings", [f"Costs are logged for {t['logged_calls']:,} calls and estimated for {t['estimated_calls']:,}, from tokens or a quarter of the characters. A saving is the spend less the spend divided by the divisor."])
    unknown = (list(r) for r in audit.unknown_models().toLocalIterator())
    yield Section("Models without a price", ["Models that no price fits, and what they are priced at."], ["Model", "Priced at"], unknown, level=3)
    yield Section("Privacy", ["Keys, addresses and credentials are masked in this report; nothing leaves the machine." if redact else "This report shows excerpts as they were logged."])
    yield Section("Disclaimers", ["Verdicts are heuristics. Try each change on live traffic before the switch."])


def _pipes(x: object) -> str:
    """A cell of a Markdown table; pipes that are marked already stay so."""
    return re.sub(r"(?<!\\)\|", r"\|", str(x)).replace("\n", " ")


def audit_markdown(audit: Audit, top: int = 10, redact: bool = True, scan: tuple[DataFrame, dict] | None = None, checked: DataFrame | None = None) -> str:
    """The audit report, with a code scan (findings, totals) and a self-check's opinions where they are given."""
    out = ["# Decision migration audit"]
    for s in audit_sections(audit, top, redact, scan, checked):
        out += ["", f"{'#' * s.level} {s.title}", "", *(f"- {n}" for n in s.notes)]
        if s.heads:
            out += ["", f"| {' | '.join(s.heads)} |", "|" + "---|" * len(s.heads)]
            out += [f"| {' | '.join(map(_pipes, r))} |" for r in s.rows]
    return "\n".join([*out, ""])


_STYLE = "body{font-family:sans-serif;max-width:70em;margin:2em auto}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left}.bar{background:#48c;height:.8em}"
#: Sorts a table by the column that is clicked, and shows the rows of the tables that hold what is typed.
_SCRIPT = "document.querySelectorAll('th').forEach(h=>h.onclick=()=>{const t=h.closest('table'),i=[...h.parentNode.children].indexOf(h),d=h.dataset.d=h.dataset.d==='1'?'-1':'1';[...t.tBodies[0].rows].sort((a,b)=>d*a.cells[i].innerText.localeCompare(b.cells[i].innerText,undefined,{numeric:true})).forEach(r=>t.tBodies[0].append(r))});const q=document.getElementById('q');if(q)q.oninput=()=>document.querySelectorAll('tbody tr').forEach(r=>r.hidden=!r.innerText.toLowerCase().includes(q.value.toLowerCase()))"


def _table(head: list[str], rows: Iterable[list], bar: int | None = None) -> str:
    def shown(i: int, x: object) -> str:
        return html.escape(str(x)) + (f"<div class='bar' style='width:{x}'></div>" if i == bar else "")

    cells = lambda tag, row: "".join(f"<{tag}>{shown(i, x) if tag == 'td' else html.escape(x)}</{tag}>" for i, x in enumerate(row))
    return f"<table><thead><tr>{cells('th', head)}</tr></thead><tbody>{''.join(f'<tr>{cells("td", r)}</tr>' for r in rows)}</tbody></table>"


def _page(title: str, body: str) -> str:
    return f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{_STYLE}</style></head><body><h1>{html.escape(title)}</h1>{body}<script>{_SCRIPT}</script></body></html>"


def audit_html(audit: Audit, redact: bool = True, scan: tuple[DataFrame, dict] | None = None, checked: DataFrame | None = None, top: int = HTML_TOP) -> str:
    """The same as one page without outside parts: bars, tables to sort and to filter."""
    body = "<input id='q' placeholder='filter'>"
    for s in audit_sections(audit, top, redact, scan, checked):
        body += f"<h{s.level}>{html.escape(s.title)}</h{s.level}>" + "".join(f"<p>{html.escape(n)}</p>" for n in s.notes)
        body += _table(s.heads, s.rows, s.bar) if s.heads else ""
    return _page("Decision migration audit", body)


#: Questions that a calibration report lists, those of most decisions.
QUESTIONS = 100


def _calibration_rows(decisions: DataFrame, bins: int, questions: int) -> tuple:
    return calibration.summary(decisions, bins).first(), calibration.reliability_bins(decisions, bins).collect(), calibration.coverage_table(decisions).collect(), calibration.groups(decisions, bins).limit(questions).collect()


def calibration_markdown(sets: dict[str, DataFrame], bins: int = 10, questions: int = QUESTIONS) -> str:
    """Calibration of one set of decisions, or of several side by side."""
    found = {n: _calibration_rows(d, bins, questions) for n, d in sets.items()}
    out = ["# Decision-model calibration report", "", "## Headline metrics", "", "| Set | N | Accuracy | Confidence | ECE | MCE | Brier |", "|---|---:|---:|---:|---:|---:|---:|"]
    out += [f"| {n} | {s['n']} | {s['accuracy']:.3f} | {s['avg_p']:.3f} | {s['ece']:.3f} | {s['mce']:.3f} | {s['brier']:.3f} |" for n, (s, *_) in found.items()]
    for n, (_, b, _, _) in found.items():
        out += ["", f"## Reliability: {n}", "", "| Bin | N | Confidence | Accuracy | Gap |", "|---|---:|---:|---:|---:|"]
        out += [f"| {r['lo']:.2f} to {r['hi']:.2f} | {r['n']} | {r['conf']:.3f} | {r['acc']:.3f} | {r['gap']:+.3f} |" for r in b]
    out += ["", "## Risk and coverage", "", f"| Coverage | {' | '.join(found)} |", "|---:|" + "---:|" * len(found)]
    shown = lambda x: "-" if x is None else f"{x:.3f}"
    out += [f"| {level:.0%} | {' | '.join(shown(c[i]['sel_acc']) for _, _, c, _ in found.values())} |" for i, level in enumerate(calibration.LEVELS)]
    for n, (_, _, _, g) in found.items():
        out += ["", f"## Per question: {n}", "", "| Question | N | Accuracy | ECE | Confidence |", "|---|---:|---:|---:|---:|"]
        out += [f"| {r['question']} | {r['n']} | {r['accuracy']:.3f} | {r['ece']:.3f} | {r['avg_p']:.3f} |" for r in g]
    return "\n".join([*out, "", "## Method", "", f"{bins} bins of equal width; decisions sorted by stated probability.", ""])


def _svg(points: list[tuple[float, float]], diagonal: bool) -> str:
    line = " ".join(f"{300 * x:.1f},{300 - 300 * y:.1f}" for x, y in points)
    return f"<svg width='300' height='300' style='border:1px solid #ccc'>{'<line x1=0 y1=300 x2=300 y2=0 stroke=#bbb />' if diagonal else ''}<polyline points='{line}' fill='none' stroke='#48c'/></svg>"


def calibration_html(sets: dict[str, DataFrame], bins: int = 10, questions: int = QUESTIONS) -> str:
    """The calibration as one page with a reliability diagram and a risk-coverage curve for each set."""
    body = ""
    for n, d in sets.items():
        s, b, c, g = _calibration_rows(d, bins, questions)
        curve = [(r["coverage"], r["sel_acc"]) for r in calibration.thinned(d).collect()]
        body += f"<h2>{html.escape(n)}</h2><p>N {s['n']}, accuracy {s['accuracy']:.3f}, ECE {s['ece']:.3f}, MCE {s['mce']:.3f}, Brier {s['brier']:.3f}</p>"
        body += _svg([(r["conf"], r["acc"]) for r in b if r["n"]], True) + _svg(curve, False)
        body += _table(["Question", "N", "Accuracy", "ECE"], [[r["question"], r["n"], f"{r['accuracy']:.3f}", f"{r['ece']:.3f}"] for r in g])
    return _page("Decision-model calibration report", body)
