"""Files in, reports out."""

from __future__ import annotations

import json
import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from tallymark.operators import calibration, codescan, migrate, selfcheck
from tallymark.operators.audit import Audit
from tallymark.operators.maps import unique_names
from tallymark.operators.pricing import load_prices, model_prices, price_table, savings
from tallymark.operators.scoring import check_thresholds
from tallymark.plans import report
from tallymark.plans.cli import main
from tallymark.session import staged
from tallymark.sources.calls import read_all, read_calls, read_decisions


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows), encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    d = tmp_path_factory.mktemp("logs")
    lines(d / "a.jsonl", [
        {"model": "openai/gpt-4o", "messages": [{"role": "user", "content": [{"type": "text", "text": "Classify"}, "mail a@b.co"]}], "response": {"choices": [{"message": {"content": "spam"}}]}, "usage": {"prompt_tokens": 9.7, "completion_tokens": True}, "response_cost": 0.5, "timestamp": "2024-01-01"},
        "", "{bad", {"model": "gpt-4o", "messages": [], "response": "spam"}, [{"id": "x7", "model": "", "response": ["a", "b"]}, 3],
    ])
    lines(d / "b.ndjson", [{"id": "g1", "type": "generation", "model": "claude-sonnet-4", "input": "Is it fraud?", "output": "yes", "usage": {"input": 5, "output": 1}, "totalCost": 0.25}])
    (d / "c.csv").write_text("﻿Date, Model ,input_tokens,output_tokens,cost,request_count\n2024-01-02,gpt-4o,100,5,1.5,30\n2024-01-03,gpt-4o,x,5,,\n", encoding="utf-8")
    (d / "d.json").write_text(json.dumps({"data": [{"model": "m", "prompt": "Rate this", "output": "4", "n": 2, "ts": 5}]}), encoding="utf-8")
    return d


def test_litellm(spark, logs):
    calls, skipped = read_calls(spark, str(logs / "a.jsonl"))
    rows = calls.orderBy("ordinal").collect()
    assert skipped.first()[0] == 1 and len(rows) == 3
    a, b, c = rows
    assert (a["format"], a["source"], a["call_id"], a["model"]) == ("litellm", "a.jsonl#L1", "a.jsonl#L1", "openai/gpt-4o")
    assert (a["input_tokens"], a["output_tokens"], a["prompt_excerpt"], a["output_excerpt"]) == (9, None, "Classify\nmail a@b.co", "spam")
    assert (a["logged_cost_usd"], a["timestamp"], a["weight"]) == (0.5, "2024-01-01", 1)
    assert (b["source"], c["call_id"], c["model"], c["output_excerpt"]) == ("a.jsonl#L2", "x7", "unknown", "a\nb")


def test_other_formats(spark, logs):
    g = read_calls(spark, str(logs / "b.ndjson"))[0].first()
    assert (g["format"], g["call_id"], g["input_tokens"], g["output_tokens"], g["logged_cost_usd"], g["prompt_excerpt"]) == ("langfuse", "g1", 5, 1, 0.25, "Is it fraud?")
    c = read_calls(spark, str(logs / "c.csv"), "litellm")[0].orderBy("ordinal").collect()
    assert [(r["format"], r["model"], r["input_tokens"], r["logged_cost_usd"], r["weight"], r["timestamp"]) for r in c] == [("generic", "gpt-4o", 100, 1.5, 30, "2024-01-02"), ("generic", "gpt-4o", None, None, 1, "2024-01-03")]
    j = read_calls(spark, str(logs / "d.json"))[0].first()
    assert (j["prompt_excerpt"], j["output_excerpt"], j["weight"], j["timestamp"]) == ("Rate this", "4", 2, None)
    with pytest.raises(ValueError):
        read_calls(spark, "x.txt")
    with pytest.raises(FileNotFoundError):
        read_calls(spark, "missing.csv")


def test_audit_and_report(spark, logs):
    calls, skipped = read_all(spark, [str(logs)])
    audit = Audit(spark, staged(calls)).cache()
    t = audit.totals().first()
    assert t["total_calls"] == 3 + 1 + 31 + 2 and skipped.first()[0] == 1
    assert {r["verdict"]: r["calls"] for r in audit.by_verdict.collect()}["insufficient"] == 31
    md = report.audit_markdown(audit, 5)
    assert all(f"## {s}" in md for s in report.SECTIONS) and "a@b.co" not in md
    page = report.audit_html(audit)
    assert "<script src" not in page and "http" not in page and "a@b.co" not in page


def test_odd_records(spark, tmp_path):
    p = tmp_path / "one.json"
    p.write_text('{"model": "m", "prompt": ["Rate", {"content": "this"}], "completion": {"choices": [{"message": {"content": "4\u2028"}}]}}', encoding="utf-8")
    r = read_calls(spark, str(p))[0].first()
    assert (r["format"], r["prompt_excerpt"], r["output_excerpt"]) == ("generic", "Rate\nthis", "4")
    c = tmp_path / "u.csv"
    c.write_text("model,Cost,cost\nm,1,2\n", encoding="utf-8")
    assert read_calls(spark, str(c))[0].first()["logged_cost_usd"] == 2.0
    c.write_text("", encoding="utf-8")
    assert read_calls(spark, str(c))[0].count() == 0
    assert main(["audit", str(p), "no-such-file.csv"], spark) == 0


def test_prices(spark, tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps({"models": {"GPT-4": [9, 9], "gpt-4o-m": [1, 1]}}))
    prices = price_table(spark, load_prices(str(p)))
    models = spark.createDataFrame([("gpt-4o",), ("gpt-4-turbo",), ("gpt-4o-mini-x",), ("zzz",)], "model string")
    got = {r["model"]: (r["price_key"], r["in_rate"]) for r in model_prices(models, prices).collect()}
    assert got["gpt-4o"] == ("gpt-4o", 2.5) and got["gpt-4-turbo"] == ("gpt-4", 9.0) and got["gpt-4o-mini-x"] == ("gpt-4o-m", 1.0)
    assert got["zzz"][0] == "(table median)" and got["zzz"][1] == pytest.approx(1.55)
    p.write_text("[1]")
    with pytest.raises(ValueError):
        load_prices(str(p))
    with pytest.raises(ValueError):
        savings(F.lit(1.0), 0)
    with pytest.raises(ValueError):
        check_thresholds(0.3, 0.5)


def decisions(spark, rows):
    return spark.createDataFrame([(p, c, "m", q, i) for i, (p, c, q) in enumerate(rows)], "p double, correct boolean, model string, question string, ordinal bigint")


def test_calibration(spark):
    s = calibration.summary(decisions(spark, [(1.0, True, "a"), (0.0, False, "")])).first()
    assert (s["ece"], s["mce"], s["brier"], s["n"]) == (0.0, 0.0, 0.0, 2)
    assert calibration.summary(decisions(spark, [(0.8, True, "a"), (0.8, False, "a")])).first()["ece"] == pytest.approx(0.3)
    assert {r["question"] for r in calibration.groups(decisions(spark, [(1.0, True, "a"), (0.0, False, "")])).collect()} == {"a", "(unlabeled)"}
    bins = calibration.reliability_bins(decisions(spark, [(1.0, True, "a")])).collect()
    assert len(bins) == 10 and bins[9]["n"] == 1 and bins[0]["n"] == 0
    rng = random.Random(1)
    rows = [(rng.choice([0.5, 0.7, 0.9]), rng.random() < 0.7, "q") for _ in range(97)]
    order = sorted(range(97), key=lambda i: (-rows[i][0], i))
    hits, want = 0, []
    for k, i in enumerate(order, 1):
        hits += rows[i][1]
        want.append((k, hits / k, rows[i][0]))
    got = [(r["k"], r["sel_acc"], r["threshold"]) for r in calibration.risk_coverage(decisions(spark, rows)).orderBy("k").collect()]
    assert got == [pytest.approx(w) for w in want]
    assert calibration.summary(decisions(spark, rows[:0])).first()["ece"] == 0
    with pytest.raises(ValueError):
        calibration.check_bins(51)


def test_decision_reader(spark, tmp_path):
    p = lines(tmp_path / "d.jsonl", [{"prob": 0.9, "outcome": "hit"}, {"confidence": "0.4", "is_correct": 0, "question": "q"}, {"p": 1.5, "correct": True}, {"p": 0.5}, "nope", "", {"p": None, "prob": 0.5, "correct": True}])
    rows, skipped = read_decisions(spark, p)
    assert [(r["p"], r["correct"], r["question"]) for r in rows.orderBy("ordinal").collect()] == [(0.9, True, ""), (0.4, False, "q")]
    assert skipped.first()[0] == 4


CODE = '''import json
MODEL = "gpt-4o"
LABELS = ("a", "b")
def route(c, t):
    r = c.chat.completions.create(model=MODEL, messages=[{"role": "user", "content": "Classify this ticket"}])
    x = r.choices[0].message.content
    return x if x in LABELS else "b"
def story(c):
    return c.messages.create(model="claude-3", messages=[{"content": f"Write a story"}])
shell.completion(model="bash-5", word="git")
'''


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    d = tmp_path_factory.mktemp("code")
    (d / "sub").mkdir()
    (d / "node_modules").mkdir()
    (d / "sub/router.py").write_text(CODE)
    (d / "bad.py").write_text("def f(:\n")
    (d / "node_modules/x.js").write_text("messages.create({model: 'gpt-4o'})")
    (d / "i.ts").write_text('const a = 1;\nconst r = await c.chat.completions.create({ model: "gpt-4o", messages: [{ content: "Does this message look like spam?" }] });\nif (LIST.includes(r.choices[0].message.content)) {}\nfoo.complete = 1;\n')
    return d


def test_code_scan_and_migration(spark, tree, tmp_path):
    findings, stats = codescan.scan(spark, str(tree))
    assert stats.first().asDict() == {"files_scanned": 3, "errors": 1, "sites": 3, "decision_shaped": 2}
    got = {(r["path"], r["line"]): (r["verdict"], r["model"]) for r in findings.collect()}
    assert got[("sub/router.py", 5)] == ("likely", "gpt-4o") and got[("sub/router.py", 9)][0] == "unlikely" and got[("i.ts", 2)][0] == "likely"
    change = migrate.generate(spark, str(tree), str(tmp_path / "out"))
    assert change.sites == 2 and len(change.files) == 3
    subprocess.run(["git", "init", "-q"], cwd=tree, check=True)
    patch = os.path.join(change.folder, migrate.PATCH)
    assert migrate.apply_patch(patch, str(tree)) == (True, "")
    assert "TODO(migrate)" in (tree / "sub/router.py").read_text() and (tree / migrate.SKETCHES).is_file()
    assert not migrate.apply_patch(patch, str(tree))[0]


def test_self_check(spark):
    rows = spark.createDataFrame([("a", "", 0.9, "likely", 1.0, 1), ("b", "", 0.4, "maybe", 1.0, 2), ("c", "", 0.1, "unlikely", 0.5, 3), ("d", "", 0.1, "unlikely", 2.0, 4)], "origin string, prompt string, score double, verdict string, cost_usd double, ordinal bigint")
    assert [r["origin"] for r in selfcheck.opinions(rows, 3).collect()] == ["a", "b", "d"]
    rows = rows.filter("origin != 'd'")
    a = selfcheck.agreement(selfcheck.opinions(rows)).first()
    assert (a["n"], round(a["agreement"], 4), a["errors"], a["mock"]) == (3, 0.6667, 0, True)
    assert selfcheck.ask("q", ["yes", "no"], 0.1)["choice"] == "no"
    with pytest.raises(selfcheck.ClientError):
        selfcheck.ask("q", ["yes"], 0.1, "http://127.0.0.1:1/", timeout=1)


def test_names():
    assert unique_names([("Router", "you route"), ("Router", "you route"), ("Router", "you route"), ("Router", "you route")]) == ["Router", "RouterRoute", "RouterRoute2", "RouterRoute3"]


def test_command_line(spark, logs, tree, tmp_path):
    assert main(["audit", str(logs), "--self-check", "--markdown", str(tmp_path / "a.md"), "--html", str(tmp_path / "a.html"), "--rows", str(tmp_path / "rows")], spark) == 0
    assert (tmp_path / "a.md").exists() and spark.read.parquet(str(tmp_path / "rows")).count() == 7
    assert main(["audit", "no-such-file.csv"], spark) == 2
    assert main(["audit", str(logs), "--min-score", "0.2"], spark) == 2
    p = lines(tmp_path / "d.jsonl", [{"p": 0.9, "correct": True, "model": "m"}, {"p": 0.6, "correct": False}])
    assert main(["calibrate", p, "--baseline", p, "--markdown", str(tmp_path / "c.md"), "--html", str(tmp_path / "c.html")], spark) == 0
    assert "m (baseline)" in (tmp_path / "c.md").read_text() and "<svg" in (tmp_path / "c.html").read_text()
    assert main(["calibrate", p, "--bins", "1"], spark) == 2
    assert main(["scan-code", str(tree), str(tree / "sub")], spark) == 0
    assert main(["migrate", str(tree), "--out-dir", str(tmp_path / "m"), "--min-score", "0.99"], spark) == 1


def test_demo_with_code(spark, tree, tmp_path, capsys):
    out = [str(tmp_path / n) for n in ("a.md", "a.html")]
    assert main(["audit", "--demo", "--self-check", "--markdown", out[0], "--html", out[1]], spark) == 0
    said = capsys.readouterr().out
    assert "1 records skipped" in said and "sites 2, decision_shaped 1" in said and "self-check: 2 rows" in said
    for text in (open(p, encoding="utf-8").read() for p in out):
        assert all(x in text for x in [*report.SECTIONS, report.CODE, report.CHECK, "desk/route.py:4", "in-house-7b", "(table median)"])
    assert main(["audit", "--scan-code", str(tree)], spark) == 0
    (tmp_path / "none").mkdir()
    (tmp_path / "none/x.txt").write_text("no source")
    assert main(["audit", "--scan-code", str(tmp_path / "none")], spark) == 1


def test_parts_of_a_file(spark, tmp_path):
    p = lines(tmp_path / "long.jsonl", ["", *({"id": str(i), "model": "m", "prompt": "x" * 50} if i % 10 else "bad" for i in range(300))])
    want = [(f"long.jsonl#L{n}", str(i)) for n, i in enumerate((i for i in range(300) if i % 10), 1)]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for s in ("2000", size):
            spark.conf.set("spark.sql.files.maxPartitionBytes", s)
            calls, skipped = read_calls(spark, p)
            assert [(r["source"], r["call_id"]) for r in calls.orderBy("ordinal").collect()] == want and skipped.first()[0] == 30
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_ranks():
    for n in (1, 2, 3, 7, 10, 19, 20, 97, 1000):
        for level in calibration.LEVELS:
            assert calibration.rank_at(level, n) == next(k for k in range(1, n + 1) if k / n >= level - 1e-9)


def test_stream(spark, tmp_path):
    from tallymark.sources import tables
    from tallymark.streaming.scoring import scored_stream, verdicts_by_time

    calls = tables.calls_events(spark, "/root/testdata/sf0.001").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("ordinal")))
    calls.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    q = verdicts_by_time(scored_stream(stream)).writeStream.outputMode("complete").format("memory").queryName("verdicts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("verdicts").agg(F.sum("calls")).first()[0] == calls.agg(F.sum("weight")).first()[0]
