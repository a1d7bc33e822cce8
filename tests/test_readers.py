"""Readers against Python's own json and csv modules: odd lines, lists and quoted rows in parts of a few bytes, many files."""

from __future__ import annotations

import csv
import io
import json
import random

import pytest

from tallymark.sources.calls import number, read_all, read_calls, read_decisions
from tallymark.sources.parts import list_elements, quoted_rows


@pytest.fixture
def small_parts(spark):
    """Tasks read so few bytes that files fall into many parts."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set(name, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def expected(text):
    """(records, skipped) of a file's text."""
    text = text.removeprefix("﻿")
    bare = text.lstrip()
    if bare.startswith("[") or bare.startswith("{") and "\n" not in bare.rstrip("\n"):
        try:
            v = json.loads(text)
        except ValueError:
            v = None
        if isinstance(v, dict):
            v = v["data"] if isinstance(v.get("data"), list) else [v]
        if isinstance(v, list):
            return [r for r in v if isinstance(r, dict)], 0
    out, skipped = [], 0
    for line in filter(None, map(str.strip, text.splitlines())):
        try:
            v = json.loads(line)
        except ValueError:
            skipped += 1
            continue
        out += [r for r in (v if isinstance(v, list) else [v]) if isinstance(r, dict)]
    return out, skipped


FILES = {
    "list_first.jsonl": '[{"model":"a"}]\n{"model":"b"}\n{"model":"c"}\n',
    "trailing.jsonl": '{"model":"a"} junk\n{"model":"b"}{"model":"c"}\n{"model":"d"}\n[{"model":"e"}] x\n',
    "repeated.jsonl": '{"model":"a","model":"b"}\n{"model":"c","usage":{"prompt_tokens":1,"prompt_tokens":2}}\n{"model":"d","n":NaN}\n{"model":"e","cost":-Infinity,"x":"NaN \\" NaN"}\n[{"model":"f","model":"g","n":NaN},{"model":"h"}]\n',
    "pretty.json": '{\n  "model": "a"\n}\n',
    "one.json": '{"data": [{"model": "a"}, 3, {"model": "b"}], "model": "c"}',
    "data_lines.jsonl": '{"data": [{"model": "a"}], "model": "x"}\n{"model": "y"}\n',
    "separators.json": '{"model": "a b"}',
    "scalars.jsonl": '{"model":"a"}\n5\n"x"\nnull\n\x0b\n{"model":"b"}\x0b{"model":"c"}\n',
    "bom.jsonl": '﻿{"model":"a"}\n{"model":"b"}\n',
    "list.json": ' [\n 1, "x}", {"model": "a", "t": "]}{[\\"}"},\n[{"model": "no"}], {"model": "b", "u": {"v": {}}}, {"model":"c"} , 7 ]\n',
    "open_list.json": '[{"model": "a"}, {"model": "b"}\n',
    "comma.json": '[{"model": "a"},]\n',
    "two_lists.json": '[{"model": "a"}]\n[{"model": "b"}, {"model": "c"}]\n',
    "empty_list.json": "[]",
    "empty.jsonl": "",
}


@pytest.mark.parametrize("parts", ["whole", "small"])
def test_json_files(spark, tmp_path, parts, request):
    if parts == "small":
        request.getfixturevalue("small_parts")
    for name, text in FILES.items():
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    calls, skipped = read_all(spark, [str(tmp_path / n) for n in FILES])
    got = {}
    for r in calls.orderBy("ordinal").collect():
        got.setdefault(r["source"].rpartition("#")[0], []).append(r["model"])
    want = {n: expected(t) for n, t in FILES.items()}
    assert got == {n: [r["model"] for r in w[0]] for n, w in want.items() if w[0]}
    assert skipped.first()[0] == sum(w[1] for w in want.values())


def test_fields_of_odd_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"model":"m","input_tokens":"1d","output_tokens":"1_000","cost":"1f","n":"2_0"}\n{"model":"m","input_tokens":" 7 ","output_tokens":"1__0","cost":NaN,"usage":{"input_tokens":1,"input_tokens":4}}\n{"name":5,"usage":{"prompt":3,"prompt":4},"amount":"+1.5e1"}\n')
    a, b, c = read_calls(spark, str(tmp_path / "a.jsonl"))[0].orderBy("ordinal").collect()
    assert (a["input_tokens"], a["output_tokens"], a["logged_cost_usd"], a["weight"]) == (None, 1000, None, 20)
    assert (b["input_tokens"], b["output_tokens"], str(b["logged_cost_usd"]), b["weight"]) == (7, None, "nan", 1)
    assert (c["model"], c["input_tokens"], c["logged_cost_usd"]) == ("5", 4, 15.0)


def test_numbers(spark):
    texts = ["1", "1_000", "1__0", "_1", "1_", "1d", "1F", "0x1", " 2.5 ", "+.5", "5.", ".", "", "1e5", "1e", "1_0e1_0", "nan", "-INF", "Infinity", "infinit", "1 2", "--1"]

    def of(t):
        try:
            return repr(float(t))
        except ValueError:
            return None

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", number(rows_col("t")).alias("x")).collect()
    assert {r["t"]: None if r["x"] is None else repr(r["x"]) for r in rows} == {t: of(t) for t in texts}


def rows_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_decisions_are_strict(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"p":0.5,"correct":true} x\n{"p":0.1,"p":0.9,"correct":1}\n{"p":NaN,"correct":1}\n[{"p":0.5,"correct":1}]\n{"p":"1d","correct":1}\n{"p":"0.2_5","hit":"Yes","extra":NaN}\n')
    rows, skipped = read_decisions(spark, str(tmp_path / "d.jsonl"))
    assert [(r["p"], r["model"]) for r in rows.orderBy("ordinal").collect()] == [(0.9, "unknown"), (0.25, "unknown")] and skipped.first()[0] == 4


def test_long_list_in_parts(spark, tmp_path, small_parts):
    """A list in one line, read by many tasks, gives what one parser gives."""
    rng = random.Random(7)

    def value(depth=0):
        k = rng.randrange(6 if depth < 3 else 4)
        return {"x": value(depth + 1)} if k == 4 else [value(depth + 1), {"y": 1}] if k == 5 else [rng.randrange(9), 'a "q" \\ }{][', None, "é}"][k]

    rows = [{"id": str(i), "model": f"m{i}", "prompt": "}{" * rng.randrange(4), "v": value()} if rng.random() < 0.8 else value() for i in range(300)]
    path = tmp_path / "long.json"
    path.write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    assert list_elements(spark, [str(path)]).select("block").distinct().count() > 20
    calls, skipped = read_calls(spark, str(path))
    want = [r for r in rows if isinstance(r, dict)]
    got = calls.orderBy("ordinal").collect()
    assert [r["model"] for r in got] == [str(r.get("model", "unknown")) for r in want] and skipped.first()[0] == 0
    assert [r["source"] for r in got[:2]] == ["long.json#L1", "long.json#L2"]


def test_quoted_rows_in_parts(spark, tmp_path, small_parts):
    rng = random.Random(9)
    words = ["a", 'q"q', "line\nend", "c,omma", "", "t\tab", "x" * 80, '"', "\r\nz", '""', "it's"]
    for name, sep in (("t.csv", ","), ("t.tsv", "\t")):
        out = io.StringIO()
        w = csv.writer(out, delimiter=sep, lineterminator="\n")
        w.writerow(["Model", " prompt ", "answer", "cost", "Cost"])
        for i in range(250):
            w.writerow([f"m{i}", *(rng.choice(words) + rng.choice(words) for _ in range(2)), i, i + 1])
        text = out.getvalue().replace("m7" + sep, f'12" m{sep}', 1)  # a quote inside a field that none opened
        path = tmp_path / name
        path.write_text(text, encoding="utf-8", newline="")
        rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=sep))
        from pyspark.sql import functions as F

        found = quoted_rows(spark, [str(path)], F.lit(sep))
        assert found.count() == len(rows) and found.select("block").distinct().count() > 20
        got = read_calls(spark, str(path))[0].orderBy("ordinal").collect()
        # the second of the equal names counts
        assert [(r["model"], r["prompt_excerpt"], r["output_excerpt"], r["logged_cost_usd"]) for r in got] == [(r[0], r[1].strip(), r[2].strip() if len(r[2]) < 200 else r["output_excerpt"], float(r[4])) for r in rows[1:]]


def test_many_files_in_one_plan(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"f{i:03}.jsonl").write_text(f'{{"model":"m{i}","messages":[]}}\n{{"model":"n{i}"}}\n' if i % 2 else f'{{"model":"m{i}"}}\nbad\n')
    (tmp_path / "z +%20.CSV").write_text("model\nq\n")
    calls, skipped = read_all(spark, [str(tmp_path)])
    rows = calls.orderBy("ordinal").collect()
    assert [r["model"] for r in rows] == [x for i in range(300) for x in ([f"m{i}", f"n{i}"] if i % 2 else [f"m{i}"])] + ["q"]
    assert {r["format"] for r in rows if r["model"].startswith("n")} == {"litellm"} and skipped.first()[0] == 150
    few = read_all(spark, [str(tmp_path / n) for n in ("f000.jsonl", "z +%20.CSV")])[0]
    scans = [df._jdf.queryExecution().optimizedPlan().toString().count("Relation") for df in (calls, few)]
    assert scans[0] == scans[1]
    uri = read_all(spark, [f"file://{tmp_path}"])[0]
    assert sorted(r["model"] for r in uri.collect()) == sorted(r["model"] for r in rows)
