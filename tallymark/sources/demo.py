"""Made-up logs and source files to try an audit on: one file of each kind that is read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tallymark.session import scratch
from tallymark.sources.calls import read_calls, united

TOPICS = ["the parcel is late", "my card was charged twice", "the lamp flickers", "how do I change my address", "thanks, all is well"]
LABELS = ["delivery", "billing", "fault", "account", "praise"]


def _gateway() -> list[str]:
    """Calls of a gateway: topics to label, and release notes to write."""
    rows = []
    for i in range(40):
        asked, said = (f"Classify this message: {TOPICS[i % 5]}", LABELS[i % 5]) if i % 4 else ("Write a release note for version " + str(i), "This version mends what the last one broke. " * 12)
        rows.append({"id": f"g{i}", "model": "gpt-4o", "messages": [{"role": "user", "content": asked}], "response": {"choices": [{"message": {"content": said}}]}, "usage": {"prompt_tokens": 40 + i, "completion_tokens": len(said) // 4 + 1}})
    return [*map(json.dumps, rows), "{not a record"]


def _traces() -> list[str]:
    """Observations of a tracing tool: questions of yes and no, with costs."""
    return [json.dumps({"id": f"t{i}", "type": "GENERATION", "model": "claude-sonnet-4", "input": f"Is this message urgent? {TOPICS[i % 5]}", "output": "yes" if i % 3 else "no", "usage": {"input": 60, "output": 1}, "totalCost": 0.002}) for i in range(25)]


def _records() -> list[str]:
    """Records of a tool of one's own: ratings, several calls to a record, a model without a price."""
    return [json.dumps({"data": [{"model": "in-house-7b", "prompt": f"Rate the mood from 1 to 5: {t}", "output": str(i + 1), "request_count": 20} for i, t in enumerate(TOPICS)]})]


def _usage() -> list[str]:
    """An export of usage by day, without texts."""
    return ["date,model,input_tokens,output_tokens,cost,requests", *(f"2024-03-{d:02d},gpt-4o-mini,{d * 900},{d * 40},{d / 10},{d * 30}" for d in range(1, 15))]


FILES = {"gateway.jsonl": _gateway, "traces.ndjson": _traces, "records.json": _records, "usage.csv": _usage}
SOURCES = {
    "desk/route.py": 'LABELS = ("delivery", "billing")\n\ndef route(client, text):\n    r = client.chat.completions.create(model="gpt-4o", messages=[{"role": "user", "content": "Classify this message as delivery or billing"}])\n    label = r.choices[0].message.content\n    return label if label in LABELS else "other"\n',
    "web/notes.ts": 'const note = await client.messages.create({ model: "claude-sonnet-4", messages: [{ role: "user", content: "Write a cheerful note to the customer" }] });\n',
}


def demo_calls(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(calls, one row of ``skipped``): the files are written to the shared folder and read like others."""
    frames = []
    for name, lines in FILES.items():
        path = scratch(spark, name)
        spark.createDataFrame([(x,) for x in lines()], "line string").coalesce(1).write.text(path)
        frames.append(read_calls(spark, path))
    return united(frames)


def demo_sources(spark: SparkSession) -> DataFrame:
    """(path, content) of the source files."""
    return spark.createDataFrame(list(SOURCES.items()), "path string, content string")
