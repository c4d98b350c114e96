"""python -m paperlode INDEX VERB [ARGUMENT...] [--name value...]: a verb of the index, its rows as JSON."""

from __future__ import annotations

import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from paperlode.api import Index
from paperlode.config import Settings

VERBS = ("ingest", "extract", "index", "build", "reset", "search", "grep", "doc", "read", "sample", "fields", "aggregate", "sql", "anomalies", "peek", "entities", "entity", "reconcile", "cluster", "cite", "verify", "add_finding", "findings", "audit", "review", "note", "notes", "update_note", "recall", "trace", "coverage", "status", "init", "render", "ocr", "transcribe_status", "transcribe_import", "reconcile_show")
LISTS = {"ingest", "extract", "build", "read"}


def value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def shown(out):
    if isinstance(out, DataFrame):
        return [r.asDict(recursive=True) for r in out.collect()]
    if isinstance(out, dict):
        return {k: shown(v) for k, v in out.items()}
    return out


def main(args: list[str]) -> int:
    if len(args) < 2 or args[1] not in VERBS:
        print(f"{__doc__}\nVerbs: {', '.join(VERBS)}")
        return 2
    folder, verb, plain, named = args[0], args[1], [], {}
    rest = iter(args[2:])
    for a in rest:
        if a.startswith("--"):
            named[a[2:].replace("-", "_")] = value(next(rest, "true"))
        else:
            plain.append(a if verb in LISTS else value(a))
    config = Path(folder, "config.toml")
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    index = Index(spark, folder, Settings.load(config.read_text()) if config.exists() else None)
    try:
        out = getattr(index, verb)(*([plain] if verb in LISTS else plain), **named)
    except (KeyError, LookupError, ValueError, RuntimeError) as e:
        print(json.dumps({"error": str(e)}))
        return 1
    print(json.dumps(shown(out), default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
