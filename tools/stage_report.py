"""Per-stage task balance from a Spark event log (JSON lines written by spark.eventLog.*).

usage: python tools/stage_report.py EVENT_LOG_FILE
Prints, per stage: tasks, max/median task time (ms), max/total shuffle-read records and
max/total input records, so a task that holds a hot key or a whole table stands out.
"""

from __future__ import annotations

import json
import statistics
import sys
from collections import defaultdict


def _lines(path: str):
    """Event-log lines; zstd-compressed logs (Spark's default codec) are decompressed."""
    if path.endswith(".zstd"):
        import io

        import zstandard

        with open(path, "rb") as raw:
            reader = zstandard.ZstdDecompressor().stream_reader(raw)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as f:
            yield from f


def main() -> None:
    stages: dict[int, list[dict]] = defaultdict(list)
    names: dict[int, str] = {}
    for line in _lines(sys.argv[1]):
        if True:
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerStageCompleted":
                info = ev["Stage Info"]
                names[info["Stage ID"]] = info["Stage Name"][:60]
            elif kind == "SparkListenerTaskEnd" and ev.get("Task Metrics"):
                m = ev["Task Metrics"]
                stages[ev["Stage ID"]].append({
                    "ms": m.get("Executor Run Time", 0),
                    "shuffle": m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0),
                    "input": m.get("Input Metrics", {}).get("Records Read", 0),
                })
    print(f"{'stage':>5} {'tasks':>5} {'max ms':>7} {'med ms':>7} {'max shuf':>9} {'tot shuf':>9} {'max in':>9} {'tot in':>9}  name")
    for sid in sorted(stages):
        ts = stages[sid]
        ms = [t["ms"] for t in ts]
        print(f"{sid:>5} {len(ts):>5} {max(ms):>7} {int(statistics.median(ms)):>7} "
              f"{max(t['shuffle'] for t in ts):>9} {sum(t['shuffle'] for t in ts):>9} "
              f"{max(t['input'] for t in ts):>9} {sum(t['input'] for t in ts):>9}  {names.get(sid, '')}")


if __name__ == "__main__":
    main()
