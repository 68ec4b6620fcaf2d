"""Scoring of responses whose test outcomes arrive later, on a stream of their own (ST1).

Responses and outcomes are two streams; rows of one response meet in keyed state, in whatever order and
batches they come. A response is scored once, when it is there with an outcome of each planned test (or
when the runner reports that it failed); one without planned tests is scored at once. Each test counts
once: of outcomes that come again the first counts. State is a few numbers and a bit for each test;
of a scored response only the mark that it is done stays.

State is checkpointed, so a stopped query goes on where it was, and the file sink's log makes a batch that
is repeated after a crash count once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rewardframe.operators.reward import RewardConfig, shape_columns
from rewardframe.operators.verify import RUNNER_ERROR

#: What a response brings along, as ``reward.prepare_responses`` gives it.
FLAGS = {"has_code": "boolean", "syntax_valid": "boolean", "compile_valid": "boolean", "n_tests": "int", "code_length": "int"}
#: What its outcomes add up to, as ``reward.outcome_counts`` gives it.
COUNTS = {
    "passed_n": "bigint", "timeouts_n": "bigint", "runtime_errors_n": "bigint", "outcomes_n": "bigint", "crashed_n": "bigint",
    "execution_time": "double",
}
STATE = {"done": "boolean", "known": "boolean", **FLAGS, **COUNTS, "seen": "binary"}


def _schema(fields: dict[str, str]) -> str:
    return ", ".join(f"{k} {t}" for k, t in fields.items())


def _mark(seen: bytes, test: int) -> tuple[bytes, bool]:
    """The bits of the tests seen with this one, and whether it is new."""
    at, bit = divmod(test, 8)
    bits = bytearray(seen.ljust(at + 1, b"\0"))
    new = not bits[at] >> bit & 1
    bits[at] |= 1 << bit
    return bytes(bits), new


#: Columns of a response that is scored.
MET = pd.Index(["id", *FLAGS, *COUNTS])
#: How an outcome's status counts; its place is the code that the state function gets.
STATUS_COUNTS = ("passed_n", "timeouts_n", "runtime_errors_n")


def _meet(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state function: rows of one response in this batch, and what is known of it. It is called for
    each response, so rows come as one column of texts, and pandas is asked for little."""
    now = dict(zip(STATE, state.get)) if state.exists else {"done": False, "known": False, "seen": b"", **dict.fromkeys(FLAGS), **dict.fromkeys(COUNTS, 0)}
    if now["done"]:
        return
    now["execution_time"] = float(now["execution_time"])
    for batch in batches:
        for text in batch["row"].tolist():
            row = json.loads(text)
            if "response" in row:
                if not now["known"]:
                    now.update({k: row["response"].get(k) for k in FLAGS}, known=True)
                continue
            now["seen"], new = _mark(now["seen"], row["test_idx"])
            if not new:
                continue
            if "counts_as" in row:
                now[STATUS_COUNTS[row["counts_as"]]] += 1
            now["outcomes_n"] += 1
            now["crashed_n"] += row["crashed"]
            now["execution_time"] += float(row.get("run_time_s", 0.0))
    valid = now["known"] and now["has_code"] and now["syntax_valid"] and now["compile_valid"]
    planned = now["n_tests"] if valid else 0
    if now["known"] and (now["crashed_n"] or now["outcomes_n"] >= planned):
        yield pd.DataFrame(np.array([[key[0], *(now[k] for k in (*FLAGS, *COUNTS))]], dtype=object), columns=MET)
        now.update({**dict.fromkeys(FLAGS), **dict.fromkeys(COUNTS, 0), "seen": b"", "done": True})
    state.update(tuple(int(now[k]) if t == "bigint" else now[k] for k, t in STATE.items()))


def score_arrivals(
    prepared: DataFrame,
    outcomes: DataFrame,
    cfg: RewardConfig = RewardConfig(),
    id_col: str = "sample_id",
    timeout_as: str = "error",
) -> DataFrame:
    """Reward row of each response (append mode). ``prepared``: a stream of ``reward.prepare_responses``;
    ``outcomes``: a stream of id, test_idx, status and, if it has them, error_type and run_time_s."""
    if timeout_as not in ("error", "timeout"):
        raise ValueError("timeout_as must be 'error' or 'timeout'")
    kind = prepared.schema[id_col].dataType.simpleString()

    def column(df: DataFrame, name: str, dtype: str):
        return (F.col(name) if name in df.columns else F.lit(None)).cast(dtype)

    response = F.struct(F.struct(*(column(prepared, k, t).alias(k) for k, t in FLAGS.items())).alias("response"))
    status, error, seconds = column(outcomes, "status", "string"), column(outcomes, "error_type", "string"), column(outcomes, "run_time_s", "double")
    if timeout_as == "timeout":
        status = F.when(~status.eqNullSafe("success") & error.eqNullSafe("TIMEOUT"), "timeout").otherwise(status)
    outcome = F.struct(
        column(outcomes, "test_idx", "bigint").alias("test_idx"),
        F.when(status == "success", 0).when(status == "timeout", 1).when(status.isin("error", "runtime_error"), 2).alias("counts_as"),
        error.eqNullSafe(RUNNER_ERROR).alias("crashed"),
        F.when(~F.isnan(seconds), seconds).alias("run_time_s"),
    )
    rows = [df.select(F.col(id_col).cast(kind).alias("id"), F.to_json(r).alias("row")) for df, r in ((prepared, response), (outcomes, outcome))]
    met = rows[0].unionByName(rows[1]).groupBy("id").applyInPandasWithState(
        _meet, _schema({"id": kind, **FLAGS, **COUNTS}), _schema(STATE), "append", GroupStateTimeout.NoTimeout
    )
    # a response whose scoring raised loses its flags and gets the crash row
    flagged = met.withColumn("has_code", F.when(F.col("crashed_n") == 0, F.col("has_code")))
    return flagged.select(F.col("id").alias(id_col), *shape_columns(cfg))
