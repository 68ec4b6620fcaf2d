"""Derive a larger copy of a scale-factor folder for scale checks: every table is replicated
``k`` times with its id columns shifted per replica (so ids stay unique and the fixture views keep
their meaning). Written once with Spark into a fresh folder.

usage: python tools/make_scaled.py SRC_DIR DST_DIR K
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from rewardframe.session import TABLES, get_session  # noqa: E402

ID_COLS = {
    "events": ["event_id"], "documents": ["doc_id"], "labels": ["doc_id"], "conversations": ["conv_id"],
    "pages": ["page_id"], "benchmark": ["item_id"], "embeddings": ["vec_id"],
}


def main() -> None:
    src, dst, k = sys.argv[1], sys.argv[2], int(sys.argv[3])
    spark = get_session("local[8]")
    for t in TABLES:
        df = spark.read.parquet(f"{src}/{t}.parquet")
        cols = ID_COLS.get(t)
        if cols:
            span = df.agg(*[F.max(c).alias(c) for c in cols]).first()
            df = df.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
            for c in cols:
                df = df.withColumn(c, F.col(c) + F.col("_rep") * (int(span[c]) + 1))
            df = df.drop("_rep")
        df.repartition(max(1, k // 4) if cols else 1).write.parquet(f"{dst}/{t}.parquet")
    spark.stop()


if __name__ == "__main__":
    main()
