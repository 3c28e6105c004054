"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the input, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` (comma separated, or
``all``) the queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from encoscope.plans import load_all, table  # noqa: E402
from encoscope.session import local_session  # noqa: E402

HEADLINE = (
    "gram_matrix",
    "logme_pool_leaderboard",
    "logme_univariate",
    "logme_predict",
    "pca_logme",
    "leep_paper",
    "f1_report",
    "token_f1",
    "chunk_scores",
    "chunk_scores_by_type",
    "weighted_tau",
    "tau_summary",
    "seeded_split",
    "flatten_labels",
    "mean_pool_static",
    "subword_to_word_mean",
    "conllu_words",
    "conllu_stats",
    "conllu_doc_groups",
    "early_stop",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    wanted = os.environ.get("BENCH_QUERIES", "")
    registry = load_all()
    names = list(registry) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    spark = local_session(cpus, "encoscope-bench", spark__sql__shuffle__partitions=cpus)
    # start the Python workers and the Parquet reader before the clock runs
    first = table(spark, sf_dir, "embeddings").select("vec_id")
    first.mapInArrow(lambda batches: batches, first.schema).agg({"vec_id": "sum"}).collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )


if __name__ == "__main__":
    main()
