"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1).
BENCH_CPUS: local cores (default 8). Query names as arguments replace the default list.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sectionweave.registry import QUERIES  # noqa: E402
from sectionweave.session import build_session  # noqa: E402

HEADLINE = (
    "prepare_train", "prepare_eval", "prepare_stemmed", "prepare_pooled", "best_section", "sentence_section_scores",
    "collect_summaries", "generate_rows", "assemble_scores", "score_pairs", "score_stemmed", "rougeLsum_pairs",
    "bootstrap_ci", "corpus_bleu", "encode_rows", "unmask_decode",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g", spark__sql__shuffle__partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    names = sys.argv[1:] or HEADLINE
    cold = timed(names[0])  # JVM and Python worker start; reported on its own
    seconds = {name: timed(name) for name in names}
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus, "cold_start_sec": cold}))


if __name__ == "__main__":
    main()
