"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one line of JSON.

Each query runs once to warm up and then three times; its time is the median. Queries are run to the last row and column (into a sink
that drops them), and rebuilt for each run, so that planning counts. ``rows_per_sec`` is given for the three stages of a job.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from labelmill.operators import requests as Q  # noqa: E402
from labelmill.operators import responses as R  # noqa: E402
from labelmill.operators.ids import assign_batches, assign_ids, id_from_column  # noqa: E402
from labelmill.operators.merge import merge_results  # noqa: E402
from labelmill.plans.queries import QUERIES  # noqa: E402
from labelmill.plans.tables import DOCUMENT_SPEC, document_answer, response_line, table  # noqa: E402
from labelmill.functions.identity import encode_request_id  # noqa: E402
from labelmill.session import local_session, shared_dir  # noqa: E402
from labelmill.sources.records import read_lines, write_lines  # noqa: E402

REGISTERED = ["label_rows", "infer_rows", "assign_ids", "batch_assign", "build_requests", "token_estimate", "canonical_cells", "parse_responses", "error_rows",
              "conform_strict", "constraint_check", "merge_results", "merge_dedup", "unanswered_rows", "preflight_report", "cost_exact", "batch_status",
              "batch_list", "scan_csv"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, memory="8g")
    documents = table(spark, folder, "documents")
    n = documents.count()
    answered = shared_dir(spark, "bench")
    write_lines(documents.select(response_line(encode_request_id(documents.doc_id), document_answer(documents)).alias("value")), answered)

    def prepare():
        rows = assign_batches(assign_ids(documents, order_by=["doc_id"]), DOCUMENT_SPEC.batch_size)
        return Q.build_requests(rows, DOCUMENT_SPEC)

    def parse():
        return R.parse_responses(read_lines(spark, answered), DOCUMENT_SPEC)

    def collect():
        return merge_results(id_from_column(documents, "doc_id"), R.answers(parse(), DOCUMENT_SPEC))

    stages = {"stage_prepare": prepare, "stage_parse": parse, "stage_collect": collect}
    times = {}
    for name, build in {**stages, **{q: (lambda q=q: QUERIES[q](spark, folder)) for q in REGISTERED}}.items():
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times,
        "rows_per_sec": {s: round(n / times[s]) for s in stages}, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
