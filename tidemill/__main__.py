"""python -m tidemill run|benchmark|fixture: the pipeline over delivered files or made-up months, its benchmark, the fixture lane."""

from __future__ import annotations

import argparse
import json
import os
import sys

from tidemill.functions.session import session
from tidemill.plans import lakehouse, layouts
from tidemill.sources import generate
from tidemill.sources.log import Folder


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="tidemill", description=__doc__)
    parser.add_argument("what", choices=["run", "benchmark", "fixture"])
    parser.add_argument("--root", default=os.environ.get("LAKEHOUSE_DIR", "lakehouse"))
    parser.add_argument("--source", help="a JSON manifest of delivered files (see lakehouse.delivered); without it months are made up")
    parser.add_argument("--sample-percent", type=float, help="land a sample of the delivered rows")
    parser.add_argument("--months", nargs="+", default=["2024-02", "2025-01", "2025-02"])
    parser.add_argument("--rows", type=int, default=400)
    parser.add_argument("--steps", nargs="+", choices=lakehouse.STEPS, default=list(lakehouse.STEPS[:-1]))
    parser.add_argument("--with-benchmark", action="store_true")
    parser.add_argument("--bench-rounds", type=int, default=5)
    parser.add_argument("--baseline-files", type=int, default=200)
    parser.add_argument("--target-file-mb", type=float, default=32)
    parser.add_argument("--rebuild", action="store_true")
    parser.add_argument("--master", default=None)
    o = parser.parse_args(args)
    spark = session(master=o.master or os.environ.get("SPARK_MASTER") or "local[*]")
    lake = lakehouse.Lakehouse(spark, o.root)
    if o.what == "fixture":
        batches, expected = {}, {}
        for n in (1, 2, 3):
            batches[f"fixture_{n}"], counts = generate.fixture_batch(spark, n)
            expected = {k: expected.get(k, 0) + v for k, v in counts.items()}
        print(json.dumps(lake.fixture(batches, expected), indent=1))
        return 0
    files = json.loads(Folder(spark, os.path.dirname(o.source) or ".").read(os.path.basename(o.source))) if o.source else None
    do = (lakehouse.delivered(lake, files, o.sample_percent) if files else lakehouse.made_up(lake, o.months, o.rows)) | {"benchmark": lambda: layouts.run(lake, n=o.bench_rounds, baseline_files=o.baseline_files, target_bytes=int(o.target_file_mb * 2**20))}
    if o.rebuild:
        do["silver"] = lambda: lake.silver(rebuild=True)
    steps = ["benchmark"] if o.what == "benchmark" else [*o.steps, *(["benchmark"] if o.with_benchmark and "benchmark" not in o.steps else [])]
    status = lake.run(steps, do)
    print(json.dumps(status, indent=1))
    return 0 if status["ok"] else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
