"""Benchmark: headline ledger queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Steps: map the test tables to a ledger once and store it as parquet (timed as
``build_ledger``), stage the derived import batches, then run each headline
query over the stored ledger -- one warm-up, then the median of three runs,
each forced with the ``noop`` sink. Import timings include the batch's
validation checkpoint and id allocation (their eager jobs run when the
import is built, which is inside the timed call); ``import_expenses_stored`` and
``import_group_stored`` also append all new rows to the stored ledger and stand
outside the total, which stays comparable with earlier rounds.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerline.operators import exports as X  # noqa: E402
from ledgerline.operators import groups as G  # noqa: E402
from ledgerline.operators import loads as M  # noqa: E402
from ledgerline.operators import reports as R  # noqa: E402
from ledgerline.plans.inspect import broadcast_joins, exchanges  # noqa: E402
from ledgerline.schema import Ledger  # noqa: E402
from ledgerline.session import get_spark, scratch_path  # noqa: E402
from ledgerline.sources import batches as B  # noqa: E402
from ledgerline.sources import store  # noqa: E402
from ledgerline.sources.testdata import ledger_from_testdata  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def _force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _time(fn) -> float:
    t = time.perf_counter()
    fn()
    return time.perf_counter() - t


def main() -> None:
    spark = get_spark(app="ledgerline-bench")
    build_dir = scratch_path(spark, "bench-ledger")
    t_build = _time(lambda: ledger_from_testdata(spark, SF_DIR).write(build_dir))
    led = Ledger.read(spark, build_dir)
    base_dir = scratch_path(spark, "bench-base")
    B.base_ledger(spark, SF_DIR, led).write(base_dir)
    base = Ledger.read(spark, base_dir)
    # the incoming import batches are staged once (they stand for the uploaded files)
    staged = {}
    for name, batch in (("personal", B.personal_batch(spark, SF_DIR, led)),
                        ("group", B.group_batch(spark, SF_DIR, led))):
        staged[name] = scratch_path(spark, f"bench-{name}-batch")
        batch.write.parquet(staged[name])

    headline = {
        "list_expenses": lambda: R.list_expenses(led),
        "top_expenses_per_user": lambda: R.top_expenses(led, 3, "1996-01-01", "1997-12-31"),
        "above_average_expenses": lambda: R.above_average_expenses(led),
        "monthly_category_spending": lambda: R.monthly_category_spending(led),
        "highest_spender_per_month": lambda: R.highest_spender_per_month(led),
        "tag_expenses": lambda: R.tag_expenses(led),
        "group_user_expenses": lambda: G.group_user_expenses(led),
        "export_group": lambda: X.group_export(led),
        "import_expenses": lambda: M.import_expenses(
            base, spark.read.parquet(staged["personal"])).ledger.expenses,
        "import_group": lambda: M.import_group(base, spark.read.parquet(staged["group"]), B.IMPORTER_UID,
                                               as_of="2001-07-15").extra["splits"],
    }
    results: dict[str, float] = {}
    plans: dict[str, dict[str, int]] = {}
    for name, build in headline.items():
        df = build()
        plans[name] = {"exchanges": exchanges(df), "broadcast_joins": broadcast_joins(df)}
        _force(df)  # warm-up
        results[name] = round(statistics.median(_time(lambda: _force(build())) for _ in range(RUNS)), 3)

    stored: dict[str, float] = {}
    for load, (name, run) in enumerate({
            "import_expenses_stored": lambda b: M.import_expenses(b, spark.read.parquet(staged["personal"])),
            "import_group_stored": lambda b: M.import_group(b, spark.read.parquet(staged["group"]), B.IMPORTER_UID,
                                                            as_of="2001-07-15")}.items(), start=1):
        stored[name] = round(_time(lambda: store.save(run(Ledger.read(spark, base_dir, before=load)), base_dir, load)), 3)

    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    out = {"metric": "ledger_headline_total", "value": round(sum(results.values()), 3), "unit": "sec",
           "queries": results, "build_ledger": round(t_build, 3), "stored": stored, "plans": plans, "sf": sf,
           "cpus": int(os.environ.get("BENCH_CPUS", "8"))}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
