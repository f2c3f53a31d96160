"""Times the miners on baskets from the tables in $BENCH_SF_DIR and prints one
JSON line.  Each time covers building the baskets, mining and counting."""

from __future__ import annotations

import json
import os
import time

from granary.plans import miners
from granary.plans.baskets import baskets, supports
from granary.session import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

RUNS = {
    "fp_growth_order_attr": ("order_attr", "FP_GROWTH", {}),
    "fp_growth_cust_brand": ("cust_brand", "FP_GROWTH", {}),
    "fp_growth_order_brand": ("order_brand", "FP_GROWTH", {}),
    "fp_growth_user_event": ("user_event", "FP_GROWTH", {}),
    "eclat_order_attr": ("order_attr", "ECLAT", {}),
    "eclat_cust_brand": ("cust_brand", "ECLAT", {}),
    "eclat_order_brand": ("order_brand", "ECLAT", {}),
    "eclat_user_event": ("user_event", "ECLAT", {}),
    "fin_order_attr": ("order_attr", "FIN", {"groups": 8}),
    "fin_cust_brand": ("cust_brand", "FIN", {"groups": 8}),
    "fin_order_brand": ("order_brand", "FIN", {"groups": 8}),
    "fin_user_event": ("user_event", "FIN", {}),
    "bigfim_order_attr": ("order_attr", "BIG_FIM", {}),
    "bigfim_cust_brand": ("cust_brand", "BIG_FIM", {}),
    "bigfim_order_brand": ("order_brand", "BIG_FIM", {}),
    "bigfim_user_event": ("user_event", "BIG_FIM", {}),
    "apriori_order_attr": ("order_attr", "APRIORI", {}),
    "apriori_order_brand": ("order_brand", "APRIORI", {}),
    "apriori_user_event": ("user_event", "APRIORI", {}),
}


def main() -> None:
    spark = session(
        f"local[{CPUS}]", partitions=8, **{"spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    miners.mine(baskets(spark, SF_DIR, "user_event"), 0.9, "FIN").count()  # warm-up
    took: dict[str, float] = {}
    for name, (basket, miner, options) in RUNS.items():
        began = time.perf_counter()
        rows = baskets(spark, SF_DIR, basket).persist()
        miners.mine(rows, supports(basket), miner, **options).count()
        took[name] = round(time.perf_counter() - began, 2)
        rows.unpersist()
    print(json.dumps({"metric": "total mining time", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
