"""Print the physical plans of the headline operators (AQE off, so exchange reuse is visible).

usage: python tools/show_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from ticklens.operators import daily, intervals, models
    from ticklens.operators import clean
    from ticklens.plans import queries as Q
    from ticklens.session import get_session
    from ticklens.sources import fixtures as fx
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    ticks = fx.load_ticks(spark, sf_dir)
    plans = {
        "daily_trades": daily.daily_trades(ticks),
        "quote_rows": daily.quote_rows(ticks),
        "distribution": intervals.distribution(clean.trades(clean.clean(ticks))),
        "coefficient": models.per_ticker(Q.container_lineitem(spark, sf_dir)),
    }
    for name, df in plans.items():
        print(f"===== {name}")
        df.explain("formatted")


if __name__ == "__main__":
    main(sys.argv)
