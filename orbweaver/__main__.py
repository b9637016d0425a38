"""python -m orbweaver list | run NAME --data DIR [--out DIR] | search QUERY --data DIR"""

from __future__ import annotations

import argparse

from orbweaver import catalog
from orbweaver.operators import lexical
from orbweaver.session import get_spark, load, ship


def main() -> None:
    p = argparse.ArgumentParser(prog="orbweaver", description=__doc__)
    p.add_argument("verb", choices=("list", "run", "search"))
    p.add_argument("what", nargs="?", default="")
    p.add_argument("--data", default=".")
    p.add_argument("--out")
    p.add_argument("--limit", type=int, default=10)
    a = p.parse_args()
    if a.verb == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return
    spark = get_spark()
    ship(spark)
    df = catalog.QUERIES[a.what](spark, a.data) if a.verb == "run" else lexical.keyword_search(load(spark, a.data, "documents"), a.what, a.limit)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(a.limit, truncate=80)


if __name__ == "__main__":
    main()
