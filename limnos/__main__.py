"""python -m limnos QUERY TABLES [OUT]: shows the first rows of a registered query, or writes them all as Parquet."""

import argparse

from pyspark.sql import SparkSession

from limnos.queries import queries


def main() -> None:
    known = queries()
    parser = argparse.ArgumentParser(prog="limnos", description=__doc__)
    parser.add_argument("query", choices=sorted(known))
    parser.add_argument("tables")
    parser.add_argument("out", nargs="?")
    args = parser.parse_args()
    df = known[args.query](SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), args.tables)
    if args.out:
        df.write.parquet(args.out)
    else:
        df.show(20, truncate=60)


if __name__ == "__main__":
    main()
