"""python -m tessitura: list the queries, run one, show its plan, train, recommend, or serve tools."""

from __future__ import annotations

import argparse


def main() -> None:
    p = argparse.ArgumentParser(prog="tessitura", description=__doc__)
    p.add_argument("command", choices=["list", "run", "explain", "train", "recommend", "serve"])
    p.add_argument("name", nargs="?", help="a query's name, or the training mode")
    p.add_argument("--tables", default="/root/testdata/sf0.001", help="folder of parquet tables")
    p.add_argument("--out", help="write the result as parquet here instead of showing it")
    p.add_argument("--rows", type=int, default=20)
    p.add_argument("--users", type=int, nargs="*", help="whom to recommend for; all without it")
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--slots", type=int, help="exploration slots; without it those of the users' preferences")
    p.add_argument("--mood", default="")
    a = p.parse_args()

    from tessitura.plans import registry

    queries, _ = registry()
    if a.command == "list":
        print(*sorted(queries), sep="\n")
        return

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tessitura").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "serve":
        from tessitura.tools import serve

        serve(spark, a.tables)
        return
    if a.command == "recommend":
        from tessitura.plans.learned import recommend

        df, _ = recommend(spark, a.tables, users=a.users, top_k=a.top_k, slots=a.slots, mood=a.mood)
        if a.out:
            df.write.mode("overwrite").parquet(a.out)
            return
    elif a.command == "train":
        from tessitura.operators import training
        from tessitura.plans.learned import train

        df, new = train(spark, a.tables, spark.createDataFrame([], training.HISTORY), a.name or "light")
        if a.out:
            new.write.mode("append").parquet(a.out)
    else:
        df = queries[a.name](spark, a.tables)
        if a.command == "explain":
            df.explain("formatted")
            return
        if a.out:
            df.write.mode("overwrite").parquet(a.out)
            return
    df.show(a.rows, truncate=False)


if __name__ == "__main__":
    main()
