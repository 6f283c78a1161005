"""Trial on a larger, skewed log: python trial.py FOLDER [--rows N] [--seed N] [--skew SHARE].

Makes the log once per folder (raw CSV and clean Parquet), answers the same
questions with this library and with DuckDB, which runs in a process of its own,
and prints one Markdown row per question: seconds of the better of two runs, and
whether both found the same. No query of the library reads this log.
"""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
import time
from pathlib import Path

START, END = "2022-04-01 12:00:00", "2022-04-01 18:00:00"
BOX = "x between 349 and 449 and y between 514 and 614"
DUCK = {
    "colors of a 6 h frame": f"""select pixel_color, count(*) as n from log
        where timestamp >= '{START}' and timestamp < '{END}' group by 1""",
    "colors by distinct users, 6 h": f"""select pixel_color, count(distinct user_id_hashed) as n from log
        where timestamp between '{START}' and '{END}' group by 1""",
    "average session, all rows": """with i as (select distinct user_id_hashed as u, timestamp as t from log),
        m as (select *, 0 = count(*) over (partition by u order by t range between interval 900 seconds preceding
              and interval 1 microsecond preceding) as opens from i),
        s as (select *, count(*) filter (where opens) over (partition by u order by t) as k from m)
        select 'sessions' as name, count(*) as n from (select u, k from s group by u, k)""",
    "top 10 users": """select cast(user_id_hashed as varchar), count(*) as n from log group by user_id_hashed
        order by n desc, user_id_hashed limit 10""",
    "region of 101 x 101": f"select 'cells', count(*) from (select distinct x, y from log where {BOX})",
}


def make(spark, folder: str, rows: int, seed: int, skew: float) -> None:
    """``skew`` of the rows by one user and on one cell, the rest spread over rows/25 users and 4 million cells."""
    h = f"abs(xxhash64(id, {seed}"
    log = spark.range(0, rows, 1, 64).selectExpr(
        f"timestamp_ntz'2022-04-01 00:00:00' + make_dt_interval(0, 0, 0, {h}, 1)) % 345600000 / 1000) as timestamp",
        f"if({h}, 2)) % 1000 < {int(1000 * skew)}, 7L, {h}, 3)) % {max(1, rows // 25)}) as user_id_hashed",
        f"concat('#', lpad(hex({h}, 4)) % 32), 6, '0')) as pixel_color",
        f"cast(if({h}, 5)) % 1000 < {int(1000 * skew)}, 400, {h}, 6)) % 2000) as int) as x",
        f"cast(if({h}, 5)) % 1000 < {int(1000 * skew)}, 564, {h}, 7)) % 2000) as int) as y",
    )
    log.write.parquet(f"{folder}/plain")


def ours(spark, px, F, log) -> dict:
    """Rows of (name, n) for the questions, as DataFrames."""
    session_window = log.groupBy("user_id_hashed", F.session_window("timestamp", "900 seconds")).count()
    box = (F.col("x").between(349, 449)) & (F.col("y").between(514, 614))
    return {
        "colors of a 6 h frame": px.count_by(px.within_frame(log, START, END), "pixel_color"),
        "colors by distinct users, 6 h": px.rank_colors_by_distinct_users(log, START, END).select("pixel_color", "distinct_users"),
        "average session, all rows": px.sessionize(log).groupBy(F.lit("sessions")).count(),
        "the same by session_window, merged before the shuffle": session_window.groupBy(F.lit("sessions")).count(),
        "top 10 users": px.top_users(log, 10).select(F.col("user_id_hashed").cast("string"), "placements"),
        "region of 101 x 101": px.final_cells(log.where(box)).groupBy(F.lit("cells")).count(),
    }


def duck(folder: str) -> None:
    import duckdb

    connection = duckdb.connect()
    connection.execute(f"create view log as select * from '{folder}/plain/*.parquet'")
    out = {}
    for name, sql in DUCK.items():
        seconds, rows = [], []
        for _ in range(2):
            began = time.perf_counter()
            rows = connection.sql(sql).fetchall()
            seconds.append(time.perf_counter() - began)
        out[name] = min(seconds), sorted(map(list, rows))
    print(json.dumps(out))


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("folder")
    args.add_argument("--rows", type=int, default=50_000_000)
    args.add_argument("--seed", type=int, default=1)
    args.add_argument("--skew", type=float, default=0.33)
    args.add_argument("--duck", action="store_true", help=argparse.SUPPRESS)
    given = args.parse_args()
    if given.duck:
        return duck(given.folder)
    from pyspark.sql import functions as F

    import pixeltide as px
    from pixeltide.session import build_session

    spark = build_session(
        "trial", "local[8]", spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="64",
        spark__sql__sessionWindow__merge__sessions__in__local__partition="true",
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not Path(given.folder, "clean").exists():
        make(spark, given.folder, given.rows, given.seed, given.skew)
        px.write_log(px.read_log(spark, f"{given.folder}/plain"), f"{given.folder}/clean", folders="hour")
    theirs = json.loads(subprocess.run([sys.executable, __file__, given.folder, "--duck"], capture_output=True, text=True, check=True).stdout)
    results = {}
    for layout in ("plain", "clean"):
        for _ in range(2):  # made anew each time, or the second run would find the first one's shuffles
            for name, df in ours(spark, px, F, px.read_log(spark, f"{given.folder}/{layout}")).items():
                began = time.perf_counter()
                rows = sorted(map(list, df.collect()))
                took = time.perf_counter() - began
                results[name, layout] = min(took, results.get((name, layout), (took,))[0]), rows
    print("| Question | plain files, s | hour folders, tile order, s | DuckDB, s | equal |\n|---|---|---|---|---|")
    for name in dict.fromkeys(n for n, _ in results):
        plain, clean, other = results[name, "plain"], results[name, "clean"], theirs.get(name)
        equal = plain[1] == clean[1] and (other is None or other[1] == plain[1])
        print(f"| {name} | {plain[0]:.1f} | {clean[0]:.1f} | {f'{other[0]:.1f}' if other else '-'} | {'yes' if equal else 'NO'} |")


if __name__ == "__main__":
    main()
