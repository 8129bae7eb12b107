"""Compare queries with their SQL from the command line: ``python tests/check.py [folder] [name ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls = entry.oracle_sql()
    failures = 0
    for name, run in entry.queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in sqls:
                problem = compare(df, con, sqls[name])
                note = problem or f"equal, {len(con.execute(sqls[name]).fetchall())} rows"
            else:
                note, problem = f"{df.count()} rows, no SQL", None
        except Exception as error:  # report and go on with the next query
            note = problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failures += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {note}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
