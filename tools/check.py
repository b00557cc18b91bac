"""Compare registered queries with their SQL: python tools/check.py [-d folder] [names or prefixes]"""

import sys
import time

sys.path[:0] = ["/root/repo", "/root/repo/tests"]

from compare import compare, duck  # noqa: E402

from geoloom.catalog import load  # noqa: E402
from geoloom.session import local_session  # noqa: E402

args = sys.argv[1:]
folder = "/root/testdata/sf0.01"
if args[:1] == ["-d"]:
    folder, args = args[1], args[2:]
spark = local_session()
spark.sparkContext.setLogLevel("ERROR")
con = duck(folder)
bad = 0
for name in load():
    if args and name not in args:
        continue
    t = time.time()
    try:
        problems = compare(spark, con, name, folder)
    except Exception as err:  # report and go on
        problems = [f"{type(err).__name__}: {str(err)[:1500]}"]
    bad += bool(problems)
    note = "" if load()[name].sql else " (rows only)"
    print(f"{'BAD ' if problems else 'ok  '} {name} {time.time() - t:.1f}s{note}", *problems, sep="\n      " if problems else " ", flush=True)
print("bad:", bad)
