"""Every line of a comma-delimited file is parsed whole, quotes and all."""

import csv
from collections import defaultdict

from draftloom.plans import feeds


def test_quotes_short_and_long_lines(spark):
    from draftloom.sources import readers

    lines = {
        1: ["﻿id,\"full, name\",n", 'ESPN:4,"Doe, ""J"" ;",3', "00-1,,", "00-2", "x,y,z,beyond", "id,\"full, name\",n", "", "# note", '"",|,9'],
        2: ["id;name;n", "00-1;a,b,c;2"],
        3: ['{"id": "1,2,3"}', '{"id": "4,5"}'],
        4: ["only", "1,2"],
    }
    df = spark.createDataFrame([(f, i + 1, x) for f, ls in lines.items() for i, x in enumerate(ls)], "file_id long, line_no int, line string")
    got = {(r["file_id"], r["line_no"]): (r["names"], r["cells"]) for r in readers.csv_records(df).collect()}
    names = ["id", "full, name", "n"]
    assert got == {
        (1, 2): (names, ["ESPN:4", 'Doe, "J" ;', "3"]),
        (1, 3): (names, ["00-1", None, None]),
        (1, 4): (names, ["00-2", None, None]),
        (1, 5): (names, ["x", "y", "z", "beyond"]),
        (1, 9): (names, [None, "|", "9"]),
    }


def test_no_line_is_left_out(spark, sf_dir):
    files, want = defaultdict(list), {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/stats_file_lines.parquet").collect(), key=lambda r: (r["file_id"], r["line_no"])):
        if r["line"] and r["line"].strip("﻿ ") and not r["line"].lstrip("﻿").startswith("#"):
            files[r["file_id"]].append((r["line_no"], r["line"].lstrip("﻿")))
    for f, lines in files.items():
        head = lines[0][1]
        if head.lstrip()[:1] != "{" and head.count(",") > max(head.count(x) for x in ";|\t"):
            want |= {(f, n): [x or None for x in next(csv.reader([line]))] for n, line in lines if line != head}
    got = {(r["file_id"], r["line_no"]): r["cells"] for r in feeds.QUERIES["csv_records"](spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    trim = lambda xs: xs[: max([i + 1 for i, x in enumerate(xs) if x is not None], default=0)]
    assert all(trim(got[k]) == trim(want[k]) for k in want) and any(not v[0].startswith("00-") for v in got.values() if v[0])
