"""Write PLANS.md: the physical operator tree of every registered query (formatted explain, condensed).

Usage: python tools/plan_report.py [--sf-dir DIR] [--out PLANS.md]
"""

from __future__ import annotations

import argparse
import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEEP = re.compile(r"^[\s:+\-|]*(\*\(\d+\) )?[A-Z][A-Za-z]*( [A-Za-z]+)*\s+\(\d+\)")


def condensed(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    tree = [ln.rstrip() for ln in text.split("\n\n", 1)[0].splitlines() if KEEP.match(ln)]
    schemas = sorted(set(re.findall(r"ReadSchema: (struct<[^\n]*>)", text)))
    out = "\n".join(tree)
    if schemas:
        out += "\n" + "\n".join(f"ReadSchema: {s}" for s in schemas)
    return out


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--out", default=os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                                                  "PLANS.md"))
    args = ap.parse_args()
    from sitegraph.plans.catalog import QUERIES
    from sitegraph.session import local_session

    spark = local_session()
    parts = ["# Physical plans\n",
             f"Generated by `tools/plan_report.py` at `{args.sf_dir}` (AQE decides the final join strategy "
             "at run time; these are the plans before execution). Iterative queries show the plan of their "
             "final step over checkpointed levels.\n"]
    for key, fn in QUERIES.items():
        parts.append(f"## {key}\n\n```\n{condensed(fn(spark, args.sf_dir))}\n```\n")
    with open(args.out, "w") as f:
        f.write("\n".join(parts))
    print(f"wrote {args.out}")


if __name__ == "__main__":
    main()
