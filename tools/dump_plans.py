"""Write PLANS.md: the physical plan tree of each headline query.

    python tools/dump_plans.py [sf_dir]

Plans are taken before execution (AQE may still re-plan at runtime: coalesce
partitions, split skewed join partitions, turn a sort-merge join into a
broadcast join once a side's measured size is small).
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusgrid.plans.catalog import QUERIES  # noqa: E402
from corpusgrid.session import get_spark  # noqa: E402

NAMES = ["article_specificity", "top_specific_articles", "scored_scan", "split_tail", "negative_pairs",
         "vocabulary", "encode_sequences", "nearest_neighbors", "v_measure", "parse_articles"]


def tree(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain()
    lines = [ln for ln in buf.getvalue().splitlines() if ln.strip() and not ln.startswith("==")]
    out = []
    for ln in lines:
        ln = re.sub(r"#\d+L?", "", ln)
        ln = re.sub(r"\[plan_id=\d+\]", "", ln)
        ln = re.sub(r"(Location: \w+)\([^)]*\)\[[^\]]*\]", r"\1[...]", ln)
        out.append(ln[:170])
    return "\n".join(out)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark(shuffle_partitions=16)
    parts = ["# Physical plans of the headline queries\n",
             f"Generated by `tools/dump_plans.py` on `{sf_dir}` (local[8], 16 shuffle partitions). "
             "Plans are shown before execution; AQE re-plans at runtime from measured sizes. Queries whose "
             "operator runs intermediate jobs (cut keys, global rank, vocabulary collect) show the final "
             "plan, whose leaves read the intermediates written under the checkpoint folder.\n"]
    for n in NAMES:
        parts.append(f"## {n}\n\n```\n{tree(QUERIES[n](spark, sf_dir))}\n```\n")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(parts))


if __name__ == "__main__":
    main()
