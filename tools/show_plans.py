"""Write PLANS.md: physical plans of representative operators at a given scale factor.

usage: python tools/show_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from pyspark.sql import functions as F

    from oddone.catalog import load_all
    from oddone.catalog.fixtures import answers, items
    from oddone.functions.prompts import add_suffix
    from oddone.operators.embedding import item_index, map_lenient
    from oddone.operators.sampling import _attempts, _draw_phase
    from oddone.operators.vectors import candidates, first_vector
    from oddone.session import get_spark

    spark = get_spark("local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    reg = load_all()
    it = items(spark, sf)
    cand = candidates(it, first_vector(it)).select("pos", "key", "vec").checkpoint()
    n = cand.count()
    cb = F.broadcast(cand)
    att = _attempts(spark, cb, n, 0, 35000, 42)
    a = answers(spark, sf)
    shown = {
        "draw phase (8 draws per attempt)": _draw_phase(att, cb, n, 42, 8, 1.35, 1.45, True),
        "triplet mapping (lenient, per run)": map_lenient(a, item_index(a, "run"), "run"),
        "train/test split (lineitem)": reg["train_test_split"][0](spark, sf),
        "gradient sums (STE)": reg["triplet_grad_step"][0](spark, sf),
        "answer choice (lineitem log-probs)": reg["logprob_choice"][0](spark, sf),
        "manifest resolved by its batteries": reg["manifest_resolve"][0](spark, sf),
        "answers read by a manifest": reg["answers_by_manifest"][0](spark, sf),
        "prompt text for scoring": reg["render_prompt"][0](spark, sf).select(add_suffix("format_str", "Answer: ")),
    }
    out = ["# Physical plans", "", f"Generated by `tools/show_plans.py` at `{sf}` on local[8] "
           "(16 shuffle partitions, AQE on). Initial plans; AQE may coalesce partitions or switch joins at run time.", ""]
    for title, df in shown.items():
        out += [f"## {title}", "", "```", df._jdf.queryExecution().executedPlan().toString().strip(), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
