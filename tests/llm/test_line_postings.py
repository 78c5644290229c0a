"""What line dedup shuffles for each token of a line's prefix."""

import re

from folioscript.llm import line_dedup


def test_postings_are_shuffled_without_a_copy_of_themselves(spark, monkeypatch):
    plans = {}

    def kept(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return cut(df, label)

    cut = line_dedup.cut_lineage
    monkeypatch.setattr(line_dedup, "cut_lineage", kept)
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "x\na b c d e f g h i j")], "doc_id long, text string")
    assert [(r["of_doc"], r["of_line"]) for row in line_dedup.removed_lines(docs).collect() for r in row["removed"]] == [(1, 0)]
    plan = plans["postings"]
    deals = [m.start() for m in re.finditer(r"Exchange hashpartitioning\(token#", plan)]
    assert len(deals) == 1 and "struct(doc_id" in plan[: deals[0]]
    below = plan[deals[0] : plan.index("hashpartitioning(sid#")]
    assert "struct(doc_id, doc_id" not in re.sub(r"functions=\[.*", "", below)
