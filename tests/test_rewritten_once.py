"""Corrected lines are rewritten once, not for their comparison and for their result."""

from quillcheck.operators import corrections


def test_texts_are_rewritten_once(spark):
    rows = spark.createDataFrame([(1, 0, 'он "сказал"  тут'), (1, 1, "ничего"), (1, 2, None)], "doc_id long, para_ix int, text string")
    every = [p for gate, _ in corrections.REWRITES for p in gate] + ["paragraph_edge_spaces"]
    lines = corrections.corrected_lines(rows, every)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<...>") == 1
    assert [tuple(r) for r in lines.collect()] == [(1, 0, 'он "сказал"  тут', "он «сказал» тут")]
