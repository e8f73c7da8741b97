"""Copies of queries and titles that a word of many pairs makes."""

from lexquarry.operators import forms as M


def shuffled(frame):
    """Rows written by the two exchanges below the join of the collected frame."""
    frame.collect()
    found, todo = [], [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec":
                found.append(node.metrics().apply("shuffleRecordsWritten").value())
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return sum(found)


def test_cells_of_a_common_word_are_square(spark, monkeypatch):
    """200 queries and 200 titles share a word: 100 cells of 400 pairs."""
    monkeypatch.setattr(M, "CELL_PAIRS", 400)
    asked = spark.createDataFrame([(i, "court") for i in range(200)], "query_id long, word string")
    titles = spark.createDataFrame([(i, "court") for i in range(200)], "form_number int, word string")
    met = M._meet(asked, titles, ["word"], "query_id", 3)
    assert met.count() == met.distinct().count() == 200 * 200
    assert shuffled(met) <= 5000
