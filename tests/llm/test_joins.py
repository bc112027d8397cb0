"""Joins of tables that grow with the documents."""

from hearthline.llm import components, jaccard


def test_near_duplicates_send_no_table_through_the_driver(spark, monkeypatch):
    """Tables are far below the limit for broadcasts here, as a compressed table of many rows may be."""
    plans, plain = [], jaccard.stored

    def stored(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return plain(df, label)

    monkeypatch.setattr(jaccard, "stored", stored)
    monkeypatch.setattr(components, "stored", stored)
    words = "red blue green stone river house small large north south east west".split()
    rows = [(i, " ".join(words[j % 12] + str((i // 3) * 7 + j) for j in range(30)) + (" x" if i % 3 else "")) for i in range(30)]
    out = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    plans.append(("result", out._jdf.queryExecution().executedPlan().toString()))
    assert out.select("group").distinct().count() == 10 and len(plans) > 10
    assert [label for label, plan in plans if "BroadcastHashJoin" in plan] == []
