"""Only documents with a mail address are cut into words."""

from maskwright.operators import training as Tr
from maskwright.plans import more


def test_words_of_documents_with_addresses_only(spark, tmp_path, monkeypatch):
    texts = ["to ann@example.org and bob@example.org, please", "no address here", "an @ alone", "", None, "eve@example.org"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    seen, cut = [], Tr.token_rows
    monkeypatch.setattr(Tr, "token_rows", lambda docs, **options: seen.append(docs) or cut(docs, **options))
    rows = more.email_words(spark, str(tmp_path))
    assert sorted(tuple(r) for r in rows.collect()) == [(0, 3, 1, 1), (0, 23, 3, 3), (5, 0, 0, 0)]
    assert sorted(r.doc_id for d in seen for r in d.collect()) == [0, 5]


def test_words_are_not_sorted_unless_asked_for(spark):
    rows = Tr.token_rows(spark.createDataFrame([(1, "a bb  ccc")], "doc_id long, text string"))
    assert [(r.k, r.start, r.end, r.value) for r in rows.orderBy("k").collect()] == [(0, 0, 1, "a"), (1, 2, 4, "bb"), (2, 6, 9, "ccc")]
    plan = rows.select("doc_id", "k", "start", "end")._jdf.queryExecution().optimizedPlan().toString()
    window = plan.split("Window")[1].split("Generate")[0]
    assert "value" not in window and "word" not in window.replace("x#", "").split("Project")[0]
