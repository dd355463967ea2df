"""Questions of the catalog that no SQL cuts."""

from notelake import catalog_serving
from notelake.plans import answer


def test_answer_contexts_ask_whole_items(spark, sf_dir, monkeypatch):
    real, asked = answer.answer_context, []

    def spy(index, questions, *rest):
        asked.extend(questions.select("query_id", "text").collect())
        return real(index, questions, *rest)

    monkeypatch.setattr(answer, "answer_context", spy)
    out = catalog_serving.answer_contexts(spark, sf_dir).collect()
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    assert asked and all(r["text"] == items[r["query_id"]] for r in asked)
    assert {r["query_id"] for r in out} == {r["query_id"] for r in asked}
