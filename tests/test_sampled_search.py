"""The sampled search tries and ranks every published trial."""

from tierblend.catalog import modelling
from tierblend.plans import search


def test_sampled_search_draws_and_ranks_all_published_trials(spark, sf, monkeypatch):
    seen = {}

    def quick(learner, table, configs, metric="auc"):
        seen["configs"] = configs
        made = [(i, f, "auc", 0.5 + i / 1000) for i in range(len(configs)) for f in range(5)]
        return search.SearchResult(list(configs), spark.createDataFrame(made, "cfg int, fold int, metric string, score double"), metric, 0, 0.5)

    monkeypatch.setattr(search, "run_search", quick)
    assert modelling.sampled_search(spark, sf).count() == 201 == len(seen["configs"])
