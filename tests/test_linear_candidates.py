"""Level-1 linear models on leaf codes."""

from tierblend.catalog import modelling


def test_linear_candidates_try_all_published_penalties():
    assert {c.name: c.grid["C"] for c in modelling._linear_candidates()} == {
        n: [0.01, 0.1, 1.0, 10.0, 100.0] for n in ("leaf_lr_l2", "leaf_lr_l1", "leaf_svm_l2", "leaf_svm_l1")}
