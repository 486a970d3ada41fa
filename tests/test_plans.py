"""Plans: filters and columns reach the scan, small sides are broadcast, nothing is crossed by accident."""

import pytest

from tessitura.plans import registry

QUERIES = registry()[0]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned(spark, sf):
    p = plan(QUERIES["feedback_scan"](spark, sf))
    assert "PushedFilters: [In(event_type" in p
    assert "value" not in p.split("ReadSchema: ")[1].split(">")[0]


@pytest.mark.parametrize("name", ["interaction_frame", "bandit_posterior", "dislike_counts", "status_counts"])
def test_aggregates_combine_before_the_shuffle(name, spark, sf):
    assert "partial_" in plan(QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", ["leave_last_n", "emotion_now", "genre_cap"])
def test_top_n_windows_are_cut_before_the_shuffle(name, spark, sf):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", ["interaction_frame", "cooccurrence", "item_knn", "markov", "taste_edges", "blend_score", "hard_rules"])
def test_no_cross_joins(name, spark, sf):
    p = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"als_topk", "als_exact_topk", "svd_topk", "ncf_topk", "rec_items", "item2vec_nn", "two_tower_topk", "fm_topk", "sequence_score", "blender_weights", "mmr_topk", "thompson_topk", "recommend_all", "audio_features", "stream_online_users", "stream_bandit", "stream_dislikes", "stream_windows"}))
def test_stays_in_the_jvm(name, spark, sf):
    p = plan(QUERIES[name](spark, sf))
    assert not any(x in p for x in ("Python", "Pandas", "InArrow"))


def test_bloom_test_does_not_shuffle_rows(spark, sf):
    """The filter's one row is broadcast; words combine before they are shuffled."""
    from tessitura.operators import catalog as C
    from tessitura.sources.star import Star

    rows = Star(spark, sf).raw("part").selectExpr("cast(p_partkey as string) as song_id")
    bits = C.bloom_filter(rows)
    assert "BroadcastNestedLoopJoin" in (p := plan(C.bloom_unseen(rows, bits))) and "LeftSemi" in p
    # with the filter stored, nothing of the tested side moves
    from tessitura.sources.scratch import materialize

    stored = materialize(bits, "bloom")
    assert "Exchange hashpartitioning" not in plan(C.bloom_unseen(rows, stored)) and "partial_bit_or" in plan(bits) and len(stored.first()["bits"]) == -(-2_000_003 // 64)
