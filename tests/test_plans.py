"""Plan-shape regression tests: the properties the scale design relies on."""

import re

from fixture_paths import SF001
from wordloom.plans.catalog import QUERIES


def _initial_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_words_plan(spark):
    plan = _initial_plan(QUERIES["c4_top_words"](spark, SF001))
    assert "WindowGroupLimit" in plan          # top-k limited before the shuffle
    assert "INSET" in plan                      # stop words: a set filter, no join
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan  # filter reaches the scan


def test_ngrams_need_no_window_or_join(spark):
    plan = _initial_plan(QUERIES["c17_fourgram_counts"](spark, SF001))
    assert "Window" not in plan and "Join" not in plan


def test_global_top_k_is_limited_per_partition(spark):
    plan = _initial_plan(QUERIES["w4_top_words_one_group"](spark, SF001))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_tf_idf_reuses_the_count_shuffle(spark):
    df = QUERIES["a11_tf_idf"](spark, SF001)
    plan = _final_plan(df)
    assert "ReusedExchange" in plan
    assert "Window" not in plan                 # totals are aggregates, not group windows


def test_ratings_join_documents_not_tokens(spark):
    plan = _initial_plan(QUERIES["c13_doc_sentiment"](spark, SF001))
    gen = plan.index("Generate explode(regexp_extract_all")
    # the labels join sits below the tokenizer in the tree (printed after it)
    assert plan.find("Join", gen) > gen


def test_lexicon_is_joined_to_counts(spark):
    for name in ("c5_sentiment_words", "c13_doc_sentiment"):
        plan = _initial_plan(QUERIES[name](spark, SF001))
        gen = plan.index("Generate explode(regexp_extract_all")
        # above the tokenizer (printed before it) the tokens are counted, then joined
        assert 0 < plan.index("Join") < plan.rindex("partial_count(1)", 0, gen) < gen, name


def test_language_texts_are_tokenised_once(spark):
    plan = _final_plan(QUERIES["x4_language_id"](spark, SF001)).split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("Generate explode(regexp_extract_all") == 1
    assert "ReusedExchange" in plan


def test_correlograms_tokenise_once(spark):
    for name in ("c2_correlogram", "c3_cor_test"):
        plan = _final_plan(QUERIES[name](spark, SF001)).split("== Initial Plan ==")[0]
        # c2 reads the counts of its subquery, whose plan is printed apart
        assert plan.count("Generate explode(regexp_extract_all") <= 1, name
        assert "ReusedExchange" in plan, name


def test_phi_branches_filter_the_counts_not_the_documents(spark):
    for name in ("m2_cor_anchor_top", "c19_pairwise_cor"):
        plan = _initial_plan(QUERIES[name](spark, SF001))
        scans = set(re.findall(r"PushedFilters: \[[^\]]*\]", plan))
        # scans with filters of their own would each tokenise the texts anew
        assert scans == {"PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]"}, name
