"""Language profiles, graph helpers, sentiment helpers, label helpers."""

from pyspark.sql import functions as F

from wordloom.functions.text import percent_label, round_half_even
from wordloom.operators import graph, language, sentiment


def test_char_grams_of_one_word(spark):
    df = spark.createDataFrame([("k", "ab", 2)], "k string, w string, c long")
    grams = {r.gram: r.cnt for r in language.char_grams(df, ["k"]).collect()}
    # "_ab_": 1-grams _ a b _, 2-grams _a ab b_, 3-grams _ab ab_
    assert grams == {"_": 4, "a": 2, "b": 2, "_a": 2, "ab": 2, "b_": 2, "_ab": 2, "ab_": 2}


def test_profiles_rank_and_classify(spark):
    train = spark.createDataFrame(
        [("en", "the cat and the dog with the hat"), ("en", "this is the thing that they think"),
         ("fr", "le chat et le chien avec le chapeau"), ("fr", "les enfants et les parents du quartier")],
        "lang string, text string")
    prof = language.train(train, top=50)
    ranks = [r.pr for r in prof.where("lang = 'en'").orderBy("pr").collect()]
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == 50
    test = spark.createDataFrame([(1, "the other thing with the hat"), (2, "le quartier et les chiens"),
                                  (3, "")], "id int, text string")
    pred = {r.id: r.predicted for r in language.classify(test, prof, "id", top=50).collect()}
    assert pred == {1: "en", 2: "fr"}  # a text without tokens has no row


def test_graph_helpers(spark):
    counts = spark.createDataFrame([("a", "b", 5), ("b", "c", 3), ("a", "c", 1)], "word1 string, word2 string, n long")
    edges, vertices = graph.graph_from_edges(counts)
    assert edges.columns == ["from", "to", "n"]
    assert sorted(r.name for r in vertices.collect()) == ["a", "b", "c"]
    deg = {r.name: (r.out_degree, r.in_degree) for r in graph.degrees(edges).collect()}
    assert deg == {"a": (2, 0), "b": (1, 1), "c": (0, 2)}
    s = graph.summary(edges).collect()[0]
    assert (s.vertices, s.edges) == (3, 3)


def test_one_graph_per_group(spark):
    counts = spark.createDataFrame([("g", "a", "b", 5), ("g", "b", "c", 3), ("h", "a", "b", 1)],
                                   "grp string, word1 string, word2 string, n long")
    edges, vertices = graph.graph_from_edges(counts, group=["grp"])
    assert edges.columns == ["grp", "from", "to", "n"]
    assert sorted(map(tuple, vertices.collect())) == [("g", "a"), ("g", "b"), ("g", "c"), ("h", "a"), ("h", "b")]
    deg = {(r.grp, r.name): (r.out_degree, r.in_degree) for r in graph.degrees(edges, ["grp"]).collect()}
    assert deg[("g", "b")] == (1, 1) and deg[("h", "a")] == (1, 0)
    assert {r.grp: (r.vertices, r.edges) for r in graph.summary(edges, ["grp"]).collect()} == {"g": (3, 2), "h": (2, 1)}
    none = graph.summary(edges.where("false")).collect()
    assert [tuple(r) for r in none] == [(0, 0)]


def test_words_of_negative_documents(spark):
    toks = spark.createDataFrame([(1, "g", "bad"), (1, "g", "oak"), (1, "g", "oak"), (2, "g", "good"), (2, "g", "oak"),
                                  (3, "h", "bad"), (3, "h", "good"), (4, "h", "oak")], "doc int, grp string, word string")
    values = spark.createDataFrame([("good", 3), ("bad", -2)], "word string, value int")
    got = {(r.grp, r.word): r.n for r in sentiment.words_of_negative(toks, values, "doc", ["grp"]).collect()}
    assert got == {("g", "bad"): 1, ("g", "oak"): 2}  # 3 scores above zero, 4 has no score


def test_label_counts_with_a_repeated_lexicon_row(spark):
    toks = spark.createDataFrame([("g", "good"), ("g", "good"), ("g", "bad")], "grp string, word string")
    lex = spark.createDataFrame([("good", "positive"), ("good", "positive"), ("good", "trust")],
                                "word string, sentiment string")
    got = {(r.word, r.sentiment): r.n for r in sentiment.label_counts(toks, lex, ["grp"]).collect()}
    assert got == {("good", "positive"): 4, ("good", "trust"): 2}


def test_sentiment_helpers(spark):
    toks = spark.createDataFrame([(1, "g", "good"), (1, "g", "bad"), (1, "g", "good"), (2, "g", "meh"),
                                  (3, "h", "bad")], "doc int, grp string, word string")
    values = spark.createDataFrame([("good", 3), ("bad", -2)], "word string, value int")
    scores = {r.doc: r.sentiment for r in sentiment.doc_scores(toks, values, "doc").collect()}
    assert scores == {1: 4, 3: -2}  # a document without lexicon words has no row
    nrc = spark.createDataFrame([("good", "positive"), ("good", "trust"), ("bad", "negative")],
                                "word string, sentiment string")
    vocab = {(r.grp, r.sentiment): r.n for r in sentiment.vocabulary_by_label(toks, nrc, ["grp"]).collect()}
    assert vocab == {("g", "positive"): 1, ("g", "trust"): 1, ("g", "negative"): 1, ("h", "negative"): 1}
    bigrams = spark.createDataFrame([("not", "good"), ("not", "good"), ("not", "bad"), ("so", "good")],
                                    "word1 string, word2 string")
    neg = {r.word2: (r.n, r.contribution, r.sign)
           for r in sentiment.negated_contributions(bigrams, ["not"], values, k=20).collect()}
    assert neg == {"good": (2, 6, "positive"), "bad": (1, -2, "negative")}


def test_label_helpers(spark):
    df = spark.createDataFrame([(0.125, 0.0123)], "x double, s double")
    r = df.select(round_half_even("x", 2).alias("b"), F.round("x", 2).alias("h"),
                  percent_label("s").alias("p")).collect()[0]
    assert (r.b, r.h, r.p) == (0.12, 0.13, "1.23%")
    none = spark.createDataFrame([(None,)], "s double").select(percent_label("s").alias("p")).collect()[0]
    assert none.p is None


def test_text_profiles_equal_the_ranked_grams(spark):
    rows = [(1, "Ein Haus, ein Baum"), (1, "ein Haus"), (2, "été à l’école \U00010348\U00010348x ￮"), (None, "x y_z"), (3, "  "),
            (4, " ".join(f"w{k * k}" for k in range(300)))]
    df = spark.createDataFrame(rows, "k int, text string")
    counted = language.token_counts(df, ["k"])
    for top in (5, 400):
        want = language.ranked(language.char_grams(counted, ["k"]), ["k"], top, "r", with_size="_n")
        out = language.text_profiles(counted, "k", top)
        got = sorted(map(repr, out.select("k", "gram", "r", "_n").collect()))
        assert got == sorted(map(repr, want.select("k", "gram", "r", "_n").collect())) and len(got) >= 20
    # a row a text leaves the counts: no gram is shuffled or sorted
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.index("Generate posexplode") < plan.index("MapInArrow") < plan.index("Exchange")
