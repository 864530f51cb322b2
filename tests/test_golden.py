"""Golden cases of FIXTURES.md (docstring examples and hand-traced edges)."""


from tessera.functions import arrays as A
from tessera.functions import overlap as O
from tessera.functions import text as T
from tessera.operators import lmprep as L
from tessera.operators import metrics as M
from tessera.operators import ngrams as N
from tessera.operators import ordinals as Od
from tessera.operators import words as Wd


def test_multi_hot_truth_docstring(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([[2], [1, 3], [9], [3, 5, 7]])], "i int, y array<int>")
    got = [r[0] for r in df.orderBy("i").select(A.multi_hot("y", 9)).collect()]
    assert got == [[0, 0, 1, 0, 0, 0, 0, 0, 0, 0], [0, 1, 0, 1, 0, 0, 0, 0, 0, 0],
                   [0, 0, 0, 0, 0, 0, 0, 0, 0, 1], [0, 0, 0, 1, 0, 1, 0, 1, 0, 0]]


def test_multi_hot_union_of_topk(spark):
    df = spark.createDataFrame([([[1], [], [3, 1]],)], "y array<array<int>>")
    assert df.select(A.multi_hot_union("y", 4)).first()[0] == [0, 1, 0, 1, 0]


def test_distinct_sets_docstring(spark):
    df = spark.createDataFrame([([[7], [7], [], [1, 7], [], [7], [], [], [1], []],)], "s array<array<int>>")
    got = df.select(A.distinct_sets("s")).first()[0]
    assert sorted(map(tuple, got)) == sorted([(), (1,), (7,), (1, 7)])


def test_repeated_labels_count_once(spark):
    from tessera.operators.lookup import classes_of
    seqs = spark.createDataFrame([(1, ["w1", "w1", "##w1", "w2"])], "k int, words array<string>")
    wc = spark.createDataFrame([("w1", 3), ("w2", 3)], "word string, class_id int")
    assert classes_of(seqs, ["k"], wc).first()["classes"] == [3]


def test_candidate_without_class_keeps_empty_set(spark):
    from tessera.operators.lookup import classes_of
    seqs = spark.createDataFrame([(1, ["zz"]), (2, [])], "k int, words array<string>")
    wc = spark.createDataFrame([("w1", 3)], "word string, class_id int")
    got = {r["k"]: r["classes"] for r in classes_of(seqs, ["k"], wc).collect()}
    assert got == {1: [], 2: []}


def _tokens(spark, rows):
    return spark.createDataFrame([(1, i, t, p) for i, (t, p) in enumerate(rows)],
                                 "k int, pos int, token string, prob double")


def test_word_merge(spark):
    w = Wd.merge_pieces(_tokens(spark, [("a", 0.5), ("##b", 0.5), ("c", 0.9)]), ["k"]).orderBy("word_no").collect()
    assert [(r.word, round(r.prob, 6)) for r in w] == [("a##b", 0.25), ("c", 0.9)]


def test_word_merge_leading_piece(spark):
    w = Wd.merge_pieces(_tokens(spark, [("##x", 0.4), ("y", 0.5)]), ["k"]).orderBy("word_no").collect()
    assert [(r.word, r.prob) for r in w] == [("##x", 0.0), ("y", 0.5)]


def test_week_merge(spark):
    words = spark.createDataFrame([(1, i, w, p) for i, (w, p) in enumerate(
        [("a", 0.5), ("[EOW]", 0.5), ("[3]", 0.4), ("b", 0.9)])], "k int, word_no int, word string, prob double")
    g = Wd.glue_week_tokens(words, ["k"]).orderBy("word_no").collect()
    assert [(r.word, round(r.prob, 6)) for r in g] == [("a", 0.5), ("[EOW][3]", 0.2), ("b", 0.9)]


def test_leading_week_token_stands_alone(spark):
    words = spark.createDataFrame([(1, 0, "[3]", 0.5), (1, 1, "[EOW]", 0.5)], "k int, word_no int, word string, prob double")
    assert [r.word for r in Wd.glue_week_tokens(words, ["k"]).orderBy("word_no").collect()] == ["[3]", "[EOW]"]


def test_char_measures(spark):
    df = spark.createDataFrame([("aab", "ab b", "abb")], "answer string, cand string, ref string")
    r = df.select(O.char_overlap_ratio("answer", "cand").alias("ov"),
                  (O.char_multiset_overlap("answer", "ref") / 3).alias("p")).first()
    assert abs(r.ov - 2 / 3) < 1e-12 and abs(r.p - 2 / 3) < 1e-12


def test_empty_candidate_precision_is_zero(spark):
    c = spark.createDataFrame([(1, [])], "k int, t array<string>")
    r = spark.createDataFrame([(1, ["a"])], "k int, t array<string>")
    assert N.modified_precision(c, r, ["k"], "t").first()["precision"] == 0.0


def test_short_answer_placeholder(spark):
    df = spark.createDataFrame([("x", "[EOW][3] ")], "a string, c string")
    r = df.select(T.answer_or_placeholder("a").alias("a"), T.candidate_or_placeholder("c").alias("c")).first()
    assert r.a == "</>" and r.c == "</>"


def test_chunking(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [])], "k int, ids array<int>")
    got = L.chunk_sequences(df, ["k"], "ids", 2).orderBy("k", "chunk_no").collect()
    assert [r.input_ids for r in got] == [[1, 2], [3, 4], [5]]
    assert all(r.token_type_ids == [0] * len(r.input_ids) for r in got)


def _shard_sizes(spark, n, w):
    df = spark.range(n).withColumnRenamed("id", "k")
    o = Od.row_ordinals(df, ["k"], total_col="n")
    s = o.select(Od.shard_of("rn", "n", w).alias("s")).groupBy("s").count().collect()
    got = {r.s: r["count"] for r in s}
    return [got.get(i, 0) for i in range(w)]


def test_shards(spark):
    assert _shard_sizes(spark, 10, 4) == [2, 2, 2, 4]
    assert _shard_sizes(spark, 3, 4) == [0, 0, 0, 3]


def test_sample_sizes(spark):
    df = spark.range(7).withColumnRenamed("id", "k")
    assert L.sample_exact(df, "k", 0.5).count() == 3
    assert L.sample_exact(df, "k", 0.0).count() == 7


def test_no_predicted_positive_class(spark):
    df = spark.createDataFrame([([0, 1], [0, 0]), ([0, 0], [0, 0])], "y_true_ml array<int>, y_pred_ml array<int>")
    r = {x["class"]: x for x in M.class_report(df).collect()}
    assert r[1].precision == 0.0 and r[1].f1 == 0.0 and r[1].recall == 0.0 and r[1].accuracy == 0.5
