from pyspark.sql import functions as F

from verselake.functions import text as T


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first().y


def test_gate_truth_table(spark):
    rows = [
        ("字幕由 Amara 社群提供", None, 0.5, True),
        ("歡迎訂閱，按讚分享！", None, 0.5, False),
        ("歡迎訂閱，按讚分享！", 0.9, 0.5, True),
        ("歡迎訂閱，按讚分享！", None, 0.001, True),
        ("hello", 0.9, 0.001, True),
        ("hello", 0.9, 0.5, False),
        ("hello", None, 0.001, False),
        (None, None, None, False),
    ]
    df = spark.createDataFrame(rows, "t string, p double, r double, want boolean")
    assert all(r.got == r.want for r in df.select("want", T.should_drop("t", "p", "r", 0.6, 0.008).alias("got")).collect())


def test_scoring_and_gloss(spark):
    assert one(spark, "Hello, World!", T.score_normalize("x")) == "helloworld"
    assert one(spark, "Hello, World!", F.array_join(T.score_tokens("x"), "|")) == "hello|world"
    assert one(spark, "大武（Tāi-bú）", T.strip_gloss("x")) == "大武"
    assert one(spark, " (abc) ", T.strip_gloss("x")) == "(abc)"
    assert one(spark, "漢字(かんじ)です", T.strip_furigana("x")) == "漢字です"


def test_training_text(spark):
    df = spark.createDataFrame([("[Chorus] 大武(Tāi-bú) 山", "nan"), ("(Tāi-bú)", "nan"), ("ＡＢＣ　def", "en")], "x string, l string")
    assert [r.y for r in df.select(T.training_normalize("x", "l").alias("y")).collect()] == ["大武 山", "(Tāi-bú)", "ABC def"]


def test_sentences_titles_ids(spark):
    assert one(spark, "一。二!？ three\nfour", F.array_join(T.sentences("x"), "|")) == "一。|二!？|three|four"
    assert one(spark, None, F.size(T.sentences("x"))) == 0
    assert one(spark, "\n  \n a b \nc", T.first_line("x")) == "a b"
    assert one(spark, "..a b/c..", T.sanitize_id("x")) == "a_b_c"
    assert [one(spark, v, T.safe_id("x")) for v in ("a", "", "a/b", "..", "a\\b")] == [True, False, False, False, False]
    assert one(spark, "Crème Brûlée 好!", T.slug(F.col("x"))) == "creme-brulee"
    assert one(spark, 75.26, T.clock("x"), "double") == "01:15.2"


def test_snippet(spark):
    body = "abcdefghijklmnopqrstuvwxyz0123456789"
    assert one(spark, body, T.snippet("x", "q")) == "…efghijklmnop[q]rstuvwxyz012…"
    assert one(spark, body, T.snippet("x", "Q")) == body[:48]
    assert one(spark, body, T.snippet("x", "a")) == "[a]bcdefghijklm…"


def test_replacement_order(spark):
    assert one(spark, "abc ab", T.replace_longest_first("x", [("ab", "1"), ("abc", "ab")])) == "1 1"


def test_novel_part():
    assert T.novel_part("", "  a  b ") == "a b"
    assert T.novel_part("我們今天", "今天天氣") == "天氣"
    assert T.novel_part("hello wonderful", "Wonderful world") == "world"
    assert T.novel_part("我們今天", "今天", None) == ""
    assert T.novel_part("我們今天", "今天", 0) == " 今天"
    assert T.novel_part("short", "other") == " other"
