import pytest
from pyspark.sql import functions as F

from lectern import model
from lectern.functions import answers as an
from lectern.functions import intents as it
from lectern.plans import retrieval as ret



@pytest.mark.parametrize("text, want", [
    ("ab", "SMALL_TALK"), ("Hi", "SMALL_TALK"), ("Hello", "GREETING"), ("xin chàohi", "GREETING"), ("hi bạn", "RAG"), ("Cảm ơn nhé", "THANKS"),
    ("sai rồi", "CORRECTION"), ("ngành nào", "MAJOR"), ("học phần nào có tín chỉ", "CREDIT"), ("thuộc khoa gì", "FACULTY"),
])
def test_router(one, text, want):
    assert one(it.router_intent(F.col("a")), a=text) == want


@pytest.mark.parametrize("text, want, by_words", [
    ("bao nhiêu tín chỉ", "GREETING", "CREDIT"), ("hi", "GREETING", "GREETING"),
    ("môn học trước", "PREREQUISITE", "PREREQUISITE"), ("thạc sĩ", "FURTHER_STUDY", "FURTHER_STUDY"), ("abc", "GENERAL", "GENERAL"),
])
def test_retrieval_intent(one, text, want, by_words):
    assert one(it.retrieval_intent(F.col("a")), a=text) == want
    assert one(it.retrieval_intent(F.col("a"), whole_words=True), a=text) == by_words


def test_entity(one):
    assert one(it.entity(F.col("a")), a="Môn CT178 là gì") == "ct178"
    assert one(it.entity(F.col("a")), a="Môn Toán") == "Môn Toán"
    assert one(it.entity_intent(F.col("a")), a="Học phí và tín chỉ") == "tuition"


@pytest.mark.parametrize("question, rewrite, want", [
    ("môn này", " rõ hơn ", "rõ hơn"), ("môn này", "Nó bao gồm x", "môn này"), ("abc", "dài hơn", "abc"), ("môn này", None, "môn này"),
])
def test_rewrite_guard(spark, question, rewrite, want):
    row = spark.createDataFrame([(question, rewrite)], "q string, r string")
    assert row.select(it.guarded_rewrite(F.col("q"), F.col("r"))).first()[0] == want


def test_corrections_are_followed_on_request_only(spark):
    row = spark.createDataFrame([("sai rồi", "câu trước")], "q string, p string")
    args = (F.col("q"), F.lit("CORRECTION"), F.lit(None).cast("string"), F.col("p"))
    assert row.select(it.effective_question(*args)).first()[0] == "sai rồi"
    assert row.select(it.effective_question(*args, follow_corrections=True)).first()[0] == "câu trước"


@pytest.fixture(scope="module")
def graph(spark):
    course = lambda i, name, credits: ("HocPhan", i, None, {"ten_hp": name, "ma_hp": i, "so_tin_chi": credits}, "d", [1])
    nodes = spark.createDataFrame([
        course("CT1", "Môn học trước: Toán", "3"), course("CT2", "Số tín chỉ Toán", "4"), course("CT3", "Giải tích", "2"),
        course("CT4", "Đại số", "2"), course("CT0", "Môn học trước: Toán", "9"),
    ], model.NODES)
    edge = lambda s, t: (s, "YEU_CAU_TIEN_QUYET", t, {}, "d", [1])
    edges = spark.createDataFrame([edge("CT1", "CT4"), edge("CT1", "CT3"), edge("CT2", "CT3")], model.EDGES)
    corpus = spark.createDataFrame([(1, "gần", [1.0, 0.0]), (2, "hơi gần", [1.0, 0.5]), (3, "xa", [-1.0, 0.0])], "id int, text string, vector array<double>")
    return nodes, edges, corpus


def test_contexts(spark, graph):
    questions = spark.createDataFrame([
        (1, "học trước: toán", [0.0, 1.0]), (2, "tín chỉ toán", None), (3, "học gì vậy", [1.0, 0.1]), (4, "hi ad", [1.0, 0.0]),
        (5, "abc", [1.0, 0.0]), (6, "xa lạ kìa", [0.0, -1.0]), (7, " học trước: TOÁN ", None), (8, "tiên quyết CT2", None),
    ], "qid int, text string, vector array<double>")
    found = ret.contexts(questions, *graph)
    got = {r.qid: r.context for r in found.collect()}
    graph_text = "[GRAPH]\nMôn Môn học trước: Toán cần học trước: Giải tích, Đại số"
    assert got == {
        1: graph_text, 2: "[GRAPH]\nMôn Số tín chỉ Toán có 4 tín chỉ", 3: "[VECTOR]\ngần\nhơi gần", 4: None, 5: None, 6: None,
        7: graph_text, 8: None,
    }
    replies = {r.qid: r for r in ret.replies(questions, found).collect()}
    assert replies[5].reply == an.NOT_FOUND_REPLY and replies[1].reply is None
    assert replies[1].system_text.endswith(f"\nDữ liệu:\n{graph_text}\n")


def test_codes_match_on_request(spark, graph):
    nodes, edges, _ = graph
    routed = ret.route(spark.createDataFrame([(1, "tiên quyết CT2")], "qid int, text string"))
    assert ret.graph_answers(routed, nodes, edges).count() == 0
    assert ret.graph_answers(routed, nodes, edges, match_codes=True).first().graph_text == "Môn Số tín chỉ Toán cần học trước: Giải tích"


def test_conversations(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(5)] + [(2, 0, "user", "hello")]
    conv = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    assert {(r.conv_id, r.turn) for r in ret.last_turns(conv).collect()} == {(1, 2), (1, 3), (1, 4), (2, 0)}
    assert {(r.conv_id, r.turn, r.back) for r in ret.rewrite_history(conv).collect()} == {(1, 3, 1), (1, 2, 2), (1, 1, 3)}
    assert {tuple(r) for r in ret.last_messages(conv).collect()} == {(1, "m4", "m3"), (2, "hello", None)}
    ctx = spark.createDataFrame([(1, "dữ liệu")], "conv_id bigint, context string")
    rows = ret.prompt_rows(conv, ctx).where("conv_id = 1").orderBy("position").collect()
    assert [r.role for r in rows] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert "\nDữ liệu:\ndữ liệu\n" in rows[0].content and rows[-1].content == "m4"


def test_nested_prompt(spark):
    request = spark.createDataFrame([("r", [
        (None, "user", [("text", "một")]), (None, "assistant", [("text", "hai")]), (None, "user", [("text", "ba")]),
    ], None)], model.CHAT_REQUEST)
    prompt = request.select(an.prompt(F.col("messages"), F.lit("ba?"), F.lit(None).cast("string"))).first()[0]
    assert [(m.role, m.content) for m in prompt[1:]] == [("user", "một"), ("assistant", "hai"), ("user", "ba?")]


def test_last_turns_limit_before_the_shuffle(spark):
    conv = spark.range(100).selectExpr("id % 3 as conv_id", "id as turn", "'user' as role", "'x' as text")
    plan = ret.last_turns(conv)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1
