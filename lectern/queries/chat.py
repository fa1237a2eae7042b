"""Conversations: routing, history, contexts, replies, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import intents as it
from ..plans import retrieval as ret
from ..operators.contains import new_index
from ..session import stage, work_folder
from ..streaming.ingest import answer_stream
from .derive import EDGES_SQL, NODES_SQL, stream, table, trade_graph

# Openings that lead each message into one of the routing rules.
OPENINGS = (
    "", "hello", "cảm ơn", "tạm biệt", "Không đúng", "ý tôi là", "bao nhiêu tín chỉ", "môn học", "chương trình đào tạo",
    "ngành", "học phí", "điều kiện", "khoa nào", "môn tiên quyết của CT12", "việc làm", "chuẩn đầu ra", "tại chức",
    "bao lâu", "bộ môn", "văn bằng", "cao học", "HI", "ab",
)


def _messages(spark, d):
    """All turns; an opening chosen by position goes before the text."""
    at = (F.col("conv_id") * 7 + F.col("turn")) % len(OPENINGS)
    opening = F.element_at(F.array(*[F.lit(o) for o in OPENINGS]), (at + 1).cast("int"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", "role",
        # The last two openings stand alone.
        F.when(at >= len(OPENINGS) - 2, opening).otherwise(F.concat_ws(" ", opening, "text")).alias("text"),
    )


def router_intents(spark, d):
    return _messages(spark, d).select("conv_id", "turn", it.router_intent(F.col("text")).alias("intent"))


def retrieval_intents(spark, d):
    text = F.col("text")
    return _messages(spark, d).select(
        "conv_id", "turn", it.retrieval_intent(text).alias("intent"),
        it.retrieval_intent(text, whole_words=True).alias("intent_by_words"),
    )


def entities(spark, d):
    text = F.col("text")
    return _messages(spark, d).where(it.long_enough(text)).select(
        "conv_id", "turn", it.entity_intent(text).alias("intent"), it.entity(text).alias("entity")
    )


def _requests(spark, d):
    last = ret.last_messages(_messages(spark, d))
    return last.withColumn("intent", it.router_intent(F.col("question")))


def effective_questions(spark, d):
    """The proposed rewrite is the previous message; half of them read like answers."""
    question, previous = F.col("question"), F.col("previous")
    rewrite = F.when(F.col("conv_id") % 2 == 0, F.concat(previous, F.lit(" bao gồm"))).otherwise(previous)
    return _requests(spark, d).select(
        "conv_id", "intent",
        it.effective_question(question, F.col("intent"), rewrite).alias("asked"),
        it.effective_question(question, F.col("intent"), rewrite, previous, follow_corrections=True).alias("corrected"),
    )


def history(spark, d):
    return ret.rewrite_history(_messages(spark, d), 3)


def last_messages(spark, d):
    return ret.last_messages(_messages(spark, d))


def prompt_rows(spark, d):
    ctx = _requests(spark, d).select(
        "conv_id", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("[GRAPH]\n"), F.col("intent"))).alias("context")
    )
    return ret.prompt_rows(_messages(spark, d), ctx, "T")


def request_prompts(spark, d):
    """Nested requests: one message list per row in, one prompt list per row out."""
    part = lambda c: F.array(F.struct(F.lit("text").alias("type"), c.alias("text")))
    item = lambda role, c: F.struct(F.lit(None).cast("string").alias("id"), F.lit(role).alias("role"), part(c).alias("parts"))
    pair = _requests(spark, d).withColumn(
        "messages", F.array(item("assistant", F.coalesce("previous", F.lit(""))), item("user", F.col("question")))
    )
    prompt = an.prompt(F.col("messages"), F.col("question"), F.lit(None).cast("string"), "T")
    flat = pair.select("conv_id", F.posexplode(prompt).alias("position", "m"))
    return flat.select("conv_id", "position", "m.role", "m.content")


def _questions(spark, d, part=None):
    """One question per part: what comes before it, its credits, or something else.

    A course is only found when its name holds the entity, so the part names are
    prefixed with the words that set the intent.
    """
    part = table(spark, d, "part") if part is None else part
    name = F.concat_ws(" ", "p_name", "p_brand")
    words = F.element_at(
        F.array(F.lit("học trước"), F.lit("tín chỉ"), F.lit("văn bằng"), F.lit("hello")),
        (F.col("p_partkey") % 4 + 1).cast("int"),
    )
    text = F.when(F.col("p_partkey") % 11 == 0, F.lit("abc")).otherwise(F.concat_ws(" ", words, name))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("p_partkey"), F.col("embedding").alias("vector"))
    return part.select("p_partkey", text.alias("text")).join(vectors, "p_partkey", "left").select(
        F.col("p_partkey").alias("qid"), "text", "vector"
    )


def _knowledge(spark, d):
    nodes, edges = trade_graph(spark, d)
    lead = F.element_at(F.array(F.lit("Học trước"), F.lit("Tín chỉ")), (F.col("seq") % 2 + 1).cast("int"))
    courses = nodes.where("label = 'HocPhan'").withColumn(
        "props", F.create_map(
            F.lit("ten_hp"), F.concat_ws(" ", lead, F.col("props")["ten_hp"]),
            F.lit("ma_hp"), F.col("props")["ma_hp"], F.lit("so_tin_chi"), F.col("props")["so_tin_chi"],
        ))
    corpus = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"),
        F.col("embedding").alias("vector"),
    )
    return courses, edges, corpus


def _stored_knowledge(spark, d):
    """The graph and the courses' name index are stored first, as by ingestion; questions only read them."""
    courses, edges, corpus = _knowledge(spark, d)
    courses, edges = stage(courses, "courses"), stage(edges, "edges")
    return courses, edges, corpus, new_index(spark, ret.courses_of(courses))


def _contexts(spark, d):
    questions, (courses, edges, corpus, index) = _questions(spark, d), _stored_knowledge(spark, d)
    return questions, ret.contexts(questions, courses, edges, corpus, threshold=0.6, index=index)


def contexts(spark, d):
    return _contexts(spark, d)[1].select("qid", "intent", "context")


def replies(spark, d):
    return ret.replies(*_contexts(spark, d), institution="T")


def streamed_contexts(spark, d):
    """The same questions and answers as ``retrieval_contexts``, arriving as a stream."""
    out = work_folder(spark, "question-stream")
    questions = _questions(spark, d, stream(spark, d, "part"))
    courses, edges, corpus, index = _stored_knowledge(spark, d)
    answer_stream(questions, courses, edges, corpus, out=out, threshold=0.6, index=index).awaitTermination()
    return spark.read.parquet(f"{out}/answers").select("qid", "context")


def answers(spark, d):
    """Whole requests. A third of the rewrites name a part, the others are the message before."""
    part = table(spark, d, "part").select(
        F.col("p_partkey").alias("conv_id"), F.concat_ws(" ", F.lit("Học trước"), "p_name", "p_brand").alias("named"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("conv_id"), F.col("embedding").alias("vector"))
    messages = stage(_messages(spark, d), "messages")
    rewrites = ret.last_messages(messages).join(part, "conv_id", "left").join(vectors, "conv_id", "left").select(
        "conv_id", F.when(F.col("conv_id") % 3 == 0, F.col("named")).otherwise(F.col("previous")).alias("rewritten"), "vector")
    courses, edges, corpus, index = _stored_knowledge(spark, d)
    return ret.answer_requests(messages, rewrites, courses, edges, corpus, "T", threshold=0.6, index=index)


QUERIES = {
    "chat_answers": answers,
    "stream_retrieval_contexts": streamed_contexts,
    "chat_router_intents": router_intents,
    "chat_retrieval_intents": retrieval_intents,
    "chat_entities": entities,
    "chat_effective_questions": effective_questions,
    "chat_history": history,
    "chat_last_messages": last_messages,
    "chat_prompt_rows": prompt_rows,
    "chat_request_prompts": request_prompts,
    "retrieval_contexts": contexts,
    "retrieval_replies": replies,
}


def _case(text: str, rules, fallback: str, words: bool = False, first: str = "") -> str:
    whens = []
    for label, phrases in rules:
        if words:
            edge = r"[^\p{L}\p{N}\p{M}_]"
            test = f"regexp_matches({text}, '(^|{edge})({'|'.join(phrases)})($|{edge})')"
        else:
            test = " or ".join(f"contains({text}, '{p}')" for p in phrases)
        whens.append(f"when {test} then '{label}'")
    return f"case {first} {' '.join(whens)} else '{fallback}' end"


# The expected routes, written out.
_ROUTER = """case when length(trim(lower(text))) < 3 then 'SMALL_TALK'
  when regexp_full_match(trim(lower(text)), '(xin chào|chào|hi|hello|hey)+') then 'GREETING'
  when regexp_matches(trim(lower(text)), 'cảm ơn|thanks') then 'THANKS'
  when regexp_matches(trim(lower(text)), 'tạm biệt|bye') then 'GOODBYE'
  when regexp_matches(trim(lower(text)), 'sai|sai rồi|không đúng|nhầm') then 'CORRECTION'
  when regexp_matches(trim(lower(text)), 'ý tôi là|tôi muốn hỏi|ý mình là') then 'REFINE'
  when regexp_matches(trim(lower(text)), 'bao nhiêu tín chỉ|tín chỉ') then 'CREDIT'
  when regexp_matches(trim(lower(text)), 'môn học|học phần') then 'COURSE'
  when regexp_matches(trim(lower(text)), 'chương trình đào tạo|ctdt') then 'CURRICULUM'
  when regexp_matches(trim(lower(text)), 'ngành|chuyên ngành') then 'MAJOR'
  when regexp_matches(trim(lower(text)), 'học phí') then 'TUITION'
  when regexp_matches(trim(lower(text)), 'điều kiện|yêu cầu|đầu vào') then 'REQUIREMENT'
  when regexp_matches(trim(lower(text)), 'ở đâu|khoa nào|thuộc khoa') then 'FACULTY' else 'RAG' end"""
_RETRIEVAL = (
    ("GREETING", ("xin chào", "hello", "hi", "chào", "hey")), ("THANKS", ("cảm ơn", "thanks", "thank")), ("TUITION", ("học phí",)),
    ("CREDIT", ("tín chỉ",)), ("PREREQUISITE", ("tiên quyết", "học trước")), ("PROGRAM", ("chương trình", "ctdt", "khung chương trình")),
    ("MAJOR_INFO", ("ngành", "học gì", "mô tả", "giới thiệu")), ("CAREER", ("việc làm", "nghề", "ra trường", "làm gì")),
    ("OUTCOME", ("chuẩn đầu ra", "plo")), ("TRAINING_FORM", ("chính quy", "tại chức", "online")),
    ("DURATION", ("bao lâu", "mấy năm", "thời gian học")), ("FACULTY", ("khoa", "bộ môn")), ("DEGREE", ("bằng gì", "văn bằng")),
    ("FURTHER_STUDY", ("học tiếp", "cao học", "thạc sĩ")),
)
_ENTITY = (("prerequisite", ("tiên quyết",)), ("tuition", ("học phí",)), ("credit", ("tín chỉ",)))
_OPENINGS_SQL = "[" + ", ".join(f"'{o}'" for o in OPENINGS) + "]"
_MESSAGES = f"""
with opened as (
  select *, (conv_id * 7 + turn) % {len(OPENINGS)} as slot, list_extract({_OPENINGS_SQL}, (conv_id * 7 + turn) % {len(OPENINGS)} + 1) as o
  from conversations
),
messages as (
  select conv_id, turn, role, case when slot >= {len(OPENINGS) - 2} then o else o || ' ' || text end as text from opened
),
backs as (select *, row_number() over (partition by conv_id order by turn desc) as back from messages),
last_two as (
  select conv_id, max(case when back = 1 then text end) as question, max(case when back = 2 then text end) as previous
  from backs where back <= 2 group by conv_id
),
requests as (select *, {_ROUTER.replace('text', 'question')} as intent from last_two)
"""
_SYSTEM = """('Bạn là chatbot tư vấn T.' || chr(10) || 'Chỉ trả lời dựa trên dữ liệu được cung cấp.' || chr(10)
  || 'Hãy trả lời sinh viên một cách thân thiện.' || chr(10) || 'Không được tự bịa.' || chr(10)
  || 'Nếu không có dữ liệu → trả lời: ''Mình không tìm thấy thông tin chính xác.''' || chr(10))"""
_GREETING = "Xin chào! Mình có thể giúp gì cho bạn về chương trình đào tạo T?"
_NOT_FOUND = "Mình không tìm thấy thông tin chính xác trong hệ thống."
_BAD_REWRITE = "contains(lower(trim(rw)), 'tín chỉ') or contains(lower(trim(rw)), 'là') or contains(lower(trim(rw)), 'bao gồm')"
_PART_QUESTIONS = """
questions as (
  select p_partkey as qid, case when p_partkey % 11 = 0 then 'abc' else
    list_extract(['học trước', 'tín chỉ', 'văn bằng', 'hello'], p_partkey % 4 + 1) || ' ' || p_name || ' ' || p_brand end as text
  from part
)
"""
_FOUND = f"""
routed as (
  select *, {_case("lower(text)", _RETRIEVAL, 'GENERAL')} as intent from questions where length(text) >= 5
),
asked as (select *, text as entity from routed where intent not in ('GREETING', 'THANKS')),
courses as (
  select id, case when cast(substr(id, 2) as bigint) % 2 = 0 then 'Học trước ' else 'Tín chỉ ' end || ten_hp as name, so_tin_chi
  from nodes where label = 'HocPhan'
),
matches as (
  select distinct a.intent, a.entity, c.id, c.name, c.so_tin_chi from asked a join courses c
  on contains(lower(c.name), lower(a.entity)) where a.intent in ('PREREQUISITE', 'CREDIT')
),
pre_from as (select * from matches where intent = 'PREREQUISITE' and id in (select source from edges where type = 'YEU_CAU_TIEN_QUYET')),
pre_chosen as (select entity, arg_min(name, id) as name from pre_from group by entity),
answers as (
  select 'PREREQUISITE' as intent, f.entity, 'Môn ' || f.name || ' cần học trước: ' || string_agg(t.name, ', ' order by t.name) as graph_text
  from pre_from f join pre_chosen c on c.entity = f.entity and c.name = f.name
  join edges e on e.source = f.id and e.type = 'YEU_CAU_TIEN_QUYET' left join courses t on t.id = e.target
  group by f.entity, f.name
  union all
  select 'CREDIT', entity, 'Môn ' || arg_min(name, id) || ' có ' || arg_min(so_tin_chi, id) || ' tín chỉ'
  from matches where intent = 'CREDIT' group by entity
),
looked as (select a.*, w.graph_text from asked a left join answers w on w.intent = a.intent and w.entity = a.entity),
scored as (
  select l.qid, c.vec_id as id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[])), 9) as cos
  from looked l join embeddings q on q.vec_id = l.qid, embeddings c where l.graph_text is null
),
near as (
  select qid, string_agg('text ' || id, chr(10) order by rank) as vector_text from (
    select *, row_number() over (partition by qid order by cos desc, id) as rank from scored where cos > 2 * 0.6 - 1
  ) where rank <= 2 group by qid
),
found as (
  select l.qid, l.intent, case when graph_text is not null then '[GRAPH]' || chr(10) || graph_text
    when vector_text is not null then '[VECTOR]' || chr(10) || vector_text end as context
  from looked l left join near n on n.qid = l.qid
)
"""
_CONTEXTS = f"with {NODES_SQL}, {EDGES_SQL}, {_PART_QUESTIONS}, {_FOUND}"
SQL = {
    "chat_router_intents": _MESSAGES + f"select conv_id, turn, {_ROUTER} as intent from messages",
    "chat_retrieval_intents": _MESSAGES + f"""
select conv_id, turn, {_case('lower(text)', _RETRIEVAL, 'GENERAL')} as intent,
  {_case('lower(text)', _RETRIEVAL, 'GENERAL', words=True)} as intent_by_words from messages
""",
    "chat_entities": _MESSAGES + f"""
select conv_id, turn, {_case('lower(text)', _ENTITY, 'general')} as intent,
  coalesce(nullif(regexp_extract(lower(text), 'ct[0-9]+'), ''), text) as entity
from messages where length(trim(text)) >= 5
""",
    "chat_effective_questions": _MESSAGES + f"""
, r as (select *, case when conv_id % 2 = 0 then previous || ' bao gồm' else previous end as rw from requests)
select conv_id, intent,
  case when intent = 'RAG' and length(trim(question)) >= 5 and rw is not null and not ({_BAD_REWRITE}) then trim(rw) else question end as asked,
  case when intent = 'RAG' and length(trim(question)) >= 5 and rw is not null and not ({_BAD_REWRITE}) then trim(rw)
       when intent = 'CORRECTION' then coalesce(previous, question) else question end as corrected
from r
""",
    "chat_history": _MESSAGES + "select conv_id, turn, role, text, back - 1 as back from backs where back between 2 and 4",
    "chat_last_messages": _MESSAGES + "select * from last_two",
    "chat_prompt_rows": _MESSAGES + f"""
select conv_id, 0 as position, 'system' as role, {_SYSTEM} || case when conv_id % 3 = 0 then
  chr(10) || 'Dữ liệu:' || chr(10) || '[GRAPH]' || chr(10) || intent || chr(10) else '' end as content from requests
union all select conv_id, turn + 1, case when back = 1 then 'user' else role end, text from backs
""",
    "chat_request_prompts": _MESSAGES + f"""
select conv_id, 0 as position, 'system' as role, {_SYSTEM} as content from requests
union all select conv_id, 1, 'assistant', coalesce(previous, '') from requests
union all select conv_id, 2, 'user', question from requests
""",
    "chat_answers": _MESSAGES + f"""
, asks as (
  select conv_id, intent as router_intent, case when intent = 'RAG' and length(trim(question)) >= 5 and rw is not null and not ({_BAD_REWRITE})
    then trim(rw) else question end as asked
  from (select r.*, case when conv_id % 3 = 0 then 'Học trước ' || p_name || ' ' || p_brand else previous end as rw
        from requests r left join part on p_partkey = conv_id)
),
questions as (select conv_id as qid, trim(asked) as text from asks where router_intent <> 'GREETING'), {NODES_SQL}, {EDGES_SQL}, {_FOUND},
outcome as (
  select a.conv_id, a.asked, f.context, case when router_intent = 'GREETING' then '{_GREETING}' when f.context is null then '{_NOT_FOUND}' end as reply
  from asks a left join found f on f.qid = a.conv_id
)
select conv_id, 0 as position, 'system' as role, {_SYSTEM} || chr(10) || 'Dữ liệu:' || chr(10) || context || chr(10) as content
from outcome where reply is null
union all select b.conv_id, turn + 1, case when back = 1 then 'user' else role end, case when back = 1 then asked else text end
from backs b join outcome o on o.conv_id = b.conv_id where reply is null
union all select b.conv_id, turn + 2, 'assistant', reply from backs b join outcome o on o.conv_id = b.conv_id where reply is not null and back = 1
""",
    "retrieval_contexts": _CONTEXTS + """
select q.qid, f.intent, f.context from questions q left join found f on f.qid = q.qid
""",
    "stream_retrieval_contexts": _CONTEXTS + """
select q.qid, f.context from questions q left join found f on f.qid = q.qid
""",
    "retrieval_replies": _CONTEXTS + f"""
, joined as (select q.qid, q.text, f.context, {_ROUTER.replace('text', 'q.text')} as router_intent
             from questions q left join found f on f.qid = q.qid)
select qid, router_intent,
  case when router_intent = 'GREETING' then '{_GREETING}'
       when context is null then '{_NOT_FOUND}' end as reply,
  case when router_intent <> 'GREETING' and context is not null then
    {_SYSTEM} || chr(10) || 'Dữ liệu:' || chr(10) || context || chr(10) end as system_text
from joined
""",
}
