"""Questions to context strings: routing, graph lookup, vector fallback, reply."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import intents as it
from ..functions import text as tx
from ..operators import graph as gr
from ..operators import vectors as ve
from ..operators.contains import contains_join, look_up_names
from ..session import stage

COURSE = "HocPhan"
PREREQUISITE = "YEU_CAU_TIEN_QUYET"
TOP_K, TOP_THRESHOLD, TOP_LIMIT = 3, 0.8, 2
OLDER_THRESHOLD = 0.7


def courses_of(nodes: DataFrame) -> DataFrame:
    """``(id, name, code, credits)`` of the course nodes."""
    return nodes.where(F.col("label") == COURSE).select(
        "id",
        F.col("props")["ten_hp"].alias("name"),
        F.col("props")["ma_hp"].alias("code"),
        F.col("props")["so_tin_chi"].alias("credits"),
    )


def routed_all(questions: DataFrame, whole_words: bool = False) -> DataFrame:
    """Add intent and entity; both are null for short questions and small talk."""
    text = tx.strip(F.col("text"))
    found = questions.withColumn("text", text).withColumn(
        "intent", F.when(it.long_enough(F.col("text")), it.retrieval_intent(F.col("text"), whole_words))
    )
    asked = ~F.col("intent").isin(*it.SMALL_TALK)
    return found.withColumn("intent", F.when(asked, F.col("intent"))).withColumn(
        "entity", F.when(F.col("intent").isNotNull(), it.entity(F.col("text")))
    )


def route(questions: DataFrame, whole_words: bool = False) -> DataFrame:
    """Add intent and entity; drop short questions and small talk."""
    return routed_all(questions, whole_words).where("intent is not null")


def matching_courses(entities: DataFrame, courses: DataFrame, match_codes: bool = False, index: str | None = None) -> DataFrame:
    """``entities(entity)`` to ``(entity, id, name, credits)`` of courses named like it.

    ``index`` is the path of a stored name index of the courses (``contains.append_names``).
    """
    needles, names = entities.select(F.col("entity").alias("needle")), courses.select("id", "name")
    found = contains_join(needles, names) if index is None else look_up_names(needles, names, index)
    found = found.select(F.col("needle").alias("entity"), "id")
    if match_codes:
        by_code = entities.withColumn("code", F.upper("entity")).join(courses.select("code", "id"), "code")
        found = found.unionByName(by_code.select("entity", "id")).distinct()
    return found.join(courses.select("id", "name", "credits"), "id")


def prerequisite_answers(matches: DataFrame, courses: DataFrame, edges: DataFrame) -> DataFrame:
    """One sentence per entity: the prerequisites of one matching course name.

    Of several names the one of the smallest id is taken; only its edges are
    expanded. Courses without prerequisites do not count. The starts are written when
    it is called, so that the edges stay where they are if the starts are few.
    """
    hops = edges.where(F.col("type") == PREREQUISITE).select("source", "target")
    having = matches.join(hops.select(F.col("source").alias("id")).distinct(), "id", "left_semi")
    chosen = having.groupBy("entity").agg(F.min_by("name", "id").alias("name"))
    # Courses of the same name match the same texts, so the name finds them all.
    starts = stage(chosen.join(courses.select("name", F.col("id").alias("source")), "name"), "starts")
    ends = courses.select(F.col("id").alias("target"), F.col("name").alias("before"))
    listed = (
        starts.join(hops, "source").join(ends, "target", "left")
        .groupBy("entity", "name")
        .agg(F.sort_array(F.collect_list("before")).alias("before"))
    )
    return listed.select("entity", an.prerequisite_sentence(F.col("name"), F.col("before")).alias("graph_text"))


def credit_answers(matches: DataFrame) -> DataFrame:
    chosen = matches.groupBy("entity").agg(F.min_by(F.struct("name", "credits"), "id").alias("c"))
    return chosen.select("entity", an.credit_sentence(F.col("c.name"), F.col("c.credits")).alias("graph_text"))


def graph_answers(routed: DataFrame, nodes: DataFrame, edges: DataFrame, match_codes: bool = False,
                  index: str | None = None) -> DataFrame:
    """``(intent, entity, graph_text)`` for the two intents the graph can answer.

    Equal questions are looked up once, and the matches are found and written once for both.
    """
    asked = stage(routed.where(F.col("intent").isin("PREREQUISITE", "CREDIT")).select("intent", "entity").distinct(), "asked")
    courses = courses_of(nodes)
    found = stage(matching_courses(asked.select("entity").distinct(), courses, match_codes, index), "matches")
    matches = asked.join(found, "entity")
    of = lambda intent: matches.where(F.col("intent") == intent)
    pre = prerequisite_answers(of("PREREQUISITE"), courses, edges)
    credit = credit_answers(of("CREDIT"))
    return pre.withColumn("intent", F.lit("PREREQUISITE")).unionByName(
        credit.withColumn("intent", F.lit("CREDIT"))
    )


def contexts(
    questions: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    corpus: DataFrame,
    k: int = TOP_K,
    threshold: float = TOP_THRESHOLD,
    limit: int = TOP_LIMIT,
    whole_words: bool = False,
    match_codes: bool = False,
    index: str | None = None,
) -> DataFrame:
    """``questions(qid, text, vector)`` to ``(qid, intent, graph_text, vector_text, context)``.

    ``corpus(id, text, vector)`` is searched only for questions the graph left
    without an answer. Questions that are too short or small talk have no context.

    Each step that others build on is written once: the routed questions, the courses they
    name (looked up in the stored ``index`` if there is one) and the answers of the graph.
    """
    routed = stage(routed_all(questions, whole_words).select("qid", "intent", "entity", "vector"), "routed")
    answers = graph_answers(routed.where("intent is not null"), nodes, edges, match_codes, index)
    looked_up = stage(routed.join(answers, ["intent", "entity"], "left"), "looked-up")
    rest = looked_up.where("intent is not null and graph_text is null and vector is not null").select("qid", "vector")
    matches = ve.top_matches(
        rest, corpus.select("id", "vector"), k=min(k, limit), min_cosine=ve.cosine_floor(threshold)
    )
    texts = ve.nearest_texts(matches, corpus.select("id", "text"), limit)
    return looked_up.join(texts, "qid", "left").select(
        "qid", "intent", "graph_text", "vector_text",
        an.context(F.col("graph_text"), F.col("vector_text")).alias("context"),
    )


def replies(questions: DataFrame, contexts_found: DataFrame, institution: str = "") -> DataFrame:
    """Fixed reply where there is one, else the system text that goes to a model."""
    joined = questions.select("qid", "text").join(contexts_found, "qid", "left")
    router = it.router_intent(F.col("text"))
    reply = an.fixed_reply(router, F.col("context"), institution)
    return joined.select(
        "qid", router.alias("router_intent"), reply.alias("reply"),
        F.when(reply.isNull(), an.system_text(F.col("context"), institution)).alias("system_text"),
    )


# --- conversations ---------------------------------------------------------------


def last_turns(conversations: DataFrame, n: int = 3) -> DataFrame:
    """The last n turns of each conversation, rank 1 being the last.

    The rank limit is applied before the shuffle, so a long conversation sends n
    rows per task.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return conversations.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= n)


def rewrite_history(conversations: DataFrame, n: int = 3) -> DataFrame:
    """The n turns before the question, which is the last turn; rank 1 is the nearest."""
    return last_turns(conversations, n + 1).where("back > 1").withColumn("back", F.col("back") - 1)


def last_messages(conversations: DataFrame) -> DataFrame:
    """Question (last message) and the message before it, per conversation."""
    pair = last_turns(conversations, 2)
    at = lambda n: F.max(F.when(F.col("back") == n, F.col("text")))
    return pair.groupBy("conv_id").agg(at(1).alias("question"), at(2).alias("previous"))


def prompt_rows(conversations: DataFrame, contexts_found: DataFrame, institution: str = "") -> DataFrame:
    """System text, history and question as rows ``(conv_id, position, role, content)``.

    Rows are left unnested, so no task gathers a conversation; positions order them. Where
    ``contexts_found`` has a column ``asked``, it takes the place of the last message.
    """
    last = conversations.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    is_last = F.col("turn") == F.col("last_turn")
    marked = conversations.join(last, "conv_id")
    content = F.col("text")
    if "asked" in contexts_found.columns:
        marked = marked.join(contexts_found.select("conv_id", "asked"), "conv_id", "left")
        content = F.when(is_last, F.coalesce("asked", "text")).otherwise(content)
    turns = marked.select(
        "conv_id", (F.col("turn") + 1).alias("position"),
        F.when(is_last, F.lit("user")).otherwise(F.col("role")).alias("role"), content.alias("content"),
    )
    system = last.join(contexts_found, "conv_id", "left").select(
        "conv_id", F.lit(0).cast("bigint").alias("position"), F.lit("system").alias("role"),
        an.system_text(F.col("context"), institution).alias("content"),
    )
    return system.unionByName(turns)


def answer_requests(conversations: DataFrame, rewrites: DataFrame, nodes: DataFrame, edges: DataFrame, corpus: DataFrame,
                    institution: str = "", follow_corrections: bool = False, **options) -> DataFrame:
    """Chat requests to what follows: ``(conv_id, position, role, content)``.

    ``conversations(conv_id, turn, role, text)``, the last turn being the question;
    ``rewrites(conv_id, rewritten, vector)`` holds a proposed rewrite and the vector of the
    text that is searched (either may be null or missing). The original question is routed;
    where it falls to the search, its accepted rewrite is searched and asked. A greeting, or a
    question without a context, has one row of role assistant with the fixed reply, after all
    turns; any other request has the rows of its prompt. ``options`` go to ``contexts``.
    """
    question, router = F.col("question"), it.router_intent(F.col("question"))
    last = last_messages(conversations).join(rewrites.select("conv_id", "rewritten", "vector"), "conv_id", "left")
    routed = last.withColumn("router_intent", router).select(
        "conv_id", "router_intent", "vector",
        it.effective_question(question, F.col("router_intent"), F.col("rewritten"), F.col("previous"), follow_corrections).alias("asked"),
    )
    requests = stage(routed, "requests")
    questions = requests.where("router_intent <> 'GREETING'").select(F.col("conv_id").alias("qid"), F.col("asked").alias("text"), "vector")
    found = contexts(questions, nodes, edges, corpus, **options).select(F.col("qid").alias("conv_id"), "context")
    outcome = stage(requests.drop("vector").join(found, "conv_id", "left").withColumn(
        "reply", an.fixed_reply(F.col("router_intent"), F.col("context"), institution)), "outcome")
    to_model = outcome.where("reply is null").select("conv_id", "asked", "context")
    prompts = prompt_rows(conversations.join(to_model.select("conv_id"), "conv_id", "left_semi"), to_model, institution)
    ends = conversations.groupBy("conv_id").agg((F.max("turn") + 2).alias("position"))
    fixed = outcome.where("reply is not null").join(ends, "conv_id").select(
        "conv_id", "position", F.lit("assistant").alias("role"), F.col("reply").alias("content"))
    return prompts.withColumn("position", F.col("position").cast("bigint")).unionByName(fixed.withColumn("position", F.col("position").cast("bigint")))


# --- the three worked graph questions ------------------------------------------------


def programme_credits(nodes: DataFrame, edges: DataFrame, major: str, cohort: int) -> DataFrame:
    """Credits of the programmes of a major (name contains, case kept) and cohort."""
    programmes = nodes.where(
        (F.col("label") == "ChuongTrinhDaoTao") & (F.col("props")["khoa"] == str(cohort))
    ).select(F.col("id").alias("source"), F.col("props")["tong_tin_chi"].alias("tong_tin_chi"))
    majors = nodes.where(
        (F.col("label") == "Nganh") & F.contains(F.col("props")["ten_nganh_vi"], F.lit(major))
    ).select(F.col("id").alias("target"))
    return gr.expand(programmes, edges, "THUOC_VE", majors)


def elective_requirements(nodes: DataFrame, edges: DataFrame, block: str) -> DataFrame:
    """Requirements of the knowledge blocks whose name contains a text, case aside."""
    blocks = nodes.where(
        (F.col("label") == "KhoiKienThuc")
        & F.contains(F.lower(F.col("props")["ten_khoi"]), F.lower(F.lit(block)))
    ).select(F.col("id").alias("source"))
    needs = nodes.where(F.col("label") == "YeuCauTuChon").select(
        F.col("id").alias("target"),
        F.col("props")["noi_dung_yeu_cau"].alias("noi_dung_yeu_cau"), F.col("props")["mo_ta"].alias("mo_ta"),
    )
    return gr.expand(blocks, edges, "CO_YEU_CAU_TU_CHON", needs)


def members(nodes: DataFrame, edges: DataFrame, start_labels: tuple[str, ...], relation: str,
            end_labels: tuple[str, ...]) -> DataFrame:
    """One hop between sets of labels, with both labels and ids."""
    side = lambda labels, key: nodes.where(F.col("label").isin(*labels)).select(
        F.col("id").alias(key), F.col("label").alias(f"{key}_label")
    )
    return gr.expand(side(start_labels, "source"), edges, relation, side(end_labels, "target"))


def rows_as_json(df: DataFrame, *keys: str) -> DataFrame:
    """Result rows of each key as one JSON array, accents kept.

    Choose keys that few rows share: an array is one value of one row.
    """
    cells = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*cells)))).alias("json"))
