"""Question routing rules as ordered ``when`` chains: the first rule that fits wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# Router labels and the phrases that select them, in order.
ROUTER_RULES = (
    ("THANKS", ("cảm ơn", "thanks")),
    ("GOODBYE", ("tạm biệt", "bye")),
    ("CORRECTION", ("sai", "sai rồi", "không đúng", "nhầm")),
    ("REFINE", ("ý tôi là", "tôi muốn hỏi", "ý mình là")),
    ("CREDIT", ("bao nhiêu tín chỉ", "tín chỉ")),
    ("COURSE", ("môn học", "học phần")),
    ("CURRICULUM", ("chương trình đào tạo", "ctdt")),
    ("MAJOR", ("ngành", "chuyên ngành")),
    ("TUITION", ("học phí",)),
    ("REQUIREMENT", ("điều kiện", "yêu cầu", "đầu vào")),
    ("FACULTY", ("ở đâu", "khoa nào", "thuộc khoa")),
)
ROUTER_GREETING = r"\A(?:xin chào|chào|hi|hello|hey)+\z"
ROUTER_FALLBACK = "RAG"
ROUTER_MIN_CHARS = 3

# Retrieval labels and the phrases that select them, in order.
RETRIEVAL_RULES = (
    ("GREETING", ("xin chào", "hello", "hi", "chào", "hey")),
    ("THANKS", ("cảm ơn", "thanks", "thank")),
    ("TUITION", ("học phí",)),
    ("CREDIT", ("tín chỉ",)),
    ("PREREQUISITE", ("tiên quyết", "học trước")),
    ("PROGRAM", ("chương trình", "ctdt", "khung chương trình")),
    ("MAJOR_INFO", ("ngành", "học gì", "mô tả", "giới thiệu")),
    ("CAREER", ("việc làm", "nghề", "ra trường", "làm gì")),
    ("OUTCOME", ("chuẩn đầu ra", "plo")),
    ("TRAINING_FORM", ("chính quy", "tại chức", "online")),
    ("DURATION", ("bao lâu", "mấy năm", "thời gian học")),
    ("FACULTY", ("khoa", "bộ môn")),
    ("DEGREE", ("bằng gì", "văn bằng")),
    ("FURTHER_STUDY", ("học tiếp", "cao học", "thạc sĩ")),
)
RETRIEVAL_FALLBACK = "GENERAL"
SMALL_TALK = ("GREETING", "THANKS")

# The four coarse intents that go with the entity.
ENTITY_RULES = (
    ("prerequisite", ("tiên quyết",)),
    ("tuition", ("học phí",)),
    ("credit", ("tín chỉ",)),
)
ENTITY_FALLBACK = "general"
ENTITY_CODE = r"(ct[0-9]+)"

MIN_QUESTION_CHARS = 5
ANSWER_LIKE_WORDS = ("tín chỉ", "là", "bao gồm")


def _has_any(text: Column, words: tuple[str, ...], whole_words: bool = False) -> Column:
    pattern = "|".join(words)
    return text.rlike(rf"(?U)\b(?:{pattern})\b" if whole_words else pattern)


def first_rule(text: Column, rules, fallback: str, whole_words: bool = False, chain=F) -> Column:
    for label, words in rules:
        chain = chain.when(_has_any(text, words, whole_words), F.lit(label))
    return chain.otherwise(F.lit(fallback))


def router_intent(question: Column) -> Column:
    q = tx.strip(F.lower(question))
    start = F.when(F.length(q) < ROUTER_MIN_CHARS, F.lit("SMALL_TALK")).when(
        q.rlike(ROUTER_GREETING), F.lit("GREETING")
    )
    return first_rule(q, ROUTER_RULES, ROUTER_FALLBACK, chain=start)


def retrieval_intent(question: Column, whole_words: bool = False) -> Column:
    """``whole_words`` keeps short greetings from matching inside longer words."""
    return first_rule(F.lower(question), RETRIEVAL_RULES, RETRIEVAL_FALLBACK, whole_words)


def entity_intent(question: Column) -> Column:
    return first_rule(F.lower(question), ENTITY_RULES, ENTITY_FALLBACK)


def entity(question: Column) -> Column:
    """A course code in lower case, else the whole question."""
    return F.coalesce(tx.first_match(F.lower(question), ENTITY_CODE), question)


def long_enough(question: Column) -> Column:
    return F.length(tx.strip(question)) >= MIN_QUESTION_CHARS


def guarded_rewrite(question: Column, rewritten: Column) -> Column:
    """The rewritten question, unless it reads like an answer or the question is short."""
    proposal = tx.strip(rewritten)
    answers = _has_any(F.lower(proposal), ANSWER_LIKE_WORDS)
    return F.when(long_enough(question) & ~answers, F.coalesce(proposal, question)).otherwise(question)


def effective_question(question: Column, intent: Column, rewritten: Column,
                       previous: Column | None = None, follow_corrections: bool = False) -> Column:
    """Rewritten text for fallback questions, the question itself for all others.

    ``follow_corrections`` goes back to the previous message after a correction.
    """
    chosen = F.when(intent == ROUTER_FALLBACK, guarded_rewrite(question, rewritten))
    if follow_corrections and previous is not None:
        chosen = chosen.when(intent == "CORRECTION", F.coalesce(previous, question))
    return chosen.otherwise(question)
