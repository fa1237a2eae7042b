"""Answer sentences, context blocks, replies and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# Reply texts. The institution's name is the caller's.
GREETING_REPLY = "Xin chào! Mình có thể giúp gì cho bạn về chương trình đào tạo{institution}?"
NOT_FOUND_REPLY = "Mình không tìm thấy thông tin chính xác trong hệ thống."
SYSTEM_TEXT = (
    "Bạn là chatbot tư vấn{institution}.\n"
    "Chỉ trả lời dựa trên dữ liệu được cung cấp.\n"
    "Hãy trả lời sinh viên một cách thân thiện.\n"
    "Không được tự bịa.\n"
    "Nếu không có dữ liệu → trả lời: 'Mình không tìm thấy thông tin chính xác.'\n"
)


def prerequisite_sentence(course: Column, prerequisites: Column) -> Column:
    return F.concat(
        F.lit("Môn "), course, F.lit(" cần học trước: "), F.array_join(prerequisites, ", ")
    )


def credit_sentence(course: Column, credits: Column) -> Column:
    return F.concat(F.lit("Môn "), course, F.lit(" có "), F.coalesce(credits, F.lit("None")), F.lit(" tín chỉ"))


def context(graph: Column, vector: Column) -> Column:
    """Blocks of graph and vector findings, null when both are missing."""
    blocks = F.concat_ws(
        "\n",
        F.concat(F.lit("[GRAPH]\n"), tx.nullify(graph)),
        F.concat(F.lit("[VECTOR]\n"), tx.nullify(vector)),
    )
    return tx.nullify(tx.strip(blocks))


def _named(template: str, institution: str) -> str:
    return template.format(institution=f" {institution}" if institution else "")


def fixed_reply(router_intent: Column, ctx: Column, institution: str = "") -> Column:
    """Greeting or not-found text; null where the context goes on to a model."""
    return F.when(router_intent == "GREETING", F.lit(_named(GREETING_REPLY, institution))).when(
        ctx.isNull(), F.lit(NOT_FOUND_REPLY)
    )


def system_text(ctx: Column, institution: str = "") -> Column:
    base = F.lit(_named(SYSTEM_TEXT, institution))
    return F.when(
        ctx.isNotNull(), F.concat(base, F.lit("\nDữ liệu:\n"), ctx, F.lit("\n"))
    ).otherwise(base)


def message(role: str | Column, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def prompt(messages: Column, question: Column, ctx: Column, institution: str = "") -> Column:
    """``array<struct<role,content>>`` of one chat request: system, history, question."""
    history = F.transform(
        F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0))),
        lambda m: message(m["role"], F.get(m["parts"], F.lit(0))["text"]),
    )
    return F.concat(
        F.array(message("system", system_text(ctx, institution))),
        history,
        F.array(message("user", question)),
    )
