"""Model messages and correction feedback as expressions."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import REFS
from .digest import indented_json

# Headings of the messages and what stands for an empty reference or output.
_Q, _A, _REFS1, _REFS2, _STAGE1 = "【问题 q】", "【已有回答 a】", "【资料 ref1—ref10】", "【原始资料 ref1—ref10】", "【阶段一分析结果（已通过校验）】"
_EMPTY_REF, _EMPTY_OUTPUT = "（本份资料为空）", "（上一次输出为空）"
#: What a model is told after each kind of rejected output.
HINTS = {
    "evidence_substring": "quote 要与所引 ref 的文字逐字相同：选一段连续、较短的原文照样复制，标点和空格也不要动。",
    "empty_ref": "所引的 ref 这一次没有内容；换一个有内容的 ref，或把缺少的资料写进缺口说明。",
    "empty_quote": "quote 是空的；请放入所引 ref 中的一段原文。",
    "ref_range": "ref_id 只有 ref1—ref10 这十个值，按输入里出现的名字填写。",
    "label_enum": "label 只有三个值，请照抄标签，一个字也不要变。",
    "field_schema": "有字段缺少、多余或类型不对：字段名和类型都以要求里的列表为准。",
    "output_format": "整个回答应当就是一个 JSON 对象；文字里要换行时写 \\n 两个字符。",
    "consistency": "有两个字段的内容互相冲突，请对照规则改到一致。",
}
#: What frames a hint, and what is told for any other kind.
_REJECTED, _AGAIN = "这次的回答没有通过检查，问题是：", "改好之后请再给出完整的 JSON 对象，此外什么都不要写。"
_OTHER = "请逐条核对要求再回答。"


def ref_block(refs: Column) -> Column:
    """All ten references in order; empty ones are named as such."""
    filled = lambda r: F.coalesce(F.nullif(refs[r], F.lit("")), F.lit(_EMPTY_REF))
    return F.concat_ws("\n\n", *[F.concat(F.lit(f"[{r}]\n"), filled(r)) for r in REFS])


def _messages(system: Column, *parts: Column) -> Column:
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(one("system", system), one("user", F.concat_ws("\n\n", *parts)))


def stage1_messages(prompt: Column, q: Column, refs: Column) -> Column:
    """The question and the references; the answer isn't shown. Null without a question."""
    return F.when(q.isNotNull(), _messages(prompt, F.lit(_Q), q, F.lit(_REFS1), ref_block(refs)))


def stage2_messages(prompt: Column, q: Column, a: Column, refs: Column, stage1: Column, stored: bool = False) -> Column:
    """Question, answer, references and the whole stage 1. Null without a question or an answer.

    stage1 is a struct, or (stored) the JSON text of a committed stage 1, which is laid out with a line for each member.
    """
    shown = indented_json(stage1) if stored else F.to_json(stage1, {"pretty": "true"})
    return F.when(q.isNotNull() & a.isNotNull(), _messages(prompt, F.lit(_Q), q, F.lit(_A), a, F.lit(_REFS2), ref_block(refs), F.lit(_STAGE1), shown))


def leaks_answer(messages: Column, a: Column) -> Column:
    """Whether any message holds the answer's text."""
    return F.when(F.coalesce(a, F.lit("")) == "", False).otherwise(F.exists(messages, lambda m: F.contains(m["content"], a)))


def missing_refs(messages: Column, refs: Column) -> Column:
    """References with a text that no message holds."""
    absent = lambda text: ~F.exists(messages, lambda m: F.contains(m["content"], text))
    return F.array_compact(F.array(*[F.when((F.coalesce(refs[r], F.lit("")) != "") & absent(refs[r]), r) for r in REFS]))


def feedback(messages: Column, output: Column, problem: Column, kind: Column) -> Column:
    """The messages with the rejected output and what to mend."""
    hint = reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), HINTS.items(), F.when(F.lit(False), "")).otherwise(_OTHER)
    text = F.concat(F.lit(_REJECTED), problem, F.lit("。"), hint, F.lit(_AGAIN))
    more = F.array(F.struct(F.lit("assistant").alias("role"), F.coalesce(F.nullif(output, F.lit("")), F.lit(_EMPTY_OUTPUT)).alias("content")), F.struct(F.lit("user").alias("role"), text.alias("content")))
    return F.concat(messages, more)


def answered(messages: list[dict], output: str, problem: str, kind: str) -> list[dict]:
    """The same inside a task, where a rejected output is answered at once."""
    return [*messages, {"role": "assistant", "content": output or _EMPTY_OUTPUT}, {"role": "user", "content": f"{_REJECTED}{problem}。{HINTS.get(kind, _OTHER)}{_AGAIN}"}]


def with_stage1(messages: list[dict], stage1: str) -> list[dict]:
    """Stage-2 messages that were made with a null stage 1, with the stage-1 result (JSON) that a task got since."""
    *first, last = messages
    return [*first, {"role": last["role"], "content": f"{last['content']}\n\n{stage1}"}]


#: The instructions of each stage and their versions; a run keeps the ones it was made with.
PROMPT_VERSION = "1"
PROMPTS = {
    "stage1": "You are given a question and up to ten references. List the points that a right answer must have, say whether the references are sufficient, insufficient or uncertain for them, and quote the evidence word for word with the name of its reference. Don't answer the question. Reply with one JSON object with the fields required_points, evidence_sufficiency, evidence, missing_information, conflicts and reason.",
    "stage2": "You are given a question, an answer, up to ten references and the analysis of stage 1. Judge the answer with exactly one of the three labels, give the reason, the issues and the evidence word for word, correct stage 1 where it is wrong, and say whether people should review the judgement and why. Reply with one JSON object with the fields label, reason, issues, evidence_sufficiency, evidence, review_required, review_reasons and stage1_corrections.",
}


def load_prompt(stage: str) -> str:
    """The current instructions of a stage; an unknown stage is an error."""
    if stage not in PROMPTS:
        raise ValueError(f"no stage {stage!r}")
    return PROMPTS[stage]


def prompt_snapshot() -> dict[str, dict[str, str]]:
    """stage -> text, sha256 and version, as a run stores them."""
    return {s: {"text": t, "sha256": hashlib.sha256(t.encode()).hexdigest(), "version": PROMPT_VERSION} for s, t in PROMPTS.items()}
