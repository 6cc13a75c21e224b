"""Scalar functions over texts and messages, as columns.

A message is a struct (turn, role, content); messages is an array of them in order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms that functions look for.
FENCE = r"(?s)```(?:python|py)?\s*\n(.*?)```"
URL = r"https?://[^\s<>\"')\]}`]+"
THINK = r"(?s)<think>(.*?)</think>"
TOOL_CALL = r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"
KEEP = r"[^0-9a-zA-Z一-鿿]"
CJK = "[一-龥]"


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def messages_to_text(messages: str | Column) -> Column:
    line = lambda m: F.concat(F.lit("<|"), F.coalesce(m["role"], F.lit("unknown")), F.lit("|>\n"), F.coalesce(m["content"], F.lit("")))
    return F.array_join(F.transform(c(messages), line), "\n")


def letters_only(text: str | Column) -> Column:
    """ASCII letters, digits and CJK characters."""
    return F.regexp_replace(c(text), KEEP, "")


def cjk_only(text: str | Column) -> Column:
    return F.regexp_replace(c(text), "[^一-龥]", "")


def has_cjk(text: str | Column) -> Column:
    return c(text).rlike(CJK)


def truncate_middle(text: str | Column, most: int = 5000) -> Column:
    """Long texts keep a head, cut at its last blank, and a tail, from its first blank, around a note of what is left out."""
    t, half = c(text), most // 2
    head = F.substring(t, 1, half)
    tail = F.expr(f"right({_sql(text)}, {most - half})") if isinstance(text, str) else F.right(t, F.lit(most - half))
    at = F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    head = F.when(head.rlike(r"\s") & (F.length(at) > 0), at).otherwise(head)
    rest = F.regexp_extract(tail, r"(?s)^\S*\s(.*)$", 1)
    tail = F.when(tail.rlike(r"\s") & (F.length(rest) > 0), rest).otherwise(tail)
    left = F.length(t) - F.length(head) - F.length(tail)
    cut = F.concat(head, F.lit("\n... ["), left.cast("string"), F.lit(" characters omitted] ...\n"), tail)
    return F.when(F.length(t) <= most, t).otherwise(cut)


def _sql(name: str) -> str:
    return f"`{name}`"


def code_blocks(text: str | Column, pattern: str = FENCE) -> Column:
    return F.regexp_extract_all(c(text), F.lit(pattern), F.lit(1))


def urls(text: str | Column) -> Column:
    return F.regexp_extract_all(c(text), F.lit(URL), F.lit(0))


def host(url: str | Column) -> Column:
    """What stands between the scheme and the first slash or colon; a bare host stands for itself."""
    h = F.regexp_extract(c(url), r"^https?://([^/:]+)", 1)
    return F.when(h != "", h).when(c(url).rlike(r"^[\w.-]+$"), c(url))


def assistant_parts(content: str | Column) -> Column:
    """struct(reasoning, content, calls): the first thought, the text without thoughts and calls, and the calls that are JSON with their positions among all calls."""
    t = c(content)
    calls = F.regexp_extract_all(t, F.lit(TOOL_CALL), F.lit(1))
    numbered = F.filter(F.transform(calls, lambda x, i: F.struct(F.concat(F.lit("call_"), i.cast("string")).alias("id"), x.alias("json"))), lambda x: F.try_parse_json(x["json"]).isNotNull())
    plain = F.regexp_replace(F.regexp_replace(t, THINK, ""), TOOL_CALL, "")
    plain = F.btrim(F.regexp_replace(plain, r"<\|im_end\|>\s*$", ""))
    thought = F.when(t.rlike(THINK), F.btrim(F.regexp_extract(t, THINK, 1)))
    return F.struct(thought.alias("reasoning"), plain.alias("content"), numbered.alias("calls"))


def judge_scores(response: str | Column) -> Column:
    """struct(a, b): both scores of an answer, or 5 and 5 if one is missing."""
    number = lambda who: F.regexp_extract(c(response), rf"(?is)combined_scores.*?{who}\D*?(\d+(?:\.\d+)?)", 1).try_cast("double")
    a, b = number("Agent_A"), number("Agent_B")
    both = a.isNotNull() & b.isNotNull()
    return F.struct(F.when(both, a).otherwise(5.0).alias("a"), F.when(both, b).otherwise(5.0).alias("b"))


NO_REPLY = "No reply."


def split_answer(messages: str | Column) -> Column:
    """struct(steps, answer): the assistant's numbered steps before the last message, and its last text."""
    m = c(messages)
    head = F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0)))
    steps = F.transform(F.filter(head, lambda x: x["role"] == "assistant"), lambda x, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), x["content"]))
    last = F.try_element_at(m, F.lit(-1))
    return F.struct(steps.alias("steps"), F.when(last["role"] == "assistant", last["content"]).otherwise(NO_REPLY).alias("answer"))


def content_hash(text: str | Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(c(text), 256), 1, digits)


def cache_key(name: str | Column, arguments: str | Column, most: int = 1024) -> Column:
    """name:arguments; an md5 of it if that is long; the name alone without arguments."""
    key = F.concat(c(name), F.lit(":"), c(arguments))
    return F.when(c(arguments).isNull(), c(name)).when(F.length(key) > most, F.md5(key)).otherwise(key)


def rationale(judge_output: str | Column) -> Column:
    """The first non-empty of three fields of a JSON answer, in thinking tags."""
    got = F.coalesce(*(F.nullif(F.get_json_object(c(judge_output), f"$.{k}"), F.lit("")) for k in ("rationale", "reasoning", "explanation")))
    return F.concat(F.lit("<thinking>\n"), got, F.lit("\n</thinking>"))


def correction_prompt(failures: str | Column, attempt: str | Column) -> Column:
    """Failures (array of structs plugin, message) as a numbered request; later attempts say so."""
    lines = F.array_join(F.transform(c(failures), lambda f, i: F.concat((i + 1).cast("string"), F.lit(". "), f["plugin"], F.lit(": "), f["message"])), "\n")
    head = F.when(c(attempt) > 1, F.concat(F.lit("Attempt "), c(attempt).cast("string"), F.lit(" still has problems:"))).otherwise("Your answer has problems:")
    return F.concat(head, F.lit("\n"), lines)


def error_lines(results: str | Column, nested: int = 3) -> Column:
    """One line for each failed result (plugin, status, message, errors), with up to three of its errors below."""
    line = lambda r: F.concat(F.lit("- "), r["plugin"], F.lit(": "), r["message"], F.array_join(F.transform(F.slice(r["errors"], 1, nested), lambda e: F.concat(F.lit("\n  * "), e)), ""))
    return F.array_join(F.transform(F.filter(c(results), lambda r: r["status"] == "failed"), line), "\n")


def inject(messages: str | Column, message: Column) -> Column:
    """The message before the last assistant message, or at the end."""
    m = c(messages)
    marks = F.transform(m, lambda x: F.when(x["role"] == "assistant", 1).otherwise(0))
    from_end = F.array_position(F.reverse(marks), 1)
    at = (F.size(m) - from_end + 1).cast("int")
    return F.when(from_end > 0, F.concat(F.slice(m, F.lit(1), at - 1), F.array(message), F.slice(m, at, F.size(m)))).otherwise(F.array_append(m, message))


def token_estimate(messages: str | Column) -> Column:
    return F.aggregate(c(messages), F.lit(0).cast("bigint"), lambda n, m: n + F.coalesce(F.floor(F.length(m["content"]) / 4), F.lit(0)))


def system_prompt(as_of: str | Column, step: str | Column, most: int) -> Column:
    left = F.lit(most) - c(step)
    now = F.concat(F.lit("Current time: "), F.date_format(c(as_of), "dd/MM/yyyy, HH:mm"), F.lit("\n"))
    return F.concat(now, F.when(left > 0, F.concat(left.cast("string"), F.lit(" tool turns remain."))).otherwise("No tool turns remain: answer now."))


def last_of(messages: str | Column, role: str) -> Column:
    return F.try_element_at(F.filter(c(messages), lambda m: m["role"] == role), F.lit(-1))["content"]


def first_of(messages: str | Column, role: str) -> Column:
    return F.try_element_at(F.filter(c(messages), lambda m: m["role"] == role), F.lit(1))["content"]


def to_bool(x: str | Column) -> Column:
    return F.lower(c(x)).isin("1", "true", "yes")


def has_text(x: str | Column) -> Column:
    return F.length(F.trim(c(x))) > 0


# ---- small arithmetic --------------------------------------------------------------------------------------------------


def quality_tier(diff: str | Column) -> Column:
    return F.when(c(diff) > 0.5, "gold").when(c(diff) > 0.2, "silver").otherwise("bronze")


def tier_confidence(diff: str | Column) -> Column:
    return F.least(c(diff) + 0.5, F.lit(1.0))


def accuracy(predicted: str | Column, expected: str | Column, confidence: str | Column) -> Column:
    return F.when(F.lower(c(predicted)) == F.lower(c(expected)), 0.5 + 0.5 * F.coalesce(c(confidence), F.lit(0.5))).otherwise(0.0)


def rubric(path: list[Column], answer: list[Column], weight: float = 0.6) -> Column:
    """Weighted sum of the rounded means of path and answer dimensions, to one decimal."""
    mean = lambda xs: F.round(sum(xs[1:], xs[0]) / len(xs))
    return F.round(weight * mean(path) + (1 - weight) * mean(answer), 1)


#: Tokens a second and dollars an hour by accelerator, and their defaults.
SPEED = {"H100": 50000.0, "A100": 30000.0, "A10": 15000.0, "T4": 5000.0}
PRICE = {"H100": 4.0, "A100": 2.0, "A10": 1.0, "T4": 0.35}
TOKENS_EACH = 2000


def training_hours(n: str | Column, gpu: str | Column) -> Column:
    speed = F.create_map(*(F.lit(x) for kv in SPEED.items() for x in kv))
    return c(n) * TOKENS_EACH / F.coalesce(speed[c(gpu)], F.lit(15000.0)) / 3600


def training_cost(n: str | Column, gpu: str | Column) -> Column:
    price = F.create_map(*(F.lit(x) for kv in PRICE.items() for x in kv))
    return training_hours(n, gpu) * F.coalesce(price[c(gpu)], F.lit(1.0))


def sweep(low: float, high: float, n: int) -> Column:
    """n evenly spaced values as an array; one value is the lowest."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(low) + (high - low) * i / max(n - 1, 1))


def json_value(json: str | Column) -> Column:
    """The variant of a text that is one JSON value and no more, or null; `try_parse_json` alone passes over what stands after the value."""
    t = c(json)
    # what stands after a value would have to go on both a list and an object
    listed = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
    return F.when(listed.isNotNull(), F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}"))), "$.v", "variant"))
