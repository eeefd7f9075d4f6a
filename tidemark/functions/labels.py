"""Label texts and chat messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def user_turn(title: Column, content: Column, max_chars: int) -> Column:
    from tidemark.functions.text import truncated, unicode_trim

    body = F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(content, F.lit("")))
    return F.concat(F.lit("### Article:\n"), truncated(unicode_trim(body), max_chars))


def label_block(labels: list[str]) -> Column:
    """A fenced block with one ``name:`` / ``label: true`` pair of lines per label; missing labels read false."""
    pairs = F.concat_ws("\n", *[F.concat(F.lit(f"{c}:\n  label: "), F.when(F.coalesce(F.col(c), F.lit(False)), "true").otherwise("false")) for c in labels])
    return F.concat(F.lit("```yaml\n"), pairs, F.lit("\n```"))


def assistant_turn(reasoning: Column, labels: list[str]) -> Column:
    from tidemark.functions.text import unicode_trim

    return F.concat(F.lit("<think>\n"), unicode_trim(F.coalesce(reasoning, F.lit(""))), F.lit("\n</think>\n\n"), label_block(labels))


def combo_of_text(text: Column, labels: list[str]) -> Column:
    """Key such as ``T-F-F-T`` of the labels an assistant's text states as true."""
    return F.concat_ws("-", *[F.when(F.coalesce(text.contains(f"{c}:\n  label: true"), F.lit(False)), "T").otherwise("F") for c in labels])


def structured(pred: Column, labels: list[str]) -> list[Column]:
    """Columns of a structured answer (JSON text): missing labels and answers that don't parse give null."""
    got = F.from_json(pred, "struct<" + ",".join(f"{c}:boolean" for c in labels) + ">")
    return [got[c].alias(c) for c in labels]


def nested(text: Column, path: str, default: str = "") -> Column:
    """Value at a path (``a.b``) of JSON text, the default where any step is missing or null."""
    return F.coalesce(F.get_json_object(text, "$." + path), F.lit(default))


def utc_now(at: Column | None = None) -> Column:
    """Current UTC time as text; ``at`` fixes it, for runs that must come out the same."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()) if at is None else at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def messages(system: str, user: Column, assistant: Column) -> Column:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", assistant))


def without_thinking(response: Column) -> Column:
    return F.trim(F.regexp_replace(response, "(?s)<think>.*?</think>", ""))


def parsed_label(response: Column, name: str) -> Column:
    """true/false of a label in a response outside its think block; null where it isn't stated."""
    v = F.lower(F.regexp_extract(without_thinking(response), rf"(?i){name}:\s*\n\s*label:\s*(true|false)", 1))
    return F.when(v != "", v == "true")


def combo(labels: list[str]) -> Column:
    return F.concat_ws("-", *[F.when(F.coalesce(F.col(c), F.lit(False)), "T").otherwise("F") for c in labels])


def loose_bool(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def json_array(text: Column) -> Column:
    """The widest ``[...]`` of a text as an array of strings; null where there is none or it doesn't parse."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit("")), "array<string>")


def penalised(pred: Column, truth: Column) -> Column:
    """A missing prediction counts as the wrong one."""
    return F.coalesce(pred, ~truth)
