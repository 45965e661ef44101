"""Messages, roles and masks of conversations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def messages(**roles: Column) -> Column:
    """Array of (role, content) in the given order; null contents are left out."""
    return F.filter(F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in roles.items()]), lambda m: m["content"].isNotNull())


def contents(msgs: Column, role: str) -> Column:
    """Contents of all messages of a role, in order."""
    return F.transform(F.filter(msgs, lambda m: m["role"] == role), lambda m: m["content"])


def last_content(msgs: Column, role: str) -> Column:
    c = contents(msgs, role)
    return F.get(c, F.size(c) - 1)


def loss_mask(msgs: Column, lengths: Column, role: str = "assistant") -> Column:
    """Per token, 1 in messages of the role; ``lengths`` are the tokens of each message."""
    return F.flatten(F.zip_with(msgs, lengths, lambda m, n: F.array_repeat((m["role"] == role).cast("int"), n.cast("int"))))


def role_counts(msgs: Column) -> Column:
    """Map role -> number of messages."""
    roles = F.transform(msgs, lambda m: m["role"])
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(roles)), lambda r: F.struct(r.alias("key"), F.size(F.filter(roles, lambda x: x == r)).alias("value"))))


def alternates(msgs: Column) -> Column:
    """No two neighbours of one role, after any system messages."""
    rest = F.transform(F.filter(msgs, lambda m: m["role"] != "system"), lambda m: m["role"])
    return F.forall(F.transform(rest, lambda r, i: (i == 0) | (r != F.get(rest, i - 1))), lambda ok: F.coalesce(ok, F.lit(True)))


def preference(prompt: Column, chosen: Column, rejected: Column) -> Column:
    """Two texts, chosen and rejected, each after the prompt."""
    return F.array(F.concat(F.coalesce(prompt, F.lit("")), chosen), F.concat(F.coalesce(prompt, F.lit("")), rejected))


def passages(results: Column) -> Column:
    """Numbered passages of retrieval results: the first line of a content is its title."""
    text = F.transform(results, lambda r, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit("(Title: "), F.substring_index(r, "\n", 1), F.lit(") "), F.array_join(F.slice(F.split(r, "\n"), F.lit(2), F.greatest(F.lit(1), F.size(F.split(r, "\n")) - 1)), "\n"), F.lit("\n")))
    return F.array_join(text, "\n")


#: Marks of a turn in the chat form used unless another is given (fixed values).
OPEN, CLOSE = "<|im_start|>{role}\n", "<|im_end|>\n"
#: Label of tokens that aren't trained (fixed value).
IGNORED = -100


def rendered(msgs: Column, answer_next: bool = False, role: str = "assistant", opening: str = OPEN, closing: str = CLOSE) -> Column:
    """The conversation as one text; with ``answer_next`` it ends in the opening of a reply."""
    turn = lambda m: F.concat(F.replace(F.lit(opening), F.lit("{role}"), m["role"]), F.coalesce(m["content"], F.lit("")), F.lit(closing))
    text = F.array_join(F.transform(msgs, turn), "")
    return F.concat(text, F.lit(opening.replace("{role}", role))) if answer_next else text


def byte_ids(text: str) -> list[int]:
    """The simplest encoder: the bytes of a text."""
    return list(text.encode("utf-8", "replace"))


def tokenized(df: DataFrame, msgs: str, most: int, encoder: Callable[[], Callable[[str], list[int]]] = lambda: byte_ids, target: str = "full_message", opening: str = OPEN, closing: str = CLOSE) -> DataFrame:
    """``df`` with input_ids, attention_mask, labels and ``error`` of conversations whose last message is the reply.

    The prompt is all but the last message and the opening of the reply. "full_message": the target are the tokens of the whole
    conversation beyond those it shares with the prompt; "answer_only": those of the stripped reply alone. Prompt tokens have the label -100; where
    prompt and target have more than ``most`` tokens, the prompt loses its first ones. error instead of ids: "no_target" for a
    reply without tokens or no message, "target_too_long". ``encoder`` makes a function from text to ids in each Python worker.
    """
    if target not in ("full_message", "answer_only"):
        raise ValueError(target)
    m = F.col(msgs)
    n = F.size(m)
    ready = df.withColumns({
        "__prompt": rendered(F.slice(m, F.lit(1), F.greatest(n - 1, F.lit(0))), True, opening=opening, closing=closing), "__full": rendered(m, opening=opening, closing=closing),
        "__answer": F.regexp_replace(F.coalesce(F.get(m, n - 1)["content"], F.lit("")), r"(?U)^\s+|\s+$", ""),
    })
    ids = T.ArrayType(T.IntegerType())
    schema = T.StructType([*df.schema.fields, T.StructField("input_ids", ids), T.StructField("attention_mask", ids), T.StructField("labels", ids), T.StructField("error", T.StringType())])
    kept = df.columns

    def one(encode, prompt: str | None, full: str | None, answer: str | None):
        if prompt is None or full is None:
            return None, None, None, "no_target"
        before = encode(prompt)
        if target == "answer_only":
            goal = encode(answer or "")
        else:
            whole = encode(full)
            shared = next((i for i, (x, y) in enumerate(zip(before, whole)) if x != y), min(len(before), len(whole)))
            before, goal = whole[:shared], whole[shared:]
        if not goal or not answer:
            return None, None, None, "no_target"
        if len(goal) > most:
            return None, None, None, "target_too_long"
        room = most - len(goal)
        before = before[-room:] if room else []
        return before + goal, [1] * (len(before) + len(goal)), [IGNORED] * len(before) + goal, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for pdf in batches:
            got = [one(encode, *x) for x in zip(pdf["__prompt"], pdf["__full"], pdf["__answer"])]
            out = pdf[kept].copy()
            for k, name in enumerate(("input_ids", "attention_mask", "labels", "error")):
                out[name] = [x[k] for x in got]
            yield out

    return ready.mapInPandas(run, schema)
