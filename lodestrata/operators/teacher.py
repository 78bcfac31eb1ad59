"""Answers and grades from outside models, with bounded retries.

A model is any function from prompt to reply that can be sent to the executors;
it raises `Filtered` where it refuses a content. Calls run in Arrow batches next
to the rows; a task that is run again asks again, so journal what costs money
and replay it (operators/ledger.py).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.clients import Reply, content, served

#: A reply is a string, or has the content and the name that it was served under.
Model = Callable[[str], "str | Reply"]
JUDGE_ATTEMPTS, ANSWER_ATTEMPTS = 5, 3
RESULT = "answer string, scores array<int>, answer_calls int, judge_calls int, failure string, served string"


class Filtered(Exception):
    """The model refuses this content; a fresh answer may pass."""


def parse_scores(reply: str, n: int) -> list[int] | None:
    """What `functions.text.parse_judge` gives, for one reply."""
    a, b = reply.find("{"), reply.rfind("}")
    try:
        scores = json.loads(reply[a : b + 1])["scores"] if 0 <= a < b else None
    except (ValueError, KeyError, TypeError):
        return None
    good = isinstance(scores, list) and len(scores) == n and all(not isinstance(s, bool) and s in (0, 1) for s in scores)
    return [int(s) for s in scores] if good else None


def grade(prompt: str, judge_task: Callable[[str], str], n: int, answer: Model, judge: Model, judge_attempts: int, answer_attempts: int, name: str = "model") -> tuple:
    """(answer, scores, answer calls, judge calls, failure, served name): every attempt counts."""
    text, answers, grades, failure, by = None, 0, 0, None, None
    for _ in range(answer_attempts):
        try:
            answers += 1
            reply = answer(prompt)
            text, by = content(reply), served(reply, name)
            for _ in range(judge_attempts):
                grades += 1
                scores = parse_scores(content(judge(judge_task(text))), n)
                if scores is not None:
                    return text, scores, answers, grades, None, by
            return text, None, answers, grades, f"no valid grade in {judge_attempts} attempts", by
        except Filtered as e:
            failure = f"filtered: {e}"
    return text, None, answers, grades, failure, by


def answer_and_judge(items: DataFrame, answer: Model, judge: Model, prompt: str = "prompt", points: str = "key_points", judge_attempts: int = JUDGE_ATTEMPTS, answer_attempts: int = ANSWER_ATTEMPTS, name: str = "model") -> DataFrame:
    """`items` with answer, scores, answer_calls, judge_calls, failure (null where there are scores) and served.

    A reply that cannot be read is asked for again, a refused content gets a fresh
    answer, both a bounded number of times; what still fails is a row with a failure.
    A null prompt is the empty one, null key points are none.
    """
    if judge_attempts < 1 or answer_attempts < 1:
        raise ValueError("attempts must be at least 1")

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for prompts, tasks in batches:
            rows = []
            for p, given in zip(prompts, tasks):
                wanted = [str(x) for x in given] if given is not None else []
                rows.append(grade(p or "", lambda a, w=wanted: T.judge_task(w, a), len(wanted), answer, judge, judge_attempts, answer_attempts, name))
            yield pd.DataFrame(rows, columns=["answer", "scores", "answer_calls", "judge_calls", "failure", "served"])

    return items.withColumn("_r", run(F.col(prompt), F.col(points))).select("*", "_r.*").drop("_r")


def answers(rows: DataFrame, model: Model, prompt: str = "prompt", name: str = "model") -> DataFrame:
    """`rows` with the model's answer and the name that it was served under. A null prompt is the empty one."""

    @F.pandas_udf("answer string, served string")
    def run(prompts: pd.Series) -> pd.DataFrame:
        replies = [model(p or "") for p in prompts]
        return pd.DataFrame({"answer": [content(r) for r in replies], "served": [served(r, name) for r in replies]})

    return rows.withColumn("_r", run(F.col(prompt))).select("*", "_r.*").drop("_r")
