"""Text functions as Columns: tokens, facts, sentences, hashes, templates, compression and its metrics.

Patterns name Unicode classes explicitly, because `\\w` and `\\d` are ASCII-only in
Java's and RE2's regular expressions.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..partitions import lengths, slices

#: Token patterns.
WORD = r"[0-9A-Za-z]+(?:['’\-][0-9A-Za-z]+)*|[^\p{L}\p{N}_\s]"
FACT = r"#[\p{L}\p{N}_-]+|\p{Nd}+(?:[.,:/-]\p{Nd}+)*%?"
TILE = r"(?s).*?(?:[.!?…][\"')\]]*(?:\s+|$)|(?:\n[ \t]*)+)|.+"
NOT_ALNUM = r"[^a-z0-9]+"
#: Characters at which no word and no fact begins.
NO_WORD, NO_FACT = r"[\s_]", r"[^#\p{Nd}]"
#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (
    "U.S.C", "U.S", "H.R", "D.C", "Pub. L. No", "Pub. L", "Pub", "No", "Mr", "Mrs", "Dr", "Fig", "e.g", "i.e", "etc", "vs", "al", "Vol", "pp", "ch", "sec",
)
GUARD = "\uf8f0"
JUDGE_MARK, JUDGE_FENCE = "[grade this answer]", "~~~"
JUDGE_RULE = 'For each key point give 1 if the answer states it, else 0. Reply with {"scores": [...]} only.'
JUDGE_TASK = r"(?s)\A\[grade this answer\]\n([^\n]*)\n[^\n]*\n(~~~[0-9a-f]{16})\n(.*)\n\2\z"
SHORT_ANSWER, MAX_POINTS, MIN_SIGNIFICANT = 80, 6, 3


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def unfiltered(values: Column, kind: str) -> Column:
    """`values` (null: none) for explode(), from which the optimizer infers no filter on their number that it would copy to the scan."""
    none = F.array().cast(f"array<{kind}>")
    return F.concat(none, F.coalesce(values, none))


#: Set between matches: a noncharacter, which no text holds.
BREAK = "\uffff"


def all_matches(text: Column, pattern: str, idle: str | None = None) -> Column:
    """Matches of `pattern`, none of them empty, in order: what lies between is cut away, then the text is split. regexp_extract_all takes time with the square of a text's length.

    `idle` is a class of characters at which no match begins: runs of them are cut away at once, not one by one.
    """
    steps = f"({pattern})(?:{idle})*+|(?:{idle})++|(?s:.)" if idle else f"({pattern})|(?s:.)"
    return F.array_remove(F.split(F.regexp_replace(text, steps, "$1" + BREAK), BREAK), "")


def between(text: Column, gaps: str) -> Column:
    """What lies between the matches of `gaps`."""
    return F.array_remove(F.split(text, gaps), "")


def fingerprint(context: Column, question: Column | None = None) -> Column:
    """SHA-1 of context, NUL, question."""
    return F.sha1(F.concat(context, F.char(F.lit(0)), question if question is not None else F.lit("")))


def ledger_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of NUL-terminated parts."""
    return F.substring(F.sha2(F.concat(*[x for p in parts for x in (p, F.char(F.lit(0)))]), 256), 1, 16)


def word_tokens(text: Column) -> Column:
    """Words and single marks, without commas."""
    return F.array_remove(all_matches(text, WORD, NO_WORD), ",")


def ws_tokens(text: Column) -> Column:
    """Runs without white space."""
    return between(text, r"\s+")


def facts(text: Column) -> Column:
    """Numbers, dates, percentages and #tags, in order, repeats kept."""
    return all_matches(text, FACT, NO_FACT)


def sentence_tiles(text: Column) -> Column:
    """Slices that end at sentence ends or newline runs and together are the text."""
    return all_matches(text, TILE)


def split_sentences(text: Column) -> Column:
    """Trimmed sentences; listed abbreviations and single capitals before a digit or bracket end none."""
    for a in ABBREVIATIONS:
        text = F.replace(text, F.lit(a + "."), F.lit(a + GUARD))
    text = F.regexp_replace(text, r"\b([A-Z])\. (?=[\p{Nd}(])", "$1" + GUARD + " ")
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.replace(p, F.lit(GUARD), F.lit(".")))


def key_points(answers: Column) -> Column:
    """Points that must survive: a short first answer itself, else its first sentence and those with a digit, at most MAX_POINTS."""
    trimmed = F.filter(F.transform(answers, lambda a: F.trim(a)), lambda a: a.isNotNull() & (a != ""))
    return let(F.get(trimmed, 0), _points)


def _points(answer: Column) -> Column:

    def of(s: Column) -> Column:
        chosen = F.array_distinct(F.concat(F.slice(s, 1, 1), F.filter(s, lambda x: x.rlike(r"\p{Nd}"))))
        return F.slice(chosen, 1, MAX_POINTS)

    long = let(let(split_sentences(answer), of), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(answer)))
    return F.when(answer.isNull(), F.array().cast("array<string>")).when(F.char_length(answer) <= SHORT_ANSWER, F.array(answer)).otherwise(long)


def significant_words(text: Column) -> Column:
    return F.filter(between(F.lower(text), NOT_ALNUM), lambda w: F.char_length(w) >= MIN_SIGNIFICANT)


def coverage(point: Column, answer_words: Column) -> Column:
    """1 if all significant words of the point are among `answer_words`."""
    return (F.size(F.array_except(significant_words(point), answer_words)) == 0).cast("int")


def judge_reply(points: Column, answer: Column) -> Column:
    """The mechanical judge's JSON reply."""
    scores = F.transform(F.array(significant_words(answer)), lambda w: F.transform(points, lambda p: coverage(p, w)))[0]
    return F.to_json(F.struct(scores.alias("scores")))


def parse_judge(reply: Column, n: Column) -> Column:
    """Scores of a judge's reply: exactly n values of 0 or 1 in its outermost braces; else null. Booleans do not count."""


    def checked(scores: Column) -> Column:
        good = (F.size(scores) == n) & F.forall(scores, lambda s: s.isin(0.0, 1.0))
        return F.when(F.coalesce(good, F.lit(False)), F.transform(scores, lambda s: s.cast("int")))

    return let(F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "scores array<double>")["scores"], checked)


def judge_prompt(points: Column, answer: Column) -> Column:
    """A judge's task: the key points as one line of JSON, the rule, and the answer between fences that it cannot contain (they hold its digest)."""
    fence = F.concat(F.lit(JUDGE_FENCE), F.substring(F.sha2(answer, 256), 1, 16))
    return F.concat_ws("\n", F.lit(JUDGE_MARK), F.to_json(F.struct(points.alias("key_points"))), F.lit(JUDGE_RULE), fence, answer, fence)


def judge_task(points: Sequence[str], answer: str) -> str:
    """The same for one answer, in Python."""
    fence = JUDGE_FENCE + hashlib.sha256(answer.encode("utf-8", "replace")).hexdigest()[:16]
    return "\n".join([JUDGE_MARK, json.dumps({"key_points": list(points)}, ensure_ascii=False, separators=(",", ":")), JUDGE_RULE, fence, answer, fence])


def split_judge_prompt(prompt: Column) -> Column:
    """struct(key_points, answer) of a judge's task; null for any other text."""
    part = lambda k: F.regexp_extract(prompt, JUDGE_TASK, k)
    points = F.from_json(part(1), "key_points array<string>")["key_points"]
    return F.when(prompt.rlike(JUDGE_TASK), F.struct(points.alias("key_points"), part(3).alias("answer")))


def stub_reply(prompt: Column, model: str) -> Column:
    """What the stand-in model says: the mechanical grades of a judge's task, else the prompt behind its own name."""
    graded = lambda task: judge_reply(task["key_points"], task["answer"])
    return F.when(prompt.rlike(JUDGE_TASK), let(split_judge_prompt(prompt), graded)).otherwise(F.concat(F.lit(f"[stub:{model}] "), prompt))


def mean_score(scores: Column) -> Column:
    """Mean of 0/1 scores; 0 without any."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, s: a + s.cast("double"))
    return let(scores, lambda xs: F.when(F.size(xs) > 0, total(xs) / F.size(xs)).otherwise(F.lit(0.0)))


def dropped_per_ten(level: float) -> int:
    """Words dropped of each ten, half to even."""
    return round(10 * level)


def compress_words(words: Column, drop: Column | int) -> Column:
    """Drop the first `drop` of each ten words; one word survives at least."""
    drop = F.lit(drop) if isinstance(drop, int) else drop
    kept = lambda ws: F.filter(ws, lambda w, i: i % 10 >= drop)
    return let(words, lambda ws: let(kept(ws), lambda k: F.when(F.size(k) > 0, k).otherwise(F.slice(ws, 1, 1))))


def stub_compress(text: Column, drop: Column | int) -> Column:
    return F.array_join(compress_words(ws_tokens(text), drop), " ")


def fact_recall(original: Column, compressed: Column) -> Column:
    """Share of the original's facts that the compressed text contains; 1 without facts."""
    return recall_of(facts(original), compressed)


def recall_of(found: Column, compressed: Column) -> Column:
    """The same for facts that have been extracted."""
    kept = lambda fs: F.size(F.filter(fs, lambda f: F.contains(compressed, f))).cast("double")
    return let(found, lambda fs: F.when(F.size(fs) == 0, F.lit(1.0)).otherwise(kept(fs) / F.size(fs)))


def f05(overlap: Column, n_original: Column, n_compressed: Column) -> Column:
    """F0.5 of a multiset overlap; 0 for an empty compressed text, an error for an empty original."""
    p, r = overlap.cast("double") / F.nullif(n_compressed, F.lit(0)), overlap.cast("double") / F.nullif(n_original, F.lit(0))
    score = F.lit(1.25) * p * r / F.nullif(F.lit(0.25) * p + r, F.lit(0.0))
    return F.when(n_original <= 0, F.raise_error("the original has no tokens")).otherwise(F.coalesce(score, F.lit(0.0)))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of words, of any length: their hashes are counted in slices of Arrow batches, row by row, without a shuffle."""

    def counted(part: pa.RecordBatch) -> np.ndarray:
        rows = [np.repeat(np.arange(part.num_rows), lengths(side)) for side in part.columns]
        row, word = np.concatenate(rows), np.concatenate([side.flatten().to_numpy(zero_copy_only=False) for side in part.columns])
        order = np.lexsort((word, row))
        row, word, own = row[order], word[order], (order < len(rows[0]))
        starts = np.flatnonzero((np.diff(row, prepend=-1) != 0) | np.concatenate([[True], word[1:] != word[:-1]])[: len(row)])
        if not len(starts):
            return np.zeros(part.num_rows, np.int64)
        n, ours = np.diff(np.append(starts, len(row))), np.add.reduceat(own.astype(np.int64), starts)
        return np.bincount(row[starts], weights=np.minimum(ours, n - ours), minlength=part.num_rows).astype(np.int64)

    @F.arrow_udf("long")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([left, right], ["a", "b"])
        return pa.array(np.concatenate([np.empty(0, np.int64), *map(counted, slices([batch], "a", "b"))]), pa.int64())

    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    return run(hashed(a), hashed(b))


def kept_ratio(original: Column, compressed: Column) -> Column:
    return F.when(original <= 0, F.raise_error("the original has no tokens")).otherwise(compressed.cast("double") / original)


def fill_template(template: Column, slots: Column) -> Column:
    """Replace {key} by value for each entry of a map."""
    return F.aggregate(F.map_entries(slots), template, lambda s, e: F.replace(s, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def hash_pick(n: Column, *key: Column) -> Column:
    """A reproducible index below n: the first 32 bits of a SHA-256 of the colon-joined key, modulo n."""
    return (F.conv(F.substring(F.sha2(F.concat_ws(":", *[k.cast("string") for k in key]), 256), 1, 8), 16, 10).cast("long") % n).cast("int")


#: Own wording, by load type.
TASKS = {
    "rag": "Use the passages below to answer the question they end with.",
    "system_prompt": "Acknowledge the instructions below and list the rules you will follow.",
    "dialogue": "Continue the conversation below with the assistant's next turn.",
}
#: Own wording, by prompt kind; the summary needs no question.
PROMPTS = {"answer": "Passage:\n{context}\n\nQuestion: {question}\nAnswer:", "summary": "Report:\n{context}\n\nSummary:", "lookup": "Records:\n{context}\n\nFind: {question}\nFound:"}


def task_prompt(load_type: Column, payload: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TASKS.items() for x in kv])
    return F.concat(F.coalesce(F.element_at(table, load_type), F.raise_error(F.concat(F.lit("unknown load type "), load_type))), F.lit("\n\n"), payload)


def render_prompt(kind: Column, context: Column, question: Column) -> Column:
    out = F.raise_error(F.concat(F.lit("unknown prompt kind "), kind))
    for k, template in PROMPTS.items():
        head, _, tail = template.partition("{context}")
        middle, _, last = tail.partition("{question}")
        parts = [F.lit(head), context, F.lit(middle)] + ([question, F.lit(last)] if "{question}" in template else [])
        out = F.when(kind == k, F.concat(*parts)).otherwise(out)
    return out


def serialize_turns(turns: Column) -> Column:
    """array<struct<turn, role, text>> -> 'role: text' lines in order of turn."""
    return F.array_join(F.transform(F.array_sort(turns), lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")


def error_list(*checks: tuple[Column, str]) -> Column:
    """Messages of the checks that hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(message)) for bad, message in checks]))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(text), F.lit(w.lower()))
    return out
