"""Explicit schemas of the record files."""

from __future__ import annotations

SOURCE = "input string, context string, answers array<string>, length int"
GOLDEN = (
    "id string, load_type string, prompt string, key_points array<string>, "
    "source struct<dataset:string,subset:string,license:string,split:string,content_sha1:string,family:string,seed:int,answers:array<string>>"
)
CORPUS = (
    "id string, load_type string, prompt string, question string, task string, "
    "source struct<dataset:string,subset:string,license:string,split:string,content_sha1:string,family:string,seed:int>"
)
LABELED = (
    "id string, entry_id string, load_type string, prompt string, compressed_text string, chunk struct<index:int,start:int,end:int,entry_chars:int>, "
    "tokens array<struct<text:string,start:int,end:int,keep:int>>, metrics struct<word_compressed_rate:double,find_rate:double,variation_rate:double,hitting_rate:double,matching_rate:double,alignment_gap:double>"
)
JOURNAL = "kind string, item string, level double, payload string, answer string, scores array<int>, served string"
JOURNAL_COLUMNS = ("kind", "item", "level", "payload", "answer", "scores", "served")
CORRUPT = "_corrupt"
