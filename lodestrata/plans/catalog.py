"""Registered queries over the supplied tables, with their DuckDB equivalents.

`documents` are source rows (question "", subset = source), `benchmark` exam items,
`conversations` dialogue prompts and a journal. Every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..functions import text as T
from ..operators import corpus, distill, evaluate, ledger, splits, stats, synth, windows
from ..partitions import spread
from ..sources import records

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
LEVELS = (0.1, 0.2, 0.3, 0.4, 0.5)
BUDGETS = {"en": 400, "de": 60, "fr": 45, "es": 30}
RUNS = 200


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "text", "lang", F.col("source").alias("subset"), T.fingerprint(F.col("text")).alias("fp"))


def lit(s: str) -> str:
    """A DuckDB string literal."""
    return "'" + s.replace("'", "''") + "'"


class Fragment(str):
    """SQL with one hole, {0}."""

    def format(self, inner: str) -> str:
        return self.replace("{0}", inner)


# ---- SQL fragments

SRC = "src AS (SELECT doc_id, text, lang, source AS subset, sha1(text || chr(0)) AS fp FROM documents)"
WS = Fragment(r"regexp_extract_all({0}, '\S+')")
WORDS = Fragment(f"list_filter(regexp_extract_all({{0}}, {lit(T.WORD)}), lambda x: x <> ',')")
FACTS = Fragment(f"regexp_extract_all({{0}}, {lit(T.FACT)})")
SPLIT = (
    SRC + ", k AS (SELECT DISTINCT subset, fp FROM src), "
    "sp AS (SELECT subset, fp, row_number() OVER w AS rank, count(*) OVER (PARTITION BY subset) AS n, "
    "CASE WHEN ntile(2) OVER w = 1 THEN 'eval' ELSE 'train' END AS half FROM k WINDOW w AS (PARTITION BY subset ORDER BY fp)), "
    "bd AS (SELECT subset, count(*) FILTER (half = 'eval') AS eval_half, count(*) FILTER (half = 'train') AS train_half, min(fp) FILTER (half = 'train') AS boundary FROM sp GROUP BY subset)"
)


def kept_words(words: str, drop: int | str) -> str:
    return f"CASE WHEN len(list_filter({words}, lambda x, i: (i - 1) % 10 >= {drop})) > 0 THEN list_filter({words}, lambda x, i: (i - 1) % 10 >= {drop}) ELSE {words}[1:1] END"


def recall(original: str, compressed: str) -> str:
    f = FACTS.format(original)
    return f"CASE WHEN len({f}) = 0 THEN 1.0::DOUBLE ELSE len(list_filter({f}, lambda f: contains({compressed}, f)))::DOUBLE / len({f}) END"


def significant(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: length(w) >= 3)"


def sentences(text: str) -> str:
    for a in T.ABBREVIATIONS:
        text = f"replace({text}, {lit(a + '.')}, {lit(a + T.GUARD)})"
    text = f"regexp_replace({text}, '\\b([A-Z])\\. ([\\p{{Nd}}(])', '\\1{T.GUARD} \\2', 'g')"
    parts = f"string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    trimmed = f"list_transform({parts}, lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g'))"
    return f"list_transform(list_filter({trimmed}, lambda p: p <> ''), lambda p: replace(p, {lit(T.GUARD)}, '.'))"


# ---- text functions

@query("SELECT doc_id, sha1(text || chr(0)) AS fp FROM documents")
def fingerprint_docs(spark, d):
    return source_rows(spark, d).select("doc_id", "fp")


@query(f"SELECT doc_id, len({FACTS.format('text')})::BIGINT AS n_facts, array_to_string({FACTS.format('text')}, '|') AS facts FROM documents")
def facts_extract(spark, d):
    f = T.facts(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(f).cast("long").alias("n_facts"), F.array_join(f, "|").alias("facts"))


@query(f"SELECT doc_id, len({WORDS.format('text')})::BIGINT AS n_words, md5(array_to_string({WORDS.format('text')}, ' ')) AS words_md5 FROM documents")
def word_tokens(spark, d):
    w = table(spark, d, "documents").select("doc_id", T.word_tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5"))


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tiles, array_to_string(t, '') = text AS lossless FROM (SELECT doc_id, text, list_filter(regexp_extract_all(text, {lit(T.TILE)}), lambda x: x <> '') AS t FROM documents)")
def sentence_tiles(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text", T.sentence_tiles(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tiles"), (F.array_join("t", "") == F.col("text")).alias("lossless"))


@query(f"SELECT doc_id, len({WS.format('text')})::BIGINT AS n_tokens FROM documents")
def ws_token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.ws_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"SELECT doc_id, len(w)::BIGINT AS n_words, len(list_distinct(w))::BIGINT AS n_distinct FROM (SELECT doc_id, {significant('text')} AS w FROM documents)")
def significant_words(spark, d):
    w = table(spark, d, "documents").select("doc_id", T.significant_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query(f"SELECT doc_id, md5(array_to_string({kept_words('w', 3)}, ' ')) AS compressed_md5 FROM (SELECT doc_id, {WS.format('text')} AS w FROM documents)")
def stub_compress(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.stub_compress(F.col("text"), T.dropped_per_ten(0.3))).alias("compressed_md5"))


@query("SELECT conv_id, count(*) AS n_turns, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS prompt_md5 FROM conversations GROUP BY conv_id")
def conversation_prompts(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.collect_list(F.struct("turn", "role", "text")).alias("t"))
    return g.select("conv_id", "n_turns", F.md5(T.serialize_turns(F.col("t"))).alias("prompt_md5"))


@query(f"SELECT item_id, len(s)::BIGINT AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM (SELECT item_id, {sentences('text')} AS s FROM benchmark)")
def split_sentences(spark, d):
    s = table(spark, d, "benchmark").select("item_id", T.split_sentences(F.col("text")).alias("s"))
    return s.select("item_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


POINTS = f"""s AS (SELECT doc_id, trim(text) AS a, {sentences('trim(text)')} AS s FROM documents WHERE text IS NOT NULL AND trim(text) <> ''),
p0 AS (SELECT doc_id, a, s, list_concat(s[1:1], list_filter(s, lambda x: regexp_matches(x, '\\p{{Nd}}'))) AS c FROM s),
p AS (SELECT doc_id, CASE WHEN length(a) <= 80 THEN [a] WHEN len(c) > 0 THEN
  list_filter(c, lambda x, i: list_position(c, x) = i)[1:6] ELSE [a] END AS points FROM p0)"""


@query(f"WITH {POINTS} SELECT d.doc_id, coalesce(len(points), 0)::BIGINT AS n_points, coalesce(md5(array_to_string(points, '|')), md5('')) AS points_md5 FROM documents d LEFT JOIN p USING (doc_id)")
def key_points(spark, d):
    p = table(spark, d, "documents").select("doc_id", T.key_points(F.array("text")).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n_points"), F.md5(F.array_join("p", "|")).alias("points_md5"))


@query("SELECT conv_id, turn, substr(sha256(role || chr(0) || text || chr(0)), 1, 16) AS ledger_id FROM conversations")
def ledger_ids(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.ledger_id(F.col("role"), F.col("text")).alias("ledger_id"))


@query("SELECT conv_id, turn, md5(" + "CASE role WHEN 'system' THEN " + lit(T.TASKS["system_prompt"]) + " WHEN 'user' THEN " + lit(T.TASKS["rag"]) + " ELSE " + lit(T.TASKS["dialogue"]) + " END || chr(10) || chr(10) || text) AS prompt_md5 FROM conversations")
def task_prompts(spark, d):
    kind = F.when(F.col("role") == "system", "system_prompt").when(F.col("role") == "user", "rag").otherwise("dialogue")
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.task_prompt(kind, F.col("text"))).alias("prompt_md5"))


@query("SELECT conv_id, turn, md5(CASE role WHEN 'user' THEN replace(replace(" + lit(T.PROMPTS["answer"]) + ", '{question}', role), '{context}', text) WHEN 'assistant' THEN replace(replace(" + lit(T.PROMPTS["lookup"]) + ", '{question}', role), '{context}', text) ELSE replace(" + lit(T.PROMPTS["summary"]) + ", '{context}', text) END) AS prompt_md5 FROM conversations")
def rendered_prompts(spark, d):
    kind = F.when(F.col("role") == "user", "answer").when(F.col("role") == "assistant", "lookup").otherwise("summary")
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.render_prompt(kind, F.col("text"), F.col("role"))).alias("prompt_md5"))


@query(f"""WITH p AS (SELECT conv_id, turn, text, substr(text, 1, 60) AS p FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '{{"scores":[' || (len(list_filter({significant('p')}, lambda x: NOT list_contains({significant('text')}, x))) = 0)::INT || ',0]}}' ELSE md5('[stub:m] ' || text) END AS reply FROM p""")
def stub_replies(spark, d):
    """Even turns are a judge's task over the turn's own start and a point that nothing covers, odd ones a plain prompt."""
    points = F.array(F.substring("text", 1, 60), F.lit("zzz qqq"))
    prompt = F.when(F.col("turn") % 2 == 0, T.judge_prompt(points, F.col("text"))).otherwise(F.col("text"))
    reply = T.stub_reply(prompt, "m")
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, reply).otherwise(F.md5(reply)).alias("reply"))


# ---- splits

@query(f"WITH {SPLIT} SELECT subset, fp, rank, n, half FROM sp")
def half_split(spark, d):
    return splits.half_split(source_rows(spark, d))


@query(f"WITH {SPLIT} SELECT subset, eval_half, train_half, boundary FROM bd")
def split_boundary(spark, d):
    return splits.boundary(splits.half_split(source_rows(spark, d)))


def halves(spark, d):
    rows = source_rows(spark, d)
    return splits.first_of(rows.join(splits.half_split(rows).select("subset", "fp", "half"), ["subset", "fp"]), ["subset", "fp"], [F.col("doc_id")])


HALVES = SPLIT + ", hv AS (SELECT * EXCLUDE rn FROM (SELECT src.*, half, row_number() OVER (PARTITION BY subset, fp ORDER BY doc_id) AS rn FROM src JOIN sp USING (subset, fp)) WHERE rn = 1)"


@query(f"WITH {HALVES} SELECT doc_id, subset, fp FROM hv WHERE half = 'train'")
def train_half_dedup(spark, d):
    return halves(spark, d).filter("half = 'train'").select("doc_id", "subset", "fp")


@query(f"WITH {HALVES} SELECT t.doc_id AS train_id, g.doc_id AS golden_id, fp FROM hv t JOIN hv g USING (fp) WHERE t.half = 'train' AND g.half = 'eval'")
def golden_overlap_inner(spark, d):
    h = halves(spark, d)
    train, golden = h.filter("half = 'train'").select("fp", F.col("doc_id").alias("train_id")), h.filter("half = 'eval'").select("fp", F.col("doc_id").alias("golden_id"))
    return splits.overlap(train, golden).select("train_id", "golden_id", "fp")


@query(f"WITH {HALVES} SELECT doc_id, fp FROM hv t WHERE half = 'train' AND NOT EXISTS (SELECT 1 FROM hv g WHERE g.half = 'eval' AND g.fp = t.fp)")
def train_minus_golden_anti(spark, d):
    h = halves(spark, d)
    return splits.without(h.filter("half = 'train'").select("doc_id", "fp"), h.filter("half = 'eval'"))


@query(f"WITH {SPLIT} SELECT subset, count(*) - count(DISTINCT fp) AS shared FROM sp GROUP BY subset")
def split_disjointness(spark, d):
    return splits.half_split(source_rows(spark, d)).groupBy("subset").agg((F.count(F.lit(1)) - F.count_distinct("fp")).alias("shared"))


@query("SELECT conv_id, role, turn, md5(text) AS text_md5 FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1")
def last_write_wins(spark, d):
    return ledger.latest(table(spark, d, "conversations"), ["conv_id", "role"], "turn").select("conv_id", "role", "turn", F.md5("text").alias("text_md5"))


@query(f"WITH {HALVES} SELECT subset, fp, doc_id FROM hv WHERE half = 'eval' QUALIFY row_number() OVER (PARTITION BY subset ORDER BY sha256('17:' || fp), fp) <= 5")
def sample_per_subset(spark, d):
    return splits.sample_per_subset(halves(spark, d).filter("half = 'eval'").select("subset", "fp", "doc_id"), 5, 17)


@query(f"WITH {HALVES}, s AS (SELECT subset, fp FROM hv WHERE half = 'eval' QUALIFY row_number() OVER (PARTITION BY subset ORDER BY sha256('17:' || fp), fp) <= 5) SELECT subset, fp FROM s EXCEPT ALL SELECT subset, fp FROM hv WHERE half = 'eval' AND substr(fp, 1, 1) < '8'")
def sample_outside(spark, d):
    """Sampled rows that are not among the eval rows of the first half of fingerprints."""
    h = halves(spark, d).filter("half = 'eval'").select("subset", "fp")
    return splits.outside(splits.sample_per_subset(h, 5, 17), h.filter("fp < '8'"))


# ---- corpus

@query(f"WITH {HALVES} SELECT 'train-' || subset || '-' || substr(fp, 1, 8) AS id, 'rag' AS load_type, md5(text) AS prompt_md5, '' AS question, subset, 'train' AS split, fp AS content_sha1 FROM hv WHERE half = 'train'")
def corpus_entries(spark, d):
    e = corpus.build_entries(halves(spark, d).filter("half = 'train'").withColumnRenamed("text", "prompt"), "documents", "public")
    return e.select("id", "load_type", F.md5("prompt").alias("prompt_md5"), "question", "source.subset", "source.split", "source.content_sha1")


#: Subsets that the example registry leaves out or forbids.
MISSING, FORBIDDEN = "src7", "src3"


def registry(spark, d):
    b = splits.boundary(splits.half_split(source_rows(spark, d)))
    return b.filter(F.col("subset") != MISSING).select("subset", F.lit("public").alias("license"), (F.col("subset") != FORBIDDEN).alias("train_use"), "boundary")


REGISTRY = SPLIT + f", rg AS (SELECT subset, subset <> '{FORBIDDEN}' AS train_use, boundary FROM bd WHERE subset <> '{MISSING}'), " \
    "oc AS (SELECT src.*, boundary, CASE WHEN train_use IS NULL THEN 'unknown' WHEN NOT train_use THEN 'excluded' ELSE 'registered' END AS outcome FROM src LEFT JOIN rg USING (subset))"


def candidate_rows(spark, d):
    rows = source_rows(spark, d).select(
        "doc_id", F.concat_ws("-", F.lit("train"), "subset", F.substring("fp", 1, 8)).alias("id"), F.when(F.col("lang") == "es", "story").otherwise("rag").alias("load_type"),
        F.col("text").alias("prompt"), F.lit("").alias("question"), F.when(F.col("subset") == "src5", "MeetingBank").otherwise("documents").alias("dataset"), "subset",
        F.when(F.col("lang") == "fr", "private").otherwise("public").alias("license"), F.when(F.col("subset") == "src9", "eval").otherwise("train").alias("split"), "fp",
    )
    return corpus.registry_outcome(rows, registry(spark, d))


@query(f"WITH {REGISTRY}" + """, e AS (SELECT doc_id, list_filter([
  CASE WHEN lang = 'es' THEN 'load_type is not known' END, CASE WHEN trim(text) = '' THEN 'prompt is empty' END, CASE WHEN subset = 'src5' THEN 'source is excluded' END,
  CASE WHEN subset = 'src9' THEN 'split is not train' END, CASE outcome WHEN 'unknown' THEN 'subset is not registered' WHEN 'excluded' THEN 'subset must not be trained on' END,
  CASE WHEN lang = 'fr' AND outcome <> 'unknown' THEN 'license differs from the registry' END,
  CASE WHEN outcome = 'registered' AND NOT coalesce(fp >= boundary, false) THEN 'fingerprint is not in the train half' END], lambda x: x IS NOT NULL) AS e FROM oc)
SELECT doc_id, len(e)::BIGINT AS n_errors, array_to_string(e, '; ') AS errors FROM e""")
def corpus_errors(spark, d):
    e = candidate_rows(spark, d).withColumn("e", corpus.row_errors())
    return e.select("doc_id", F.size("e").cast("long").alias("n_errors"), F.array_join("e", "; ").alias("errors"))


@query(f"WITH {REGISTRY}" + ", e AS (SELECT doc_id, 'subset is not registered' AS m FROM oc WHERE outcome = 'unknown') SELECT min(doc_id) || ': ' || min(m) AS first, count(*) - 1 AS more FROM e")
def first_error(spark, d):
    e = candidate_rows(spark, d).filter("outcome = 'unknown'").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(": subset is not registered")).alias("m"))
    return corpus.first_error(e, "doc_id", "m")


@query(f"WITH {REGISTRY} SELECT subset, outcome, count(*) AS n FROM oc GROUP BY ALL")
def registry_outcomes(spark, d):
    return candidate_rows(spark, d).groupBy("subset", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {HALVES}, a AS (SELECT subset, count(*) AS actual FROM hv GROUP BY subset), x AS (SELECT subset, count(*) AS expected FROM src GROUP BY subset) SELECT subset, coalesce(actual, 0) AS actual, coalesce(expected, 0) AS expected FROM a FULL JOIN x USING (subset) WHERE coalesce(actual, 0) <> coalesce(expected, 0)")
def subset_reconciliation(spark, d):
    return corpus.reconcile(halves(spark, d), source_rows(spark, d).groupBy("subset").agg(F.count(F.lit(1)).alias("entries")))


@query("SELECT lang AS load_type, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct FROM documents GROUP BY lang")
def mix_pct(spark, d):
    return corpus.mix_percent(table(spark, d, "documents").withColumnRenamed("lang", "load_type"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source), (lang))")
def counts_by_subset_and_type(spark, d):
    return corpus.counts_by(table(spark, d, "documents"), "source", "lang")


@query(f"SELECT doc_id, n FROM (SELECT doc_id, len({WS.format('text')})::BIGINT AS n, lang FROM documents) WHERE n BETWEEN 100 AND 400 AND trim(lang) <> ''")
def token_band_filter(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.size(T.ws_tokens(F.col("text"))).cast("long").alias("n"), F.array("lang").alias("a"))
    return corpus.in_band(rows, "n", 100, 400, "a").select("doc_id", "n")


@query(f"""WITH {POINTS}, e AS (SELECT d.doc_id, list_filter([CASE WHEN lang = 'es' THEN 'load_type is not known' END, CASE WHEN trim(text) = '' THEN 'prompt is empty' END,
  CASE WHEN points IS NULL THEN 'key_points are empty' END, CASE WHEN source = 'src9' THEN 'split is not eval' END], lambda x: x IS NOT NULL) AS e FROM documents d LEFT JOIN p USING (doc_id))
SELECT doc_id, array_to_string(e, '; ') AS errors FROM e WHERE len(e) > 0""")
def golden_errors(spark, d):
    g = table(spark, d, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("id"), F.when(F.col("lang") == "es", "story").otherwise("rag").alias("load_type"), F.col("text").alias("prompt"),
        T.key_points(F.array("text")).alias("key_points"), F.when(F.col("source") == "src9", "train").otherwise("eval").alias("split"),
    )
    return g.withColumn("e", corpus.golden_errors()).filter(F.size("e") > 0).select("doc_id", F.array_join("e", "; ").alias("errors"))


@query(f"WITH {SRC} SELECT doc_id, fp, f AS first_pos FROM (SELECT doc_id, fp, min(doc_id) OVER (PARTITION BY fp) AS f FROM src) WHERE doc_id > f")
def duplicate_rows(spark, d):
    return corpus.duplicates(source_rows(spark, d).select("doc_id", "fp"), "fp", "doc_id")


# ---- evaluation

ITEM = f"""it AS (SELECT doc_id, lang, text, len(w)::BIGINT AS tokens_original, len(k)::BIGINT AS tokens_compressed, array_to_string(k, ' ') AS compressed
  FROM (SELECT doc_id, lang, text, w, {kept_words('w', 2)} AS k FROM (SELECT doc_id, lang, text, {WS.format('text')} AS w FROM documents)))"""


def nonblank(spark, d):
    return table(spark, d, "documents").filter(F.col("text").rlike(r"\S"))


@query(f"WITH {ITEM} SELECT doc_id, tokens_original, tokens_compressed, tokens_compressed::DOUBLE / tokens_original AS kept_ratio, 1 - tokens_compressed::DOUBLE / tokens_original AS removed, {recall('text', 'compressed')} AS fact_recall FROM it WHERE tokens_original > 0")
def eval_items(spark, d):
    items = evaluate.item_metrics(evaluate.sweep(nonblank(spark, d), [0.2]))
    return items.select("doc_id", "tokens_original", "tokens_compressed", "kept_ratio", "removed", "fact_recall")


SWEEP = f"""lv(level, dr) AS (VALUES {", ".join(f"({v}::DOUBLE, {T.dropped_per_ten(v)})" for v in LEVELS)}),
w AS (SELECT doc_id, lang, text, {WS.format('text')} AS w FROM documents),
sw AS (SELECT doc_id, lang, text, level, w, {kept_words('w', 'dr')} AS k FROM w, lv WHERE len(w) > 0),
m AS (SELECT doc_id, lang, level, len(w)::BIGINT AS o, len(k)::BIGINT AS c, len(k)::DOUBLE / len(w) AS kr, {recall('text', "array_to_string(k, ' ')")} AS fr FROM sw)"""
AGG = "count(*) AS n_items, sum(o)::BIGINT AS sum_original, sum(c)::BIGINT AS sum_compressed, sum(c)::DOUBLE / sum(o) AS kept_micro, round(avg(kr), 9) AS kept_macro, round(avg(fr), 9) AS mean_fact_recall, quantile_cont(kr, 0.95) AS kept_p95"


@query(f"WITH {SWEEP} SELECT level, {AGG} FROM m GROUP BY level")
def eval_levels_sweep(spark, d):
    return evaluate.aggregate(evaluate.item_metrics(evaluate.sweep(evaluate.prepare(nonblank(spark, d)).drop("text"), LEVELS), bare=True), "level")


def f05_sql(pairs: str) -> str:
    """CTEs from (doc_id, a, b) word lists."""
    return f"""o AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(a) AS x FROM {pairs}) GROUP BY ALL),
c AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(b) AS x FROM {pairs}) GROUP BY ALL),
ov AS (SELECT o.doc_id, sum(least(o.n, coalesce(c.n, 0)))::DOUBLE AS v FROM o LEFT JOIN c ON o.doc_id = c.doc_id AND o.x = c.x GROUP BY o.doc_id),
ff AS (SELECT doc_id, CASE WHEN v = 0 THEN 0.0 ELSE 1.25 * (v / len(b)) * (v / len(a)) / (0.25 * (v / len(b)) + v / len(a)) END AS f FROM {pairs} JOIN ov USING (doc_id))"""


@query(f"WITH {ITEM}, pr AS (SELECT doc_id, {WORDS.format('text')} AS a, {WORDS.format('compressed')} AS b FROM it), {f05_sql('pr')} SELECT doc_id, round(f, 9) AS token_f05 FROM ff")
def token_f05_docs(spark, d):
    items = evaluate.item_metrics(evaluate.sweep(nonblank(spark, d), [0.2]))
    return evaluate.document_f05(items, "text", "compressed", wordless=False).select("doc_id", F.round("token_f05", 9).alias("token_f05"))


@query(f"""WITH {SRC}, f1 AS (SELECT doc_id, text, lang, fp FROM src QUALIFY row_number() OVER (PARTITION BY fp ORDER BY doc_id) = 1),
ev AS (SELECT doc_id, text, lang FROM f1 QUALIFY ntile(2) OVER (ORDER BY fp) = 1),
w AS (SELECT doc_id, lang, text, {WS.format('text')} AS w FROM ev), kk AS (SELECT *, {kept_words('w', 2)} AS k FROM w WHERE len(w) > 0),
pr AS (SELECT doc_id, {WORDS.format('text')} AS a, {WORDS.format("array_to_string(k, ' ')")} AS b FROM kk), {f05_sql('pr')},
m AS (SELECT doc_id, lang, len(w)::BIGINT AS o, len(k)::BIGINT AS c, len(k)::DOUBLE / len(w) AS kr, {recall('text', "array_to_string(k, ' ')")} AS fr, f FROM kk LEFT JOIN ff USING (doc_id))
SELECT lang, {AGG}, round(avg(f), 9) AS mean_token_f05 FROM m GROUP BY lang""")
def eval_level_by_lang(spark, d):
    """The flagship: deduplicate, keep the eval half, compress at 0.2, measure, aggregate by language."""
    # only fingerprints and ids are split and deduplicated; texts move once, to the chosen ids
    firsts = cut(source_rows(spark, d).groupBy("fp").agg(F.min("doc_id").alias("doc_id")).withColumn("subset", F.lit("all")))
    chosen = firsts.join(splits.half_split(firsts).filter("half = 'eval'").select("fp"), "fp").select("doc_id")
    items = evaluate.item_metrics(evaluate.sweep(nonblank(spark, d).join(chosen, "doc_id", "left_semi"), [0.2]))
    scored = evaluate.document_f05(items, "text", "compressed").drop("text", "compressed")
    return evaluate.aggregate(scored, "lang", more=[F.round(F.avg("token_f05"), 9).alias("mean_token_f05")])


@query(f"WITH n AS (SELECT lang, len({WS.format('text')}) AS n FROM documents) SELECT lang, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.95) AS p95, round(coalesce(var_samp(n), 0), 6) AS variance, round(avg(n), 4) AS mean FROM n GROUP BY lang")
def length_percentiles(spark, d):
    n = table(spark, d, "documents").select("lang", F.size(T.ws_tokens(F.col("text"))).alias("n"))
    n = cut(n)
    moments = n.groupBy("lang").agg(F.round(stats.sample_variance("n"), 6).alias("variance"), stats.rounded_mean("n").alias("mean"))
    return stats.with_percentiles(moments, n, ["lang"], {"p50": ("n", 50), "p95": ("n", 95)})


def deltas(spark, d):
    """(lang, id, delta): how much shorter than expected each document gets at 0.3, to 4 places."""
    share = F.char_length(T.stub_compress(F.col("text"), 3)).cast("double") / F.char_length("text")
    return nonblank(spark, d).select("lang", F.col("doc_id").alias("id"), F.round(share - 0.7, 4).alias("delta"))


DELTAS = f"""dl AS (SELECT lang, doc_id AS id, round(length(array_to_string({kept_words('w', 3)}, ' '))::DOUBLE / length(text) - 0.7::DOUBLE, 4) AS delta
  FROM (SELECT lang, doc_id, text, {WS.format('text')} AS w FROM documents) WHERE len(w) > 0)"""


@query(f"""WITH {DELTAS}, g AS (SELECT lang, grouping(lang) = 1 AS overall, count(*) AS n_observed, avg(delta) AS m, sqrt(coalesce(var_samp(delta), 0)) AS s FROM dl GROUP BY ROLLUP (lang))
SELECT lang, overall, n_observed, round(m, 9) AS mean_delta, round(s, 9) AS std_delta, round(m / nullif(s, 0), 6) AS cohens_d,
 CASE WHEN s <> 0 AND m <> 0 THEN ceil(pow((1.6449::DOUBLE + 0.8416::DOUBLE) * s / abs(m), 2))::BIGINT END AS n_required, s = 0 OR m = 0 AS degenerate FROM g""")
def sizing_rollup(spark, d):
    s = stats.sizing(deltas(spark, d), "lang")
    return s.select("lang", "overall", "n_observed", F.round("mean_delta", 9).alias("mean_delta"), F.round("std_delta", 9).alias("std_delta"), F.round("cohens_d", 6).alias("cohens_d"), "n_required", "degenerate")


MEANS = f"""a AS (SELECT lang, list(delta ORDER BY id) AS v, count(*) AS n FROM dl GROUP BY lang),
rs AS (SELECT lang, r, avg(v[(('0x' || substr(md5('7:' || r || ':' || i), 1, 8))::BIGINT % n)::INT + 1]) AS mean FROM a, range({RUNS}) t(r), LATERAL (SELECT unnest(range(n)) AS i) GROUP BY lang, r),
ob AS (SELECT lang, avg(delta) AS m, count(*) AS n FROM dl GROUP BY lang)"""


@query(f"WITH {DELTAS}, {MEANS} SELECT lang, round(any_value(m), 9) AS mean_delta, any_value(n) AS n_items, round(quantile_cont(mean, 0.025), 9) AS ci_low, round(quantile_cont(mean, 0.975), 9) AS ci_high FROM rs JOIN ob USING (lang) GROUP BY lang")
def bootstrap_ci_hash(spark, d):
    b = stats.bootstrap(deltas(spark, d), "lang", resamples=RUNS, seed=7)
    return b.select("lang", F.round("mean_delta", 9).alias("mean_delta"), "n_items", F.round("ci_low", 9).alias("ci_low"), F.round("ci_high", 9).alias("ci_high"))


@query(f"WITH {DELTAS}, {MEANS} SELECT lang, round(list(mean ORDER BY mean)[{int(0.025 * RUNS) + 1}], 9) AS ci_low, round(list(mean ORDER BY mean)[{int(0.975 * RUNS)}], 9) AS ci_high FROM rs GROUP BY lang")
def bootstrap_ci_order_stat(spark, d):
    b = stats.bootstrap(deltas(spark, d), "lang", resamples=RUNS, seed=7, bounds="order")
    return b.select("lang", F.round("ci_low", 9).alias("ci_low"), F.round("ci_high", 9).alias("ci_high"))


@query()
def bootstrap_ci_parity(spark, d):
    return stats.seeded_bootstrap(deltas(spark, d), "lang", resamples=100)


JUDGED = f"""{POINTS}, w AS (SELECT doc_id, lang, {WS.format('text')} AS w, {significant('text')} AS sw FROM documents),
jd AS (SELECT doc_id, lang, points, sw, {significant("array_to_string(" + kept_words('w', 4) + ", ' ')")} AS cw FROM w JOIN p USING (doc_id)),
cov AS (SELECT doc_id, lang, len(list_filter(points, lambda q: len(list_filter({significant('q')}, lambda x: NOT list_contains(sw, x))) = 0))::DOUBLE / len(points) AS original,
  len(list_filter(points, lambda q: len(list_filter({significant('q')}, lambda x: NOT list_contains(cw, x))) = 0))::DOUBLE / len(points) AS compressed FROM jd)"""


@query(f"WITH {JUDGED} SELECT doc_id, original, compressed, round(compressed - original, 4) AS delta FROM cov")
def task_quality_delta(spark, d):
    return quality_rows(spark, d).select("doc_id", "original", "compressed", "delta")


def quality_rows(spark, d):
    items = nonblank(spark, d).select("doc_id", "lang", "text", T.key_points(F.array("text")).alias("points"), T.stub_compress(F.col("text"), 4).alias("short"))
    both = evaluate.judged(evaluate.judged(items, "points", "text", "original"), "points", "short", "compressed")
    return both.withColumn("delta", F.round(F.col("compressed") - F.col("original"), 4))


@query(f"WITH {JUDGED} SELECT lang, count(*) AS n, round(avg(original), 9) AS mean_original, round(avg(compressed), 9) AS mean_compressed, round(avg(round(compressed - original, 4)), 9) AS mean_delta FROM cov GROUP BY lang")
def task_quality_by_lang(spark, d):
    return quality_rows(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 9).alias(f"mean_{c}") for c in ("original", "compressed", "delta")])


@query("""WITH r AS (SELECT conv_id, turn, length(text) % 3 AS a, length(text) % 2 AS b, turn % 4 AS k FROM conversations)
SELECT conv_id, turn, CASE WHEN k < 2 AND a < 2 THEN a || ',' || b || ',1' END AS scores FROM r""")
def judge_parse(spark, d):
    """Replies that quote the turn before their grades; some have a grade of 2, a boolean, or one grade too few."""
    grades = F.concat_ws(",", (F.char_length("text") % 3).cast("string"), (F.char_length("text") % 2).cast("string"), F.when(F.col("turn") % 4 == 2, "true").when(F.col("turn") % 4 < 2, "1"))
    quoted_ = F.translate("text", "{}", "()")
    reply = F.concat(quoted_, F.lit(' {"scores": ['), grades, F.lit("]} "), quoted_)
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.parse_judge(reply, F.lit(3)), ",").alias("scores"))


@query(f"WITH {SWEEP} SELECT a.doc_id, b.kr - a.kr AS difference FROM m a JOIN m b USING (doc_id) WHERE a.level = 0.2 AND b.level = 0.4")
def paired_run_diff(spark, d):
    items = evaluate.item_metrics(evaluate.sweep(nonblank(spark, d), [0.2, 0.4]))
    return evaluate.paired(items.filter("drop = 2"), items.filter("drop = 4"), ["doc_id"], "kept_ratio")


# ---- ledger

TILES_SQL = f"tl AS (SELECT doc_id, lang, text, list_filter(regexp_extract_all(text, {lit(T.TILE)}), lambda x: x <> '') AS t FROM documents)"


def calls(spark, d):
    """Items to answer, replayed from the calls recorded for English ones; turns of a role are one payload key."""
    items = table(spark, d, "documents").select("doc_id", "lang", F.col("text").alias("payload"))
    recorded = items.filter("lang = 'en'").select("doc_id", F.when(F.col("payload").rlike(r"\p{Nd}"), F.concat("payload", F.lit("!"))).otherwise(F.col("payload")).alias("payload"), F.lit("ok").alias("answer"))
    return ledger.replay(items, recorded, ["doc_id"])


CALLS = "cl AS (SELECT doc_id, lang, CASE WHEN lang = 'en' AND NOT regexp_matches(text, '\\p{Nd}') THEN 'reused' ELSE 'fresh' END AS source FROM documents)"


@query(f"WITH {CALLS} SELECT doc_id, source FROM cl")
def replay_join(spark, d):
    return calls(spark, d).select("doc_id", "source")


@query(f"WITH {CALLS} SELECT lang, count(*) FILTER (source = 'fresh') AS fresh, count(*) FILTER (source = 'reused') AS reused FROM cl GROUP BY lang")
def call_accounting(spark, d):
    return ledger.accounting(calls(spark, d), "lang")


def _journal(spark, d):
    """Calls as a run wants them (originals, answers at two levels) and a journal that has some, some of these for another payload or without one."""
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("item"), "lang", F.col("text").alias("payload"), "doc_id")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).cast("double").alias("level")) for k, v in (("original", None), ("answer", 0.2), ("answer", 0.4))])
    wanted = t.select("item", "payload", "doc_id", "lang", F.explode(kinds).alias("k")).select("k.kind", "item", "k.level", "payload", "doc_id", "lang")
    kept = wanted.filter((F.col("doc_id") % 3 != 0) & ((F.col("kind") == "original") | (F.col("level") < 0.3)))
    payload = F.when(F.col("doc_id") % 3 == 1, F.when(F.col("kind") == "original", F.lit(None)).otherwise(F.concat("payload", F.lit("?")))).otherwise(F.col("payload"))
    journal = kept.select("kind", "item", "level", payload.alias("payload"), F.concat("kind", F.lit(" of "), "item").alias("answer"), F.array(F.lit(1)).alias("scores"), F.lit("m").alias("served"))
    return wanted, journal


@query("""WITH k(kind, level) AS (VALUES ('original', NULL::DOUBLE), ('answer', 0.2::DOUBLE), ('answer', 0.4::DOUBLE))
SELECT doc_id, kind, level, CASE WHEN doc_id % 3 <> 0 AND (kind = 'original' OR level < 0.3 AND doc_id % 3 = 2) THEN kind || ' of ' || doc_id END AS answer FROM documents, k""")
def journal_answers(spark, d):
    wanted, journal = _journal(spark, d)
    return ledger.found(wanted, journal).select("doc_id", "kind", "level", "answer")


@query("""WITH k(kind, level) AS (VALUES ('original', NULL::DOUBLE), ('answer', 0.2::DOUBLE), ('answer', 0.4::DOUBLE))
SELECT kind, level, count(*) AS n FROM documents, k WHERE NOT (doc_id % 3 <> 0 AND (kind = 'original' OR level < 0.3 AND doc_id % 3 = 2)) GROUP BY ALL""")
def journal_misses(spark, d):
    return ledger.misses(*_journal(spark, d)).groupBy("kind", "level").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TILES_SQL}, e AS (SELECT doc_id, unnest(t) AS x, generate_subscripts(t, 1) - 1 AS index FROM tl) SELECT doc_id, index::BIGINT AS index, CASE WHEN index % 2 = 1 AND doc_id % 5 <> 0 THEN md5(x) END AS answer FROM e")
def chunk_resume(spark, d):
    """Sentences as chunk jobs `<id>#c<index>`, of which a journal has the odd ones; those of every fifth document were recorded for another text."""
    t = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentence_tiles(F.col("text"))).alias("index", "payload"))
    wanted = t.select(F.lit("chunk").alias("kind"), F.concat(F.col("doc_id").cast("string"), F.lit("#c"), F.col("index").cast("string")).alias("item"), F.lit(None).cast("double").alias("level"), "payload", "doc_id", F.col("index").cast("long").alias("index"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))
    journal = wanted.filter("index % 2 = 1").select("kind", "item", "level", changed.alias("payload"), F.md5("payload").alias("answer"), F.array().cast("array<int>").alias("scores"), F.lit("m").alias("served"))
    return ledger.found(wanted, journal).select("doc_id", "index", "answer")


@query(f"WITH {SRC} SELECT fp, count(DISTINCT (lang, subset)) AS versions FROM src GROUP BY fp HAVING versions > 1")
def replay_conflicts(spark, d):
    return ledger.conflicts(source_rows(spark, d), "fp", "lang", "subset")


@query("SELECT conv_id, list_sort(list(DISTINCT role)) AS roles FROM conversations GROUP BY conv_id")
def served_models(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))


# ---- distillation

CAP = 64
TILES = TILES_SQL
COUNTS = TILES + f""", ct AS (SELECT doc_id, lang, coalesce(list_reduce(list_prepend({{'n': 0, 'used': 0}}, list_transform(t, lambda x: {{'n': -1, 'used': len(regexp_extract_all(x, '\\S+'))::INT}})),
  lambda a, e: CASE WHEN a.n > 0 AND a.used + e.used <= {CAP} THEN {{'n': a.n, 'used': (a.used + e.used)::INT}}
    ELSE {{'n': (a.n + greatest(1, ceil(e.used / {CAP}.0::DOUBLE)))::INT, 'used': (CASE WHEN e.used > 0 THEN (e.used - 1) % {CAP} + 1 ELSE 0 END)::INT}} END).n, 0)::BIGINT AS n_chunks FROM tl)"""


def counted(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", distill.chunk_counts(F.col("text"), CAP).cast("long").alias("n_chunks"))


@query(f"WITH {COUNTS} SELECT doc_id, n_chunks FROM ct")
def chunk_docs_additive(spark, d):
    return counted(spark, d).select("doc_id", "n_chunks")


@query()
def chunk_docs(spark, d):
    return distill.chunks(table(spark, d, "documents"))


@query(f"WITH {TILES}, e AS (SELECT doc_id, unnest(t) AS x, generate_subscripts(t, 1) - 1 AS index FROM tl) SELECT doc_id, index::BIGINT AS index, (sum(length(x)) OVER w - length(x))::BIGINT AS start, (sum(length(x)) OVER w)::BIGINT AS \"end\" FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY index)")
def tile_offsets(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentence_tiles(F.col("text"))).alias("index", "text"))
    return distill.offsets(t, "doc_id").select("doc_id", F.col("index").cast("long").alias("index"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"""WITH {COUNTS}, bg(lang, b) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in BUDGETS.items())}),
pk AS (SELECT lang, any_value(b) AS b, list({{'need': n_chunks, 'id': doc_id}} ORDER BY doc_id) AS e FROM ct JOIN bg USING (lang) WHERE n_chunks <= b GROUP BY lang),
fd AS (SELECT lang, list_reduce(list_prepend({{'left': b::BIGINT, 'ids': []::BIGINT[], 'need': 0::BIGINT, 'id': 0::BIGINT}}, list_transform(e, lambda x: {{'left': 0::BIGINT, 'ids': []::BIGINT[], 'need': x.need, 'id': x.id}})),
  lambda a, x: CASE WHEN x.need <= a.left THEN {{'left': a.left - x.need, 'ids': list_append(a.ids, x.id), 'need': 0::BIGINT, 'id': 0::BIGINT}} ELSE {{'left': a.left, 'ids': a.ids, 'need': 0::BIGINT, 'id': 0::BIGINT}} END).ids AS ids FROM pk)
SELECT lang, unnest(ids) AS doc_id FROM fd""")
def budget_select(spark, d):
    return distill.budget_select(counted(spark, d), BUDGETS, key="lang", pos="doc_id", need="n_chunks", id_col="doc_id")


def teacher_chunks(spark, d):
    """Sentence-capped chunks with a stand-in teacher that keeps seven words of ten."""
    return distill.chunks(table(spark, d, "documents").select("doc_id", "text")).withColumn("short", T.stub_compress(F.col("text"), 3))


#: Words of a piece, how far a match may be from the cursor, and the words dropped of ten.
PIECE, NEAR, DROP = 64, 24, 4


def pieces(spark, d):
    """Runs of PIECE words of each text, and the reversed lower-case compression of each."""
    # the pieces are cut before they become rows: an exploded number would copy all words of a text to each of its pieces
    cuts = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / PIECE).cast("int")), lambda k: F.slice(w, k * PIECE + 1, F.lit(PIECE)))
    each = T.let(T.word_tokens(F.col("text")), lambda w: F.when(F.size(w) > 0, cuts(w)))
    o = nonblank(spark, d).select("doc_id", "lang", F.posexplode(T.unfiltered(each, "array<string>")).alias("piece", "o"))
    return o.withColumn("c", F.reverse(F.transform(T.compress_words(F.col("o"), DROP), lambda x: F.lower(x))))


MATCHED = f"""wd AS (SELECT doc_id, lang, {WORDS.format('text')} AS w FROM documents WHERE regexp_matches(text, '\\S')),
pi AS (SELECT doc_id, lang, piece, w[piece * {PIECE} + 1 : (piece + 1) * {PIECE}] AS o FROM (SELECT doc_id, lang, w, unnest(range((len(w) + {PIECE - 1}) // {PIECE})) AS piece FROM wd)),
pc2 AS (SELECT doc_id, lang, piece, list_transform(o, lambda x: lower(x)) AS o, list_reverse(list_transform({kept_words('o', DROP)}, lambda x: lower(x))) AS c FROM pi),
fd2 AS (SELECT doc_id, lang, piece, len(o) AS n_origin, len(c) AS n_comp, list_reduce(list_prepend({{'c': 0, 't': []::INT[], 'f': 0, 'w': ''}}, list_transform(c, lambda x: {{'c': 0, 't': []::INT[], 'f': 0, 'w': x}})),
  lambda a, e: list_transform([list_sort(list_transform(list_filter(range(len(o)), lambda p: o[p + 1] = e.w AND NOT list_contains(a.t, p::INT)), lambda p: {{'d': abs(p - a.c)::INT, 'b': (p < a.c)::INT, 'p': p::INT}}))[1]],
    lambda n: {{'c': (CASE WHEN n.d < {NEAR} THEN least(n.p, a.c + {NEAR // 2}) ELSE a.c END)::INT, 't': CASE WHEN n.d < {NEAR} THEN list_append(a.t, n.p) ELSE a.t END,
      'f': (a.f + list_contains(o, e.w)::INT)::INT, 'w': ''}})[1]) AS r FROM pc2),
mp AS (SELECT doc_id, lang, piece, n_origin, n_comp, len(r.t) AS n_kept, r.f AS num_find, array_to_string(list_sort(r.t), ',') AS kept FROM fd2)"""


def matched(spark, d):
    return distill.match_labels(pieces(spark, d), "o", "c", NEAR)


@query(f"WITH {MATCHED} SELECT doc_id, piece::BIGINT AS piece, n_origin::BIGINT AS n_origin, n_comp::BIGINT AS n_comp, n_kept::BIGINT AS n_kept, num_find::BIGINT AS num_find, kept FROM mp")
def match_labels(spark, d):
    places = F.array_compact(F.transform("labels", lambda keep, i: F.when(keep, i)))
    numbers = [F.col(c).cast("long").alias(c) for c in ("piece", "n_origin", "n_comp", "n_kept", "num_find")]
    return matched(spark, d).select("doc_id", *numbers, F.array_join(places.cast("array<string>"), ",").alias("kept"))


def metric_rows(spark, d):
    """Rates of each document from the matches of its pieces."""
    sums = [F.sum(c).alias(c) for c in ("n_origin", "n_comp", "n_kept", "num_find")]
    return distill.label_metrics(matched(spark, d).groupBy("doc_id", "lang").agg(*sums), "n_origin", "n_comp", "n_kept", "num_find")


METRICS = MATCHED + """, mc AS (SELECT doc_id, lang, sum(n_origin) AS n_origin, sum(n_comp) AS n_comp, sum(num_find) AS num_find, sum(n_kept) AS n_kept FROM mp GROUP BY doc_id, lang),
mt AS (SELECT doc_id, lang, n_comp::DOUBLE / n_origin AS word_compressed_rate, coalesce(num_find::DOUBLE / nullif(n_comp, 0), 0) AS find_rate, 1 - coalesce(num_find::DOUBLE / nullif(n_comp, 0), 0) AS variation_rate,
  num_find::DOUBLE / n_origin AS hitting_rate, n_kept::DOUBLE / n_origin AS matching_rate, num_find::DOUBLE / n_origin - n_kept::DOUBLE / n_origin AS alignment_gap FROM mc)"""
RATES = ["word_compressed_rate", "find_rate", "variation_rate", "hitting_rate", "matching_rate", "alignment_gap"]


@query(f"WITH {METRICS} SELECT doc_id, {', '.join(RATES)} FROM mt")
def distill_metrics(spark, d):
    return metric_rows(spark, d).select("doc_id", *RATES)


QC = METRICS + """, q1 AS (SELECT *, row_number() OVER (ORDER BY variation_rate DESC, doc_id DESC) <= ceil(0.05::DOUBLE * count(*) OVER ()) AS gone FROM mt),
q2 AS (SELECT *, row_number() OVER (ORDER BY alignment_gap DESC, doc_id DESC) <= ceil(0.1::DOUBLE * count(*) OVER ()) AS gone2 FROM q1 WHERE NOT gone),
qc AS (SELECT doc_id, lang, variation_rate, alignment_gap, matching_rate, 'variation_rate' AS dropped_by FROM q1 WHERE gone UNION ALL
  SELECT doc_id, lang, variation_rate, alignment_gap, matching_rate, CASE WHEN gone2 THEN 'alignment_gap' END FROM q2)"""


def controlled(spark, d):
    return distill.quality_control(cut(metric_rows(spark, d)), 0.05, 0.10, id_col="doc_id")


@query(f"WITH {QC} SELECT doc_id, dropped_by FROM qc")
def qc_keep(spark, d):
    return controlled(spark, d).select("doc_id", "dropped_by")


@query(f"WITH {QC} SELECT (SELECT max(variation_rate) FROM q1 WHERE NOT gone) AS variation_rate, (SELECT max(alignment_gap) FROM q2 WHERE NOT gone2) AS alignment_gap")
def qc_thresholds(spark, d):
    return controlled(spark, d).select("thresholds.*").limit(1)  # the same in every row


@query(f"WITH {QC}, u AS (SELECT dropped_by IS NULL AS kept, metric, value FROM (UNPIVOT (SELECT dropped_by, variation_rate, alignment_gap, matching_rate FROM qc) ON variation_rate, alignment_gap, matching_rate INTO NAME metric VALUE value)) "
       "SELECT kept, metric, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95, round(avg(value), 9) AS mean FROM u GROUP BY ALL")  # fmt: skip
def qc_distributions(spark, d):
    rows = controlled(spark, d).withColumn("kept", F.col("dropped_by").isNull())
    s = stats.distributions(rows, ["variation_rate", "alignment_gap", "matching_rate"], "kept")
    return s.withColumn("mean", F.round("mean", 9))


@query(f"WITH {QC} SELECT lang, count(*) AS n, count(*) FILTER (dropped_by IS NULL) AS kept, count(*) FILTER (dropped_by = 'variation_rate') AS by_vr, count(DISTINCT doc_id) AS entries FROM qc GROUP BY lang")
def distill_counts(spark, d):
    return controlled(spark, d).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("dropped_by").isNull()).alias("kept"), F.count_if(F.coalesce(F.col("dropped_by") == "variation_rate", F.lit(False))).alias("by_vr"), F.count_distinct("doc_id").alias("entries")
    )


# ---- synthetic prompts

def _family_sql(k: int, family: str, load_type: str, template: str, slots: dict[str, list[str]], extra: str | None, low: str, high: str) -> str:
    text, draw = lit(template), lambda name: f"('0x' || substr(sha256('{family}:' || seed || ':{name}'), 1, 8))::BIGINT"
    if extra:
        text = f"CASE WHEN {draw(synth.EXTRA)} % 2 = 1 THEN {lit(synth.spliced(template, extra))} ELSE {text} END"
    for slot, options in slots.items():
        pick = f"([{', '.join(map(lit, options))}])[({draw(slot)} % {len(options)})::INT + 1]"
        text = f"replace({text}, '{{{slot}}}', {pick})"
    return f"SELECT {k} AS family_ord, '{family}' AS family, '{load_type}' AS load_type, seed, {text} AS prompt FROM range({low}, {high} + 1) t(seed)"


def _all_sql(low: int, high: int) -> str:
    return " UNION ALL ".join(_family_sql(k, *f, low, high) for k, f in enumerate(synth.FAMILIES))


@query(f"SELECT family, load_type, seed, prompt, sha1(prompt) AS fp FROM ({_all_sql(*synth.TRAIN_RANGE)})")
def synth_entries(spark, d):
    return synth.render(synth.candidates(synth.families(spark), "train_lo", "train_hi")).select("family", "load_type", F.col("seed").cast("long").alias("seed"), "prompt", "fp")


TARGETS = {"system_prompt": 14, "dialogue": 9}


@query(f"""WITH g AS (SELECT sha1(prompt) AS fp FROM ({_all_sql(*synth.EVAL_RANGE)})),
c AS (SELECT *, sha1(prompt) AS fp FROM ({_all_sql(*synth.TRAIN_RANGE)}) WHERE sha1(prompt) NOT IN (SELECT fp FROM g)),
o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY fp ORDER BY seed, family_ord) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY load_type, family ORDER BY seed) AS round FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY load_type ORDER BY round, family_ord) AS rank FROM r)
SELECT family, load_type, seed, round, rank FROM k WHERE rank <= CASE load_type WHEN 'system_prompt' THEN 14 ELSE 9 END""")
def seed_plan(spark, d):
    fams = synth.families(spark)
    golden = synth.render(synth.candidates(fams, "eval_lo", "eval_hi"))
    plan = synth.seed_plan(synth.render(synth.candidates(fams, "train_lo", "train_hi")), TARGETS, golden)
    return plan.select("family", "load_type", F.col("seed").cast("long").alias("seed"), F.col("round").cast("long").alias("round"), F.col("rank").cast("long").alias("rank"))


def claimed(spark):
    """Rows that claim a family and a seed, some out of range or of no family."""
    fams = synth.families(spark).select("family", "load_type").unionByName(spark.createDataFrame([("night_market", "dialogue")], "family string, load_type string"))
    return fams.withColumn("seed", F.explode(F.sequence(F.lit(95), F.lit(995), F.lit(5))))


CLAIMED = "cm AS (SELECT family, load_type, seed FROM (VALUES " + ", ".join(f"('{f[0]}', '{f[1]}')" for f in synth.FAMILIES) + ", ('night_market', 'dialogue')) v(family, load_type), range(95, 996, 5) t(seed))"


@query(f"""WITH {CLAIMED}, e AS (SELECT *, CASE WHEN family = 'night_market' THEN 'unknown family' WHEN seed BETWEEN 901 AND 990 THEN NULL
 WHEN seed BETWEEN 101 AND 110 THEN 'seed is in the eval range' ELSE 'seed is in neither range' END AS error FROM cm) SELECT * FROM e WHERE error IS NOT NULL""")
def seed_domain_errors(spark, d):
    return synth.seed_errors(claimed(spark), synth.families(spark)).withColumn("seed", F.col("seed").cast("long"))


@query("SELECT family FROM (VALUES " + ", ".join(f"('{f[0]}', 101, 110, 901, 990)" for f in synth.FAMILIES) + ") v(family, a, b, c, d) WHERE a <= d AND c <= b")
def range_disjointness(spark, d):
    return synth.range_overlaps(synth.families(spark)).select("family")


@query(f"WITH {CLAIMED}, a AS ({_all_sql(95, 995)}), r AS (SELECT cm.*, CASE WHEN seed % 10 = 0 THEN prompt || ' ' ELSE prompt END AS p, prompt AS want FROM cm LEFT JOIN a USING (family, load_type, seed)) SELECT family, load_type, seed FROM r WHERE p IS DISTINCT FROM want")
def regeneration_check(spark, d):
    fams = synth.families(spark)
    rows = synth.render(claimed(spark).join(fams.select("family", "load_type", "template", "slots", "extra"), ["family", "load_type"], "left")).select("family", "load_type", "seed", "prompt")
    tampered = rows.withColumn("prompt", F.when(F.col("seed") % 10 == 0, F.concat("prompt", F.lit(" "))).otherwise(F.col("prompt")))
    return synth.regeneration_errors(tampered.filter("prompt IS NOT NULL"), fams).select("family", "load_type", F.col("seed").cast("long").alias("seed"))


# ---- training windows

@query()
def align_labels(spark, d):
    labelled_ = distill.label_chunks(teacher_chunks(spark, d), "text", "short")
    a = windows.align_labels(labelled_.select("doc_id", "index", "text", "tokens"), "text", "tokens", kept=["doc_id", "index"])
    return a.select("doc_id", "index", F.size("subwords").alias("n_subwords"), F.size(F.filter("subwords", lambda s: s["label"] == 1)).alias("n_kept"))


PIECES = f"pc AS (SELECT doc_id, list_transform({WS.format('text')}, lambda w: ((length(w) + 3) // 4)::INT) AS g FROM documents)"


def piece_sizes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.transform(T.ws_tokens(F.col("text")), lambda w: F.floor((F.char_length(w) + 3) / 4).cast("int")).alias("g"))


PACKED = PIECES + """, pk AS (SELECT doc_id, g, list_reduce(list_prepend({'w': 0, 'u': 0, 't': 0}, list_transform(g, lambda x: {'w': 0, 'u': x, 't': 0})),
  lambda a, e: CASE WHEN a.u + e.u <= 30 THEN {'w': a.w, 'u': (a.u + e.u)::INT, 't': a.t}
    ELSE {'w': (a.w + CASE WHEN a.u > 0 THEN 1 ELSE 0 END + CASE WHEN e.u > 30 THEN 1 ELSE 0 END)::INT, 'u': (CASE WHEN e.u <= 30 THEN e.u ELSE 0 END)::INT, 't': (a.t + greatest(0, e.u - 30))::INT} END) AS p FROM pc)"""


@query(f"WITH {PACKED} SELECT doc_id, (p.w + CASE WHEN p.u > 0 THEN 1 ELSE 0 END)::BIGINT AS n_windows, p.t::BIGINT AS truncated FROM pk")
def pack_windows(spark, d):
    p = piece_sizes(spark, d).select("doc_id", windows.pack(F.col("g"), 32).alias("p"))
    return p.select("doc_id", F.col("p.windows").cast("long").alias("n_windows"), F.col("p.truncated").cast("long").alias("truncated"))


@query(f"WITH {PACKED} SELECT lang, count(*) AS examples, sum(p.w + CASE WHEN p.u > 0 THEN 1 ELSE 0 END)::BIGINT AS windows, sum(p.t)::BIGINT AS truncated, sum(list_sum(g))::BIGINT AS subwords FROM pk JOIN documents USING (doc_id) GROUP BY lang")
def window_stats(spark, d):
    g = table(spark, d, "documents").select("lang", F.transform(T.ws_tokens(F.col("text")), lambda w: F.floor((F.char_length(w) + 3) / 4).cast("int")).alias("g"))
    p = g.select("lang", "g", windows.pack(F.col("g"), 32).alias("p"))
    return p.groupBy("lang").agg(
        F.count(F.lit(1)).alias("examples"), F.sum("p.windows").alias("windows"), F.sum("p.truncated").alias("truncated"), F.sum(F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + x)).alias("subwords")
    )


@query("SELECT epoch, conv_id, row_number() OVER (PARTITION BY epoch ORDER BY sha256((epoch + 5) || ':' || conv_id), conv_id) AS place FROM (SELECT DISTINCT conv_id FROM conversations), range(2) t(epoch)")
def epoch_shuffle(spark, d):
    o = windows.epoch_order(table(spark, d, "conversations").select("conv_id").distinct(), 2, 5, "conv_id")
    return o.select(F.col("epoch").cast("long").alias("epoch"), "conv_id", F.col("place").cast("long").alias("place"))


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), o AS (SELECT 0 AS epoch, conv_id, n, row_number() OVER (ORDER BY sha256('5:' || conv_id), conv_id) AS place FROM c)
SELECT conv_id, ((place - 1) // 8)::BIGINT AS batch, max(n) OVER (PARTITION BY (place - 1) // 8) + 2 AS width FROM o""")
def batch_widths(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("labels"))
    b = windows.batches(windows.epoch_order(c, 1, 5, "conv_id").join(c, "conv_id"), 8)
    return b.select("conv_id", F.col("batch").cast("long").alias("batch"), F.col("width").cast("long").alias("width"))


@query("""WITH c AS (SELECT conv_id, list(turn::INT ORDER BY turn) AS l FROM conversations GROUP BY conv_id), o AS (SELECT conv_id, l, row_number() OVER (ORDER BY sha256('5:' || conv_id), conv_id) AS place FROM c),
b AS (SELECT conv_id, l, max(len(l)) OVER (PARTITION BY (place - 1) // 8) + 2 AS width FROM o)
SELECT conv_id, array_to_string(list_concat(list_prepend(-100, l), list_transform(range(width - len(l) - 1), lambda x: -100)), ',') AS targets, (len(l) + 2)::BIGINT AS n_tokens FROM b""")
def padded_batches(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("labels"))
    p = windows.padded(windows.batches(windows.epoch_order(c, 1, 5, "conv_id").join(c, "conv_id"), 8))
    ones = F.size(F.filter("mask", lambda m: m == 1)).cast("long")
    return p.select("conv_id", F.array_join(F.col("targets").cast("array<string>"), ",").alias("targets"), ones.alias("n_tokens"))


LABELLED = "lb AS (SELECT conv_id, turn, length(text) AS n, conv_id % 2 AS swapped, turn % 3 AS keep FROM conversations)"


@query(f"""WITH {LABELLED}, e AS (SELECT conv_id, turn, unnest(list_filter([CASE WHEN swapped = 1 AND n >= 8 THEN 'spans are out of order' END, CASE WHEN n < 8 THEN 'span is out of bounds' END, CASE WHEN keep = 2 THEN 'keep is not 0 or 1' END], lambda x: x IS NOT NULL)) AS error FROM lb)
SELECT conv_id || '-' || turn AS id, error FROM e WHERE error <> 'x'""")
def labeled_errors(spark, d):
    """Turns with the spans [0, 3) and [4, 8), which are swapped for odd conversations and too long for short turns."""
    t = table(spark, d, "conversations")
    span = lambda a, b, keep: F.struct(F.lit("w").alias("text"), F.lit(a).alias("start"), F.lit(b).alias("end"), keep.cast("int").alias("keep"))
    a, b = span(0, 3, F.lit(1)), span(4, 8, F.col("turn") % 3)
    spans = F.when((F.col("conv_id") % 2 == 1) & (F.char_length("text") >= 8), F.array(b, a)).otherwise(F.array(a, b))
    return records.labeled_errors(t.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("prompt"), spans.alias("tokens")))
