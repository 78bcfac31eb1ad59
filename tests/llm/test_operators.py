"""Each training-data operator against DuckDB or a brute-force version, with nulls, ties, repeats, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import html as html_lib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate, exact_dedup, html_extract, langid, line_dedup, lm_score, mixing, quality_crf, simhash, simhash_parts, textarrays, url_filter
from lodestrata.llm.common import cut

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet consectetur " * 4000
DOCS = [
    (1, "Alpha  beta\tgamma\n\ndelta", "en", "a"), (2, "Alpha beta gamma delta", "en", "a"), (3, None, None, None), (4, "", "en", "b"),
    (5, "   \n\t ", None, "b"), (6, "Alpha beta gamma delta", "en", None), (7, LONG, "en", "a"), (8, LONG, "en", "c"), (9, "ALPHA beta gamma delta", "en", "c"),
    (9, "ALPHA beta gamma delta", "en", "c"), (10, "één twee – drie 😀", "nl", "b"), (11, "12345 67890", "en", "b"), (None, "orphan text", "en", "a"),
    (12, "orphan text", "en", "a"), (13, "x" * 50_000, "en", "d"), (14, "x", "en", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators use or return.
CLASH = ("_id", "_t", "_d", "d", "x", "score", "kept", "host", "deleted", "size", "n_words", "a.b")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return cut(df.repartition(3))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def same_rows(df, con_sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    want = con.execute(con_sql).df()
    got = df.toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    norm = lambda d: sorted(tuple("%.9g" % v if isinstance(v, float) else str(v) for v in r) for r in d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None))
    assert norm(got) == norm(want)


def tables(docs):
    return {"documents": docs.select("doc_id", "text", "lang", "source").toPandas().astype({"doc_id": "Int64"})}


# ---- op1

def test_url_filter_against_sql(spark):
    urls = ["https://WWW.Example.com/en/7?x=1", "http://example.com/en/", "https://a.example.com/en/78/#t", "x://com/en/1", "https://com/de/", "http://b.net/de/8", "http://example.net/de/81",
            "http://xexample.net/de/8", "https://foo.org/es/", "https://forg/es/", "nourl", None, "", "https://", "https://h", "https://h?a=/en/", "ftp://x.com/en/://y.org/es/", "http://notcom/en/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")
    same_rows(got, url_filter.ORACLE, pages=pages.select("page_id", "url").toPandas())
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_url_filter_of_repeated_and_long_urls(spark):
    long = "https://www.example.com/en/7" + "x" * 200_000
    rows = [(1, long), (1, long), (1, "https://a.org/es/"), (None, "https://" + "a." * 30_000 + "com/en/")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit("clash"))).collect()
    assert sorted((str(r["page_id"]), r["rule"], r["verdict"], len(r["path"])) for r in got) == [("1", "example.com/en/7", "allow", 200_005), ("1", "example.com/en/7", "allow", 200_005), ("1", "org/es/", "block", 4), ("None", "com/en/", "block", 4)]


def test_cascade_is_exact_for_the_universe():
    listed = [f"bad{i}.com/" for i in range(500)]
    others = [f"good{i}.com/" for i in range(20_000)]
    first = url_filter.Bloom(listed, 500 / (20_000 * math.sqrt(2)), 0)
    cascade = url_filter.Cascade(first, listed, [k for k in others if k in first])
    assert len(cascade.levels) > 1 and not cascade.rest
    assert all(k in cascade for k in listed) and not any(k in cascade for k in others)


def test_cascade_builds_over_many_rules(spark):
    rules = [("block", f"h{i}.com", "/") for i in range(300)] + [("allow", f"h{i}.com", "/ok") for i in range(0, 300, 2)]
    rows = [(i, f"https://h{i % 900}.com/{'ok' if i % 3 else 'no'}") for i in range(3000)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    for i, u in rows:
        h = i % 900
        want = (None, "allow") if h >= 300 else (f"h{h}.com/ok", "allow") if h % 2 == 0 and i % 3 else (f"h{h}.com/", "block")
        assert got[i] == want, u


# ---- op2

def test_exact_dedup_against_sql(docs, empty):
    plain = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    same_rows(exact_dedup.duplicate_groups(plain), exact_dedup.ORACLE, **tables(plain))
    assert exact_dedup.duplicate_groups(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_repeats_and_null_ids(docs):
    rows = exact_dedup.duplicate_groups(docs).collect()
    assert len(rows) == len(DOCS)
    kept = Counter(r["text_sha256"] for r in rows if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({r["text_sha256"] for r in rows})
    assert next(r for r in rows if r["doc_id"] is None)["keep_id"] == 12
    filtered = exact_dedup.exact_dedup(docs)
    assert filtered.columns == docs.columns and filtered.count() == len(kept)


def test_exact_dedup_of_repeated_ids(spark, monkeypatch):
    rows = [(1, "a  b", 1), (1, "a b", 2), (1, "a b", 3), (2, "a\tb", 4), (3, "c", 5), (3, "c", 6), (None, "d", 7), (None, " d", 8), (None, "d", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lost long").repartition(3)
    for bound in (1_000_000, 0):
        monkeypatch.setattr("lodestrata.llm.common.BROADCAST_ROWS", bound)
        left = exact_dedup.exact_dedup(d)
        got = Counter((r["doc_id"], " ".join(r["text"].split(" "))) for r in left.collect())
        assert left.columns == d.columns and sum(got.values()) == 4 and {(k[0], "".join(k[1].split())) for k in got} == {(1, "ab"), (3, "c"), (None, "d")}
        assert sum(r["text"].startswith(" ") for r in left.collect()) == 1


def test_exact_dedup_survives_digest_collisions(docs):
    weak = exact_dedup.duplicate_groups(docs, digest=lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 0)), salts=3)  # every digest is equal
    key = lambda rows: sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in rows)
    assert key(weak.collect()) == key(exact_dedup.duplicate_groups(docs).collect())


# ---- op3

def brute_contamination(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[i : i + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if g := grams.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= g
        ids = sorted(str(x) for x in found)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_decontaminate_against_brute_force(spark, docs, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
    rng = np.random.default_rng(3)
    word = lambda: str(rng.choice(["the", "of", "É", "é", "Und", "x1", "lorem"]))
    items = [(i, " ".join(word() for _ in range(int(rng.integers(0, 30))))) for i in range(12)] + [(50, None), (51, "—"), (52, "Alpha BETA"), (52, "lorem IPSUM dolor sit amet consectetur lorem ipsum dolor sit amet"), (53, "één")]
    rows = [(100 + i, " ".join([*(word() for _ in range(20)), *str(items[i % 12][1]).upper().split()[2:17], *(word() for _ in range(9))])) for i in range(30)]
    rows += [(r[0], r[1]) for r in DOCS if r[0] is not None]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash")).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r)[:6] for r in decontaminate.contamination(d, b).collect()), key=str)
    assert got == brute_contamination(rows, items)
    assert decontaminate.contamination(d, b.limit(0)).filter("n_hit > 0 OR n_items > 0").count() == 0
    assert decontaminate.contamination(d.limit(0), b).count() == 0


def test_decontaminate_of_null_items_and_repeated_documents(spark, monkeypatch):
    b = spark.createDataFrame([(None, "one two three"), (7, "two three four"), (7, "nine ten"), (8, None)], "item_id long, text string")
    rows = [(1, "one two three four"), (1, "one two three four"), (1, "nine ten"), (None, "One TWO three"), (3, "none " * 50_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    sha = lambda ids: hashlib.sha256(ids.encode()).hexdigest()
    want = [("1", 2, 2, 1, sha("7")), ("1", 4, 4, 1, sha("7")), ("1", 4, 4, 1, sha("7")), ("3", 50_000, 0, 0, sha("")), ("None", 3, 3, 0, sha(""))]
    for bound in (1_000_000, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
        got = decontaminate.contamination(d, b).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got) == want
        assert [r["doc_id"] for r in decontaminate.decontaminate(d, b).collect()] == [3]


def test_decontaminate_keeps_columns(spark, docs):
    b = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    left = decontaminate.decontaminate(docs, b)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(r[0]) for r in DOCS if r[0] not in (1, 2, 6, 9))


# ---- op4

def brute_losses(rows, targets, weight=lm_score.BIGRAM_WEIGHT, add=lm_score.ADD):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    models = []
    vocabulary = {w for _, t in rows for w in words(t)}
    for chosen in ([r for r in rows if r[0] in targets], rows):
        one, two = Counter(), Counter()
        for _, t in chosen:
            if w := words(t):
                one.update([*w, "</s>"])
                two.update(zip(["</s>", *w], [*w, "</s>"]))
        models.append((one, two))
    out = {}
    for i, t in rows:
        w, loss = words(t), []
        for one, two in models:
            total = 0.0
            for a, b in zip(["</s>", *w], [*w, "</s>"]) if w else []:
                single = (one[b] + add) / (sum(one.values()) + add * (len(vocabulary) + 2))
                share = weight if one[a] else 0.0
                total -= math.log(share * (two[a, b] / max(1, one[a])) + (1 - share) * single)
            loss.append(total / max(1, len(w) + 1))
        out[i] = (len(w), *loss, loss[0] - loss[1])
    return out


def test_lm_score_against_brute_force(spark, docs, empty):
    rows = [(r[0], r[1]) for r in DOCS[:8]] + [(20 + i, f"the cat {i} sat on the mat of the cat") for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    targets = spark.createDataFrame([(20,), (21,), (21,), (None,), (7,)], "doc_id long")
    model = lm_score.train(lm_score.mark_targets(d, targets))
    want = brute_losses(rows, {20, 21, 7})
    for r in lm_score.score(d, model).collect():
        n, *losses = want[r["doc_id"]]
        assert r["n_tokens"] == n
        assert (r["loss_target"], r["loss_background"], r["score"]) == pytest.approx(losses, abs=1e-9)
    none = lm_score.train(lm_score.mark_targets(empty, targets))
    assert lm_score.score(docs, none).count() == len(DOCS) and lm_score.score(empty, model).count() == 0


def test_lm_score_counts_every_word_and_bigram(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "PIECE", 20_000, raising=False)
    monkeypatch.setattr(lm_score, "PART", 20_000, raising=False)
    rows = [(i, " ".join(f"w{i * 450 + k}x w{(i * 7 + k) % 900}" for k in range(450))) for i in range(90)]
    rows += [(200 + i, r[1]) for i, r in enumerate(rows[:5])]
    targets = set(range(0, 90, 2))
    steps = {i: list(zip(["</s>", *t.split()], [*t.split(), "</s>"])) for i, t in rows}
    types = len({w for _, t in rows for w in t.split()})
    assert types > 40_000  # once, words beyond the 32,768th were one unknown word
    want = defaultdict(list)
    for chosen in (targets, set(steps)):
        two = Counter(s for i in chosen for s in steps[i])
        one, total = Counter(), sum(two.values())
        for (_, b), n in two.items():
            one[b] += n
        for i, pairs in steps.items():
            share = lambda a: lm_score.BIGRAM_WEIGHT if one[a] else 0.0
            single = lambda b: (one[b] + lm_score.ADD) / (total + lm_score.ADD * (types + 2))
            want[i].append(sum(-math.log(share(a) * two[a, b] / max(1, one[a]) + (1 - share(a)) * single(b)) for a, b in pairs) / len(pairs))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marked = lm_score.mark_targets(d, spark.createDataFrame([(i,) for i in targets], "doc_id long"))
    got = lm_score.score(d, lm_score.train(marked)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [r["loss_target"], r["loss_background"]] == pytest.approx(want[r["doc_id"]], abs=1e-9)


# ---- op5

def test_langid_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op5_langid(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(out) > 100 and sum(r["lang_pred"] == r["lang"] for r in out) / len(out) > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in out)


def test_langid_edges(spark, docs, empty):
    model = langid.train(docs.select("doc_id", "text", "lang"))
    assert model.languages == ["en", "nl"]
    rows = langid.identify(docs, model).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not lettered) and 0 <= r["score"] <= 1
    nothing = langid.train(empty.select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"} and langid.identify(empty, model).count() == 0


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(0)
    rows = [(np.array([k, 5, 6 + int(rng.integers(0, 50))]), np.array([0.7, 0.5, 0.5]), k) for k in range(3) for _ in range(60)]
    w, b = langid.ftrl(rows, 64, 3)
    assert all(int((x @ w[i] + b).argmax()) == y for i, x, y in rows) 
    seen = w[np.unique(np.concatenate([i for i, *_ in rows]))]
    assert (seen == 0).any() and not (w[56:] != 0).any()


def plain_features(text, bits=langid.BITS):
    """Counts of hashed n-grams of 1 to 3 characters, one by one, in Python's integers."""
    import unicodedata

    words, word = [], ""
    for c in text.lower():
        if unicodedata.category(c)[0] in "LM":
            word += c
        elif word:
            words, word = [*words, word], ""
    words = [*words, word] if word else words
    if not any(unicodedata.category(c)[0] == "L" for w in words for c in w):
        return None
    line, m, k1, k2, k3 = [32, *(ord(c) for c in " ".join(words)), 32], 0xFFFFFFFF, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D
    counts = Counter()
    for i, a in enumerate(line):
        if a != 32:
            counts[(a * k1 & m) >> (32 - bits)] += 1
        if i + 1 < len(line):
            pair = (a * k2 & m) ^ ((line[i + 1] * k1 + 0x27D4EB2F) & m)
            counts[(pair * k3 & m) >> (32 - bits)] += 1
            if i + 2 < len(line):
                three = (pair * k1 & m) ^ ((line[i + 2] * k3 + 0x165667B1) & m)
                counts[(three * k2 & m) >> (32 - bits)] += 1
    return counts


def plain_ftrl(rows, classes, epochs, alpha=langid.ALPHA, beta=langid.BETA, l1=langid.L1, l2=langid.L2):
    """FTRL-proximal, coordinate by coordinate."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(key):
        one, two = (0.0, 0.0) if key[0] == "bias" else (l1, l2)
        return 0.0 if abs(z[key]) <= one else -(z[key] - math.copysign(one, z[key])) / ((beta + math.sqrt(n[key])) / alpha + two)

    for epoch in range(epochs):
        for r in np.random.default_rng(epoch).permutation(len(rows)):
            index, x, y = rows[r]
            features = [*zip(index.tolist(), x.tolist()), ("bias", 1.0)]
            w = {(f, c): weight((f, c)) for f, _ in features for c in range(classes)}
            logits = [sum(v * w[f, c] for f, v in features) for c in range(classes)]
            top = max(logits)
            p = [math.exp(v - top) for v in logits]
            for c in range(classes):
                g = p[c] / sum(p) - (c == y)
                for f, v in features:
                    key, grad = (f, c), g * v
                    sigma = (math.sqrt(n[key] + grad * grad) - math.sqrt(n[key])) / alpha
                    z[key] += grad - sigma * w[key]
                    n[key] += grad * grad
    return weight


def test_langid_against_plain_python(spark):
    texts = [("Hello, World! 12 ab", "en"), ("Él no está aquí", "es"), ("e\u0301te\u0301", "fr"), ("hello hello", "en"), ("das Haus", "de"), ("ein Haus ist da", "de"), ("la casa está", "es"), ("the world", "en"), ("le monde", "fr"), ("à la maison", "fr")]
    for t, _ in [*texts, ("\u0301\u0302", None), ("123", None), ("", None)]:
        got, want = langid.features(t), plain_features(t)
        assert (got is None and want is None) or dict(zip(got[0].tolist(), got[1].tolist())) == want
    d = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    model = langid.train(d)
    counts, df = [plain_features(t) for t, _ in texts], Counter()
    for c in counts:
        df.update(c.keys())
    assert all(model.idf[f] == pytest.approx(math.log(11 / (1 + df[f])) + 1) for c in counts for f in c)
    for (t, _), c in zip(texts, counts):
        index, x = model.vector(langid.features(t))
        raw = {f: (1 + math.log(k)) * model.idf[f] for f, k in c.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        assert dict(zip(index.tolist(), x.tolist())) == pytest.approx({f: v / norm for f, v in raw.items()})
    rows = [(*model.vector(langid.features(t)), ["de", "en", "es", "fr"].index(y)) for t, y in texts]
    w, b = langid.ftrl(rows, 1 << langid.BITS, 4, epochs=2)
    plain = plain_ftrl(rows, 4, 2)
    assert all(w[f, c] == pytest.approx(plain((f, c)), abs=1e-9) for r in rows for f in r[0].tolist() for c in range(4)) and b.tolist() == pytest.approx([plain(("bias", c)) for c in range(4)])
    logits, y = np.random.default_rng(0).normal(size=(200, 3)) * 3, np.random.default_rng(1).integers(0, 3, 200)
    loss = lambda t: -sum(z[k] / t - math.log(sum(math.exp(v / t) for v in z)) for z, k in zip(logits.tolist(), y.tolist()))
    best = langid.calibrate(logits, y)
    assert all(loss(best) <= loss(t) + 1e-9 for t in np.exp(np.linspace(math.log(0.25), math.log(20), 121)))


# ---- op6

def brute_line_dedup(rows, min_words=line_dedup.MIN_WORDS):
    """Every document against every earlier one: all diagonals of equal lines with enough words are deleted from the later one."""
    seq = {}
    for d, t in rows:
        lines = t.split("\n")
        solid = [j for j, s in enumerate(lines) if s.split()]
        seq[d] = (lines, solid, [lines[j].strip(" ") for j in solid], [len(lines[j].split()) for j in solid])
    result = {}
    for d, (lines, solid, own, words) in seq.items():
        gone = set()
        for f in (f for f in seq if f < d):
            theirs = seq[f][2]
            for shift in range(-len(theirs) + 1, len(own)):
                run = []
                for j in range(len(own) + 1):
                    if j < len(own) and 0 <= j - shift < len(theirs) and own[j] == theirs[j - shift]:
                        run.append(j)
                        continue
                    if sum(words[k] for k in run) >= min_words:
                        gone |= set(run)
                    run = []
        owner = lambda j: max([k for k, p in enumerate(solid) if p <= j], default=0)
        result[d] = "\n".join(s for j, s in enumerate(lines) if owner(j) not in gone)
    return result


@pytest.mark.parametrize("rare,ids", [(64, int), (2, str), (1, int)])
def test_line_dedup_against_brute_force(spark, rare, ids):
    rng = np.random.default_rng(5)
    shared = [f"shared line number {k} has quite a few words in it" for k in range(9)] + ["short", "", "of the", "three words here", "four of them here", " "]
    rows = []
    for i in range(40):
        own = [f"own line {i} {k} with enough words to be counted as rare" for k in range(3)]
        picks = [shared[int(k)] for k in rng.integers(0, len(shared), int(rng.integers(0, 12)))]
        order = rng.permutation(len(own) + len(picks)) if i % 2 else np.arange(len(own) + len(picks))
        rows.append((i + 10, "\n".join([*own, *picks][int(k)] for k in order)))
    verse = [f"verse {k % 3}" for k in range(12)]
    rows += [(100, rows[0][1]), (101, rows[0][1] + "\n" + shared[0]), (102, "\n".join(verse)), (103, "\n".join(["x", *verse[1:], "y"])), (104, "\n\n" + "\n".join(reversed(rows[1][1].split("\n"))))]
    rows = [(ids(d), t) for d, t in rows]
    kind = "long" if ids is int else "string"
    d = spark.createDataFrame(rows, f"doc_id {kind}, text string").withColumn("deleted", F.lit("clash")).withColumn("d", F.lit("clash")).withColumn("a.b", F.lit(1)).repartition(3)
    got = line_dedup.dedup_lines(d, rare=rare)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute_line_dedup(rows)
    assert got.columns[:5] == ["doc_id", "text", "deleted", "d", "a.b"]


def test_line_dedup_deletes_what_only_later_pairs_share(spark):
    long, other = "this line has rather more than eight words in it", "and this one has even more words than the first"
    rows = [(1, long), (2, f"{long}\nshort tail"), (3, f"own words\n{long}\nshort tail"), (11, f"{long}\nx\n{other}"), (12, f"{other}\ny\n{long}"), (13, f"{other}\nz\n{long}")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: long, 2: "short tail", 3: "own words", 11: f"x\n{other}", 12: "y", 13: "z"} == brute_line_dedup(rows)
    fives = "\n".join(f"five short words {k} here" for k in range(20))
    rows = [(1, f"a\n{fives}"), (2, f"b\n{fives}\nc")]
    assert {r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {rows[0][1], "b\nc"}


def test_line_dedup_edges(docs, empty):
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(DOCS) and line_dedup.dedup_lines(empty).count() == 0
    by_id = {(r["doc_id"], r["text"]) for r in got}
    assert (3, None) in by_id and (8, "") in by_id and (7, LONG) in by_id and (None, "orphan text") in by_id


def test_line_dedup_finds_runs_of_short_lines(spark):
    verse = "\n".join(f"short verse line {k}" for k in range(15))
    rows = [(1, f"one own\n{verse}\nits end"), (2, f"other own text\n\n{verse}\nanother"), (3, "short verse line 3\nof its own"), (4, "a b c\n\nd e f\ng h"), (5, "x\na b c\n\nd e f\ng h\ny")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "other own text\n\nanother", 3: rows[2][1], 4: rows[3][1], 5: "x\ny"}


def test_line_dedup_tries_every_earlier_holder(spark, tmp_path):
    a, b, c = (f"shared line {k} has quite a few words in it" for k in "abc")
    crossed = [(i, f"{a}\n{b}\n{c}\nown {i}") for i in range(1, 6)]
    rows = [*crossed, (6, f"x\n{c}\ny"), (7, f"{c}\n{a}\n{b}"), (8, f"{c}\nz\n{a}\n{b}")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in line_dedup.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert got[1] == rows[0][1] and [got[i] for i in range(2, 9)] == ["own 2", "own 3", "own 4", "own 5", "x\ny", "", "z"]


# ---- op7

def test_crf_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    doc = np.array([0, 0, 0, 0, 2, 3, 3])
    x = quality_crf.Lines(doc, np.ones(7), np.zeros((7, 1), int))
    s, pair = rng.normal(size=7), rng.normal(size=(2, 2))
    good, steps, z = quality_crf.marginals(x, s, pair)
    want, want_steps, want_z = np.zeros(7), np.zeros((2, 2)), 0.0
    for d in (0, 2, 3):
        at = np.flatnonzero(doc == d)
        weights = {y: math.exp(sum(s[i] * v for i, v in zip(at, y)) + sum(pair[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=len(at))}
        total = sum(weights.values())
        want_z += math.log(total)
        for y, w in weights.items():
            want[at] += np.array(y) * w / total
            for a, b in zip(y, y[1:]):
                want_steps[a, b] += w / total
    assert good == pytest.approx(want) and steps == pytest.approx(want_steps) and z == pytest.approx(want_z)


def test_crf_fit_finds_the_maximum():
    """Lines of known features: what is counted is what plain loops count, and the fit's gradient vanishes."""
    rng = np.random.default_rng(4)
    doc = np.repeat(np.arange(30), rng.integers(1, 5, 30))
    own = np.stack([rng.integers(0, 4, len(doc)), np.where(rng.random(len(doc)) < 0.5, quality_crf.N_OWN - 1, -1)], axis=1).astype(np.int16)
    x = quality_crf.Lines(doc, np.ones(len(doc)), own)
    y = rng.random(len(doc))
    want = np.zeros((3, quality_crf.N_OWN))
    for i in range(len(doc)):
        for f in own[i]:
            if f >= 0:
                want[0, f] += y[i]
                if i + 1 < len(doc) and doc[i + 1] == doc[i]:
                    want[1, f] += y[i + 1]
                if i and doc[i - 1] == doc[i]:
                    want[2, f] += y[i - 1]
    assert quality_crf._counts(x, y) == pytest.approx(np.append(want.ravel(), y.sum()))
    quality = rng.integers(0, 2, 30)
    model = quality_crf.fit(x, quality, rounds=0, steps=4000)
    theta = np.concatenate([model.unary, model.pair.ravel()])

    def objective(theta):
        good = (quality[doc] == 1).astype(float)
        score, pair = quality_crf.potentials(x, theta[:-4]), theta[-4:].reshape(2, 2)
        steps = sum(pair[int(good[i]), int(good[i + 1])] for i in range(len(doc) - 1) if doc[i] == doc[i + 1])
        return quality_crf.marginals(x, score, pair)[2] - float(score @ good) - steps + (theta**2).sum()

    least = objective(theta)
    assert all(objective(theta + 0.05 * rng.normal(size=len(theta))) > least for _ in range(20))


def test_quality_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_crf.op7_quality_crf(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.93


def test_quality_edges(docs, empty):
    model = quality_crf.train(docs.select("doc_id", F.lit(1).alias("quality")).limit(0), docs)
    rows = quality_crf.score(docs, model).collect()
    assert len(rows) == len(DOCS) and quality_crf.score(empty, model).count() == 0
    for r in rows:
        assert r["score"] == (pytest.approx(0.5) if (r["text"] or "").strip() else quality_crf.EMPTY_SCORE)


def test_scores_do_not_depend_on_batches():
    texts = [r[1] for r in DOCS]
    model = quality_crf.Model(np.random.default_rng(0).normal(size=3 * quality_crf.N_OWN + 1), np.ones((2, 2)))
    assert model.scores(texts) == pytest.approx(np.concatenate([model.scores([t]) for t in texts]))


# ---- op8

def test_mixing_against_sql(docs, empty):
    planned = mixing.plan_mix(docs.select("doc_id", "text", "source"))
    got = planned.select("doc_id", F.col("__ls_size").alias("size"), F.col("__ls_source_size").alias("source_size"), F.col("__ls_target").alias("target"), (F.col("__ls_size") * F.col("__ls_copies")).alias("taken"))
    same_rows(got, mixing.ORACLE, **tables(docs))
    mixed = mixing.emit_mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == planned.agg(F.sum("__ls_copies")).first()[0]
    assert mixing.emit_mix(empty).count() == 0


def test_targets_against_resharing(spark):
    sizes = [("a", 1000), ("b", 10), ("c", 0), ("d", 500), ("e", 3), ("f", 2000), (None, 40)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weights = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(sizes)}
    total, capped = float(sum(n for _, n in sizes)), {}
    while True:
        open_ = [s for s, _ in sizes if s not in capped]
        share = {s: (total - sum(capped.values())) * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s: 3.0 * n for s, n in sizes if s in share and share[s] > 3 * n}
        if not over:
            break
        capped |= over
    assert got == pytest.approx(capped | share)


def test_mixing_of_more_sources_than_are_broadcast(docs, monkeypatch):
    plan = lambda: sorted(map(str, mixing.plan_mix(docs.select("doc_id", "text", "source")).collect()))
    want = plan()
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert plan() == want


def test_taken_comes_near_targets(spark):
    source = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source")
    rows = mixing.op8_mixing(spark, "/root/testdata/sf0.1").join(source, "doc_id").groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    for r in rows:
        assert r["taken"] == pytest.approx(r["target"], rel=4 / math.sqrt(r["n"]))


# ---- op9

def brute_simhash(rows, radius=3):
    def print_of(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [print_of(t) for _, t in rows]
    component = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(rows)), 2):
            if bin(prints[i] ^ prints[j]).count("1") <= radius and component[i] != component[j]:
                component[i] = component[j] = min(component[i], component[j])
                changed = True
    first = {c: min((r[0] for r, k in zip(rows, component) if k == c and r[0] is not None), default=None) for c in component}
    return sorted(((r[0], format(p, "016x"), first[c]) for r, p, c in zip(rows, prints, component)), key=str)


@pytest.mark.parametrize("max_bucket", [1_000_000, 12])
def test_simhash_against_brute_force(spark, docs, empty, max_bucket):
    rng = np.random.default_rng(2)
    rows = [(r[0], r[1]) for r in DOCS]
    base = [f"w{int(k)}" for k in rng.integers(0, 400, 300)]
    for i in range(25):
        w = list(base)
        for k in rng.integers(0, 300, int(rng.integers(0, 8))):
            w[int(k)] = f"v{i}"
        rows.append((100 + i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash")).repartition(3)
    got = simhash.near_duplicates(d, max_bucket=max_bucket)
    assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == brute_simhash(rows)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.near_dedup(empty).count() == 0


def test_simhash_of_a_hot_fingerprint(spark, docs, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 2)
    rows = [(r[0], r[1]) for r in DOCS] + [(500 + i, None) for i in range(20)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == brute_simhash(rows)


def test_near_dedup_keeps_one_of_each_component(docs):
    want = {c for *_, c in brute_simhash([(r[0], r[1]) for r in DOCS])}
    left = simhash.near_dedup(docs)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == sorted(map(str, want))


def test_covering_masks_cover():
    masks = simhash.covering_masks(list(range(64)))
    rng = np.random.default_rng(0)
    for _ in range(3000):
        diff = sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 4)), replace=False))
        assert any(not diff & m for m in masks)


def test_large_buckets_are_divided():
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 1 << 62))
    fps = np.unique(np.array([centre ^ sum(1 << int(b) for b in rng.choice(24, int(rng.integers(0, 8)), replace=False)) for _ in range(3000)], dtype=np.uint64))
    assert len(fps) > simhash.SMALL
    a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    assert np.array_equal(simhash.bucket_roots(fps), simhash._roots(len(fps), a, b))


def test_components_of_a_chain(spark):
    rng = np.random.default_rng(7)
    nodes = rng.permutation(200)
    edges = [(int(a), int(b)) for a, b in zip(nodes[:120], nodes[1:120])] + [(int(nodes[150]), int(n)) for n in nodes[150:]]
    got = {r["node"]: r["root"] for r in simhash.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {int(n): int(min(nodes[:120])) for n in nodes[:120]} | {int(n): int(min(nodes[150:])) for n in nodes[150:]}
    assert got == want


def brute_similar(rows, shingle=5, similarity=0.8):
    """Sizes of pairs and the component (smallest row) of each text, by comparing all pairs of shingle sets."""
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()

    sets, component = [shingles(t) for t in rows], list(range(len(rows)))
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    for i, j in pairs:
        low, high = sorted((component[i], component[j]))
        component = [low if c == high else c for c in component]
    return pairs, component


def similar_texts(seed=6):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{int(rng.integers(0, 5000))}"
    passage, out = [word() for _ in range(60)], []
    for size in (3, 6, 9, 15, 30, 60, 150, 400, 1200):
        for _ in range(6):
            base = [word() for _ in range(size)] + (passage if size == 400 else [])
            out.append(" ".join(base))
            for edits in (1, size // 200 + 1, size // 120 + 1, size // 90, size // 60, size // 40):
                w = list(base)
                for k in rng.integers(0, len(w), edits):
                    w[int(k)] = word()
                out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_similar_documents_against_brute_force(spark, docs, empty, monkeypatch, block):
    texts = [*similar_texts(), *[r[1] for r in DOCS]]
    pairs, component = brute_similar(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("keys", F.lit("clash")).withColumn("a.b", F.lit(1)).repartition(3)
    sketches = simhash_parts._sketches(d, "doc_id", "text", 5, 0.8)
    monkeypatch.setattr(simhash_parts, "BLOCK", block)
    monkeypatch.setattr(simhash_parts.candidate_pairs, "__defaults__", (block,))
    left = simhash_parts.near_dedup(d)
    assert left.columns == d.columns
    kept = {r["doc_id"] for r in left.collect()}
    lost = set(component) - kept
    assert not lost and len(kept - set(component)) <= 0.02 * len(texts)
    number = {r["n"]: r["id"] for r in sketches.collect()}
    linked = simhash.connected_components(simhash_parts.similar_pairs(d, sketches, "doc_id", "text", 5, 0.8)).collect()
    root = {number[r["node"]]: number[r["root"]] for r in linked}
    found = sum(i in root and root[i] == root.get(j) for i, j in pairs)
    assert len(pairs) > 150 and found >= 0.98 * len(pairs)
    assert all(component[i] == component[r] for i, r in root.items())
    assert simhash_parts.near_dedup(docs).columns == docs.columns and simhash_parts.near_dedup(empty).count() == 0
    ids = sorted(str(r["doc_id"]) for r in simhash_parts.near_dedup(docs).collect())
    by_text = brute_similar([r[1] for r in DOCS])[1]
    assert len(ids) == len(set(by_text)) and "None" not in ids


def test_tables_cover_the_radius():
    masks = [m for _, m in simhash_parts.tables()]
    rng = np.random.default_rng(5)
    for _ in range(3000):
        diff = sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, simhash_parts.RADIUS + 1)), replace=False))
        assert any(not diff & m for m in masks)


def crowded_texts(seed=8):
    """Families of texts whose similarities lie about 0.8, so that most of the closest by SimHash are not similar enough."""
    rng = np.random.default_rng(seed)
    out = []
    for size in (90, 180, 400):
        for _ in range(4):
            base = [f"w{int(k)}" for k in rng.integers(0, 5000, size)]
            for i in range(20):
                w = list(base)
                for k in rng.integers(0, size, int(rng.integers(size // 130 + 1, size // 70 + 2))):
                    w[int(k)] = f"v{int(rng.integers(0, 5000))}"
                out.append(" ".join(w))
    return out


@pytest.mark.parametrize("dense, block, cell", [(4, 4096, 16_384), (0, 4096, 5), (0, 3, 16_384)])
def test_similar_documents_of_crowded_buckets(spark, monkeypatch, dense, block, cell):
    """The components are those of all pairs, whether buckets give all their pairs at once or trees first."""
    texts = crowded_texts()
    pairs, component = brute_similar(texts)
    monkeypatch.setattr(simhash_parts, "DENSE", dense, raising=False)
    monkeypatch.setattr(simhash_parts, "CELL", cell, raising=False)
    monkeypatch.setattr(simhash_parts.candidate_pairs, "__defaults__", (block,))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert 200 < len(pairs) and 60 < len(set(component)) < len(texts) - 60
    assert {r["doc_id"] for r in simhash_parts.near_dedup(d).collect()} == set(component)


@pytest.mark.parametrize("rows", [2, 6, 40, 300])
def test_a_bucket_gives_no_more_than_its_rows(rows):
    """Of a bucket whose rows are all near each other: its pairs or its rows, whichever are fewer."""
    low, high = simhash_parts.tables()[0][0], simhash_parts.tables()[-1][0]
    fp = np.sort(np.random.default_rng(2).permutation(1 << 12)[:rows]).astype(np.int64) << high  # 12 bits of the last block
    size, n = np.full(rows, 100), np.arange(rows) + 7
    own = int(simhash_parts.size_classes(size)[0][0])
    columns = {"b": np.full(rows, own << simhash_parts.KEY_BITS), "n": n, "fp": fp, "size": size, "root": n, "cell": np.zeros(rows, np.int64)}
    out = [b.to_pydict() for b in simhash_parts._linker(4096, "first", 0.8)(iter([pa.RecordBatch.from_pydict(columns)]))]
    pairs = {(u, v) for b in out for k, u, v in zip(b["kind"], b["u"], b["v"]) if k == 0}
    dense = {v for b in out for k, v in zip(b["kind"], b["v"]) if k == 1}
    assert low == 0 and sum(len(b["kind"]) for b in out) <= min(rows, rows * (rows - 1) // 2)
    assert pairs | dense and {x for p in pairs for x in p} | dense == set(n.tolist())


def test_rows_of_a_large_group_grow_with_it(spark, monkeypatch):
    """Twice as many near copies of one text give about twice the rows, and the components of all pairs."""
    made, linked = [], simhash_parts._linked
    monkeypatch.setattr(simhash_parts, "_linked", lambda rows, *options: made.append((out := linked(rows, *options)).count()) or out)
    totals = []
    for copies in (100, 200):
        rng = np.random.default_rng(4)
        base = [f"w{int(k)}" for k in rng.integers(0, 5000, 150)]
        texts = []
        for _ in range(copies):
            w = list(base)
            for k in rng.integers(0, len(w), int(rng.integers(1, 5))):
                w[int(k)] = f"v{int(rng.integers(0, 5000))}"
            texts.append(" ".join(w))
        component = brute_similar(texts)[1]
        d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        made.clear()
        assert {r["doc_id"] for r in simhash_parts.near_dedup(d).collect()} == set(component)
        totals.append(sum(made))
    assert totals[1] < 2.6 * totals[0], totals


def test_parts_cover_small_sets():
    """Sets that differ in no more than the similarity allows share a key if all their parts are kept."""
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(1, 38))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.append(a[rng.permutation(n)[: n - int(rng.integers(0, n // 9 + 1))]], rng.integers(0, 1 << 63, int(rng.integers(0, n // 9 + 1))).astype(np.uint64))
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert np.intersect1d(simhash_parts.part_keys(np.unique(a)), simhash_parts.part_keys(np.unique(b))).size


def test_spanning_tree_is_minimal():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 62, 40).astype(np.uint64) & np.uint64(0xFFF)
    child, parent, far = simhash_parts.spanning_tree(fps)
    edges, component, total = sorted((int(np.bitwise_count(fps[i] ^ fps[j])), i, j) for i, j in itertools.combinations(range(40), 2)), list(range(40)), 0
    for d, i, j in edges:
        if component[i] != component[j]:
            total, a, b = total + d, component[i], component[j]
            component = [a if c == b else c for c in component]
    assert int(far.sum()) == total and set(child) == set(range(1, 40)) and all(int(np.bitwise_count(fps[c] ^ fps[p])) == d for c, p, d in zip(child, parent, far))


# ---- op10

PAGE = """<!DOCTYPE html><html><head><title>Title x</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header><p>Site head</p></header><nav><ul><li><a href="/">Home page with several words</a></li></ul></nav><!-- note > -->
<div class="ad">Buy this now</div><div id="cookie-notice">We use cookies</div>
<article><h1>Big   &amp; small</h1><p><b>First <i>bo</i>ld.<br><p>Second &lt;p&gt; para&nbsp;x</p><div class="share-box">Share me</div>
<ul><li>one</li><li>two</li></ul><form>Your name</form><p hidden>gone</p><table><tr><td>a</td><td>b</td></tr></table></article>
<aside>See also this</aside><section class="comments"><article class="comment"><p>Nice post, I liked every single word of this long text</p></article></section>
<footer>&copy; someone &middot; with a long footer text that goes on and on and on</footer></body></html>"""
TEXT = "Big & small\nFirst bold.\nSecond <p> para x\none\ntwo\ngone\na b"


@pytest.fixture(scope="module")
def weights(spark):
    return html_extract.train(spark.read.parquet(f"{SF}/pages.parquet"))


def test_html_page(weights):
    assert html_extract.extract(PAGE, weights) == TEXT
    formula = "<article><p>So <math><mi>E</mi></math> = <svg><text>mc</text></svg> and <canvas>a drawing</canvas>.</p></article>"
    assert html_extract.extract(formula, weights) == "So E = mc and a drawing."


def test_html_without_labels(weights):
    page = "<body><div class=nav>menu one two three</div><div><h1>Head</h1><p>Body text of the page.</p></div><footer>foot foot foot foot foot foot foot foot foot</footer>"
    assert html_extract.extract(page, weights) == "Head\nBody text of the page."


@pytest.mark.parametrize("page,want", [(None, ""), ("", ""), ("plain words", "plain words"), ("<p", ""), ("<article><p>a &am", "a &am"), ("<nav>only menu</nav>", ""), ("a < b", "a < b"), ("<script>x", "")])
def test_html_edges(weights, page, want):
    assert html_extract.extract(page, weights) == want


def test_html_extract_over_table(spark):
    rows = html_extract.op10_html_extract(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        blocks = (html_lib.unescape(re.sub(r"<[^>]*>", "", b)) for b in re.split(r"</?(?:p|h1)>", body.replace("<br>", " ")))
        assert r["text"] == "\n".join(t for b in blocks if (t := " ".join(b.split()))) and r["n_chars"] == len(r["text"])


def test_html_without_names(spark):
    """With classes and ids removed and all containers renamed to div, pages that were not learned from give the same texts."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    weights = html_extract.fit(sum((html_extract.tally(r["html"]) or Counter() for r in rows[::2]), Counter()))
    same = 0
    for r in rows[1::2]:
        bare = re.sub(r"\s(?:class|id)=\"[^\"]*\"", "", r["html"])
        bare = re.sub(r"<(/?)(?:nav|header|footer|aside|article|section|main)\b[^>]*>", r"<\1div>", bare)
        assert "<article" not in bare and "<nav" not in bare
        same += html_extract.extract(bare, weights) == html_extract.extract(r["html"], weights)
    assert same >= 0.9 * len(rows[1::2])


def test_html_learns_from_labels_alone():
    """What looks like content follows the labelled pages: here it stands in <td>, and paragraphs are boilerplate."""
    labelled = [f"<div><p>bought {i} by the sponsor of the page</p></div><article><table><tr><td>the {i} real words are in a cell of it</td></tr></table></article>" for i in range(40)]
    weights = html_extract.fit(sum((html_extract.tally(p) for p in labelled), Counter()))
    assert html_extract.extract("<div><p>bought by the sponsor of the page</p></div><div><table><tr><td>the real words</td></tr></table></div>", weights) == "the real words"


def test_html_tables(spark, weights):
    rows = [(1, None), (2, ""), (3, PAGE), (3, PAGE), (None, "<p>x</p>"), (4, "<div>" * 3000 + "<p>deep</p>"), (5, "<p>" + "long text " * 100_000 + "</p><nav>" + "<li><a>menu</a></li>" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash")).withColumn("sign", F.lit("clash")).withColumn("a.b", F.lit(1)).repartition(3)
    got = html_extract.extract_text(pages, weights=weights)
    assert got.columns == pages.columns and html_extract.extract_text(pages.limit(0)).count() == 0
    texts = sorted(((str(r["page_id"]), r["text"]) for r in got.collect()), key=lambda r: (r[0], len(r[1])))
    assert [t for t in texts if t[0] != "5"] == [("1", ""), ("2", ""), ("3", TEXT), ("3", TEXT), ("4", "deep"), ("None", "x")]
    assert next(t for i, t in texts if i == "5") == ("long text " * 100_000).strip()
    assert {r["text"] for r in html_extract.extract_text(pages).collect()} >= {"", "deep", "x"}  # weights of these pages alone


def test_best_run_against_brute_force(spark, weights):
    rng = np.random.default_rng(8)
    lists = [rng.normal(size=int(rng.integers(0, 12))).tolist() for _ in range(60)]
    lists += [[score for score, _ in html_extract.scored(r["html"][-1500:], weights)] for r in spark.read.parquet(f"{SF}/pages.parquet").limit(5).collect()]
    for scores in lists:
        sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        start, end = html_extract.best_run(scores)
        assert sum(scores[start:end]) == pytest.approx(max([0.0, *sums.values()]))


# ---- shared

def test_word_hashes_agree_with_equality():
    texts = ["alpha beta alpha", "beta  ÉÉ alpha", None, "", "a" * 5000 + " " + "a" * 5001]
    cps, starts = textarrays.codepoints(texts)
    at, h = textarrays.words(cps, textarrays.classes()[cps] != textarrays.SPACE)
    words = [w for t in texts for w in (t or "").split()]
    assert len(words) == len(h) and all((a == b) == (x == y) for (a, x), (b, y) in itertools.combinations(zip(words, h.tolist()), 2))
    assert list(textarrays.parts(texts, 20)) == [(0, 1), (1, 4), (4, 5)]
