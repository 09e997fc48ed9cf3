"""The three audits against SQL on whole tables, and against plain Python on awkward ones."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from compare import differences, oracle_connection
from pyspark.sql import functions as F

from tablefeed.llm.decontaminate import Index, contamination, op13_benchmark_decontamination
from tablefeed.llm.divergence import divergences, op11_source_divergence
from tablefeed.llm.interaction import interactions, op12_filter_interaction
from tablefeed.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string"
AUDITS = ["op11_source_divergence", "op12_filter_interaction", "op13_benchmark_decontamination"]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", AUDITS)
def test_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), oracle_connection(FOLDER), ORACLES[name]) == []


# -- source divergence -------------------------------------------------------------


def brute_divergence(docs):
    docs = [(lang or "", source or "", lowered(text)) for _, text, lang, source in docs]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text) for *_, text in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [(s, t) for (x, s, _), t in zip(docs, terms) if x == lang]
        df = Counter(w for _, t in own for w in set(t))
        kept = sorted(w for w, n in df.items() if n >= 10)
        uses = defaultdict(Counter)
        for source, t in own:
            uses[source].update(w for w in t if df[w] >= 10)

        def shares(count):
            total = sum(count.values()) + 2 * len(kept)
            return {w: 1 + 10**9 * (count[w] + 2) // total for w in kept}

        p = {source: shares(count) for source, count in uses.items()}
        q = shares(sum(uses.values(), Counter()))
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for source in uses:
            pairs = [(-sum(f(p[source][w], p[o][w]) for w in kept), o) for o in uses if o != source]
            over = [w for w in kept if uses[source][w] and p[source][w] > q[w]]
            tops = [(-f(p[source][w], q[w]), w) for w in over]
            by_bytes = lambda x: (x[0], x[1].encode())
            for part, found in (("pair", sorted(pairs, key=by_bytes)), ("term", sorted(tops, key=by_bytes)[:10])):
                out += [(lang, source, part, o, -v, n) for n, (v, o) in enumerate(found, 1)]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def random_documents(seed, n):
    draw = random.Random(seed)
    words = ["Aa", "aA", "b", "été", "ÉTÉ", "naïve", "x1y", "don't", "日本", "c_d", "rare"]
    docs = []
    for i in range(n):
        text = " ".join(draw.choices(words, range(len(words), 0, -1), k=draw.randrange(9)))
        docs.append((i, text, draw.choice(["en", "en", None, ""]), draw.choice(["s", "t", "S", None, ""])))
    return docs + docs[:20] * 3


def test_divergence_equals_plain_python(spark):
    docs = random_documents(1, 150) + [(None, None, "xx", "only"), (None, None, "yy", None), (7, "q", "yy", "a")]
    df = spark.createDataFrame(docs, DOCS).withColumns({"copies": F.lit("c"), "digest": F.lit(1), "term": F.lit(2)})
    got = told(divergences(df))
    assert got == brute_divergence(docs)
    assert ("yy", "", "pair", "a", 0, 1) in got and not any(r[0] == "xx" for r in got)


def test_copies_count_by_source_but_are_tokenized_once(spark, awkward):
    many = awkward.select("text", "lang", "source").union(
        spark.range(3000).selectExpr("'same words here' text", "'en' lang", "cast(id % 3 as string) source")
    )
    docs = [(None, r.text, r.lang, r.source) for r in many.collect()]
    assert told(divergences(many)) == brute_divergence(docs)


def test_counts_beyond_64_bits_stay_exact(spark):
    from tablefeed.llm.divergence import share

    n, total, terms = 4 * 10**12, 9 * 10**13, 10**6
    row = spark.range(1).selectExpr(f"{n}L n", f"{total}L total", f"{terms}L terms").select(share("n", "total", "terms"))
    assert row.first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * terms)


# -- filter interaction --------------------------------------------------------------


def brute_interaction(docs, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    rows = []
    for i, text, _, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > first[text],
        }
        rows.append((source or "", {n for n, f in fails.items() if f}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, shapley, steps = [r for r in rows if r[0] == part], Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, name in enumerate(order, 1):
                before = set(order[: step - 1])
                lost = [r for r in own if name in r[1] and not r[1] & before]
                shapley[name] += len(lost)
                kept = sum(not r[1] & (before | {name}) for r in own)
                twice = sum(name in r[1] and bool(r[1] & before) for r in own)
                alone = sum(r[1] == {name} for r in own)
                counts = (kept, len(lost), twice, alone, sum(r[2] for r in lost), sum(r[3] for r in lost))
                steps.append((part, order, step, *counts, name))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def test_interaction_equals_plain_python(spark):
    draw = random.Random(2)
    words = ["alpha", "Beta", "GAMMA", "#tag", "délta", "ε"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(draw.choices(words, k=draw.randrange(90))) for _ in range(80)] + [None, "", "\x0b \t", "İ" * 60]
    docs = [(draw.choice([None, *range(60)]), draw.choice(texts), None, draw.choice(["a", "b", None, ""])) for _ in range(300)]
    docs += [docs[0]] * 5 + [(i, texts[0], None, "c") for i in range(1000, 1200)]
    labels = [(draw.choice([None, *range(70)]), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(90)]
    df = spark.createDataFrame(docs, DOCS).withColumns({"id": F.lit("x"), "part": F.lit(1), "A": F.lit(2)})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("p"))
    got = sorted(tuple(r) for r in interactions(df, marks).collect())
    assert got == brute_interaction(docs, labels)


# -- benchmark decontamination ---------------------------------------------------------


def brute_contamination(docs, items):
    split = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    windows = defaultdict(set)
    for item, text in items:
        words = split(text)
        size = min(10, len(words))
        for at in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[at : at + size])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, text, *_ in docs:
        words, hit, found = split(text), set(), set()
        for size in sizes:
            for at in range(len(words) - size + 1):
                if (w := tuple(words[at : at + size])) in windows:
                    hit.update(range(at, at + size))
                    found |= windows[w]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def planted(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Été", "ÉTÉ", "A1", "日本"]
    text = lambda n: " ".join(draw.choices(words, k=n))
    items = [(i, text(draw.choice([0, 1, 3, 9, 10, 11, 25, 40]))) for i in range(30)]
    items += [(None, text(12)), (5, text(15)), items[-1], (99, None), (100, "... !")]
    docs = [(None, None), (1, ""), (2, text(9)), (2, text(9))]
    for i in range(120):
        passage = (draw.choice(items)[1] or "").split()
        at = draw.randrange(max(1, len(passage) - 9))
        cut = " ".join(passage[at : at + draw.choice([5, 9, 10, 14, 60])])
        docs.append((i, f"{text(draw.randrange(40))}\n{cut.upper()}, {text(draw.randrange(40))}"))
    return [(i, t, None, None) for i, t in docs], items


@pytest.mark.parametrize("block_bytes", [1 << 24, 200])
def test_contamination_equals_plain_python(spark, folder_of, block_bytes, monkeypatch):
    monkeypatch.setattr("tablefeed.llm.decontaminate.contamination.__defaults__", (block_bytes,))
    docs, items = planted(3)
    df = spark.createDataFrame(docs, DOCS).withColumns({"spans": F.lit("x"), "found": F.lit(1), "row": F.lit(2)})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("part", F.lit(0))
    folder = folder_of(documents=df, benchmark=bench)
    got = sorted((tuple(r) for r in op13_benchmark_decontamination(spark, folder).collect()), key=repr)
    assert got == brute_contamination(docs, items)


def test_spans_are_passages_in_order_and_apart(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"a b {passage} c {passage}")], "doc_id long, text string")
    bench = spark.createDataFrame([("it", passage)], "item_id string, text string")
    row = contamination(docs, bench).first()
    assert [tuple(s) for s in row.spans] == [(2, 32), (33, 63)] and row["items"] == ["it"] and row.n_words == 63


def test_two_windows_of_one_hash_are_refused(monkeypatch):
    import numpy as np

    from tablefeed.llm import decontaminate

    monkeypatch.setattr(decontaminate, "runs", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    with pytest.raises(ValueError, match="one hash"):
        Index.of([("a", b"one two three"), ("b", b"four five six")])


# -- all of them -------------------------------------------------------------------------


def test_awkward_and_empty_tables(spark, awkward, folder_of, tmp_path_factory):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "two three four five"), (2, None)], "item_id long, text string")
    folder = folder_of(documents=awkward, labels=labels, benchmark=bench)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in awkward.collect()]
    got = op12_filter_interaction(spark, folder).collect()
    assert sorted(map(tuple, got)) == brute_interaction(rows, [tuple(r) for r in labels.collect()])
    found = sorted((tuple(r) for r in op13_benchmark_decontamination(spark, folder).collect()), key=repr)
    assert found == brute_contamination(rows, [tuple(r) for r in bench.collect()])
    assert told(op11_source_divergence(spark, folder)) == brute_divergence(rows)
    at = tmp_path_factory.mktemp("empty")
    for name, df in (("documents", awkward), ("labels", labels), ("benchmark", bench)):
        df.limit(0).write.parquet(f"{at}/{name}.parquet")
    for name in AUDITS:
        assert QUERIES[name](spark, str(at)).collect() == []
    awkward.write.mode("overwrite").parquet(f"{at}/documents.parquet")
    assert {r.n_hit for r in op13_benchmark_decontamination(spark, str(at)).collect()} == {0}
    assert {r.good_lost for r in op12_filter_interaction(spark, str(at)).collect()} == {0}
