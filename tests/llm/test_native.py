"""Quality rules, URL filter, mixing and decontamination against brute force."""

from __future__ import annotations

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from hindcast.llm import decontam, mixing, quality, queries, urls

from brute import HARD_TEXTS, words
from tools.compare import connect, normal

DIRECTORY = "/root/testdata/sf0.01"


def counts(text):
    own, text = words(text), text or ""
    lines = [line for line in text.split("\n") if words(line)]
    windows = collections.Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    covered = set()
    for i in range(len(own) - 2):
        if windows[tuple(own[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return (
        len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
    )


def check_quality(rows, texts):
    for row in rows:
        expected = counts(texts(row))
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == expected
        assert row.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (row.base_failed and row.kept)


def test_quality_counts_of_every_document(spark):
    texts = dict(spark.read.parquet(f"{DIRECTORY}/documents.parquet").select("doc_id", "text").collect())
    check_quality(queries.op6_quality(spark, DIRECTORY).collect(), lambda row: texts[row.doc_id])


def test_quality_of_hard_texts(spark, hard, no_rows):
    judged = quality.judged(hard.select("doc_id", "text", "kept", "host"))
    rows = judged.select("text", "_m.*", "base_failed", "kept").collect()
    assert len(rows) == len(HARD_TEXTS) + 3
    check_quality(rows, lambda row: row.text)
    assert quality.judged(no_rows).count() == 0


def test_quality_keeps_good_documents_and_drops_bad_ones(spark):
    labels = spark.read.parquet(f"{DIRECTORY}/labels.parquet")
    judged = queries.op6_quality(spark, DIRECTORY).join(labels, "doc_id").where("not base_failed")
    shares = dict(judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect())
    assert shares[1] > 0.98 and shares[0] < 0.05


def test_quality_is_one_projection(spark):
    plan = queries.op6_quality(spark, DIRECTORY)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Generate", plan)


def verdict(url, rules):
    host = path = ""
    if "://" in (url or ""):
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fitting = [
        (len(h + p), len(h), v == "block", h + p, v)
        for v, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fitting, default=None)
    return (host, path, best[3] if best else None, best[4] if best else "allow")


URLS = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x", "a://b://c.com/",
    "http://example.com/en", "http://example.com/en/", "http://wwwexample.com/en/a", "http://x.net/es/#a", "http://x.net?q=/es/",
    "http://user@h.net:80/fr/", "http://h.net:80/fr/", "http://.com/", "http://a..com/", "http://" + "a." * 200 + "com/" + "p/" * 3000,
    "http://É.com/é\n/x", "http://x.net/fr/\nsecond", "http://x.net/es/",
]


def test_urls_of_every_page_and_hard_ones(spark):
    rules = queries.URL_RULES
    pages = spark.read.parquet(f"{DIRECTORY}/pages.parquet")
    given = dict(pages.select("page_id", "url").collect())
    for row in queries.op8_urls(spark, DIRECTORY).collect():
        assert (row.host, row.path, row.rule, row.verdict) == verdict(given[row.page_id], rules)
    more = [*rules, ("block", "b.com", "/ab"), ("allow", "com", "/abcd"), ("block", "com", "/abcd")]
    asked = [*URLS, *URLS, "http://b.com/abcd", "http://b.com/ab"]
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(asked)], "page_id long, url string, verdict string")
    rows = urls.judged(frame, more).collect()
    assert len(rows) == len(asked)
    for row in rows:
        assert (row.host, row.path, row.rule, row.verdict) == verdict(row.url, more), row.url
    assert urls.judged(frame.limit(0), rules).count() == 0
    clashing = frame.selectExpr("*", "page_id as won", "url as r_host", "url as prefix", "url as e", "url as host")
    named = urls.judged(clashing, [("block", "b.com", "/ab\"'\\é")])
    assert [r.won for r in named.sort("page_id").collect()] == list(range(len(asked)))
    assert {"r_host", "prefix", "e", "host", "path", "rule"} <= set(named.columns)
    quoted = spark.createDataFrame([("http://x.b.com/ab\"'\\é/1",)], "url string")
    assert urls.judged(quoted, [("block", "b.com", "/ab\"'\\é")]).first().rule == "b.com/ab\"'\\é"
    assert {r.verdict for r in urls.judged(frame, []).collect()} == {"allow"}


def test_mix_is_pfair(spark):
    random.seed(3)
    sizes = {"a": 900, "b": 120, "c": 7, None: 33, "": 1}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    mixed = mixing.mixed(docs, parts=50, block_rows=3).toPandas()
    assert len(mixed) == len(rows)
    assert ((mixed.position >= mixed.release) & (mixed.position < mixed.deadline)).all()
    blocks = mixed.drop_duplicates(["source", "block"])
    assert blocks.position.is_unique
    inside = blocks[blocks.mixed]
    end = len(inside)
    assert sorted(inside.position) == list(range(end))
    for _, own in mixed.groupby("source", dropna=False):
        assert (own.groupby("block").size().iloc[:-1] == 3).all()
    for slot in range(end + 1):
        for _, own in inside.groupby("source", dropna=False):
            share = own.target_parts.iloc[0] / own.cycle_parts.iloc[0]
            assert abs((own.position < slot).sum() - share * slot) < 1


def test_mix_of_hard_rows(spark, hard, no_rows):
    first = mixing.mixed(hard.select("doc_id", "source", "position"), ties=["doc_id"]).toPandas()
    again = mixing.mixed(hard.select("doc_id", "source", "position").repartition(5), ties=["doc_id"]).toPandas()
    assert len(first) == len(HARD_TEXTS) + 3
    key = ["source", "position", "doc_id"]
    assert first.sort_values(key)[key].astype(str).values.tolist() == again.sort_values(key)[key].astype(str).values.tolist()
    assert mixing.mixed(no_rows.select("doc_id", "source")).count() == 0


ITEMS = [
    (1, "A train leaves Boston at 40 km per hour and reaches Denver after 7 hours of travel on the old line"),
    (2, "short item text here ok"),
    (3, "too short"),
    (4, None),
    (5, "Alice gave Bob 12 apples and later Bob gave Carol 12 apples from the same old wooden crate"),
]


def leaks(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.changed_slots for r in decontam.leaks(docs, items, **options).collect()}


def test_leaks_exact_changed_and_inconsistent(spark):
    noise = "some other words that stand before it and say nothing at all, "
    texts = [
        noise + ITEMS[0][1] + " and so on",
        noise + ITEMS[0][1].replace("40", "55").replace("Denver", "Seattle"),
        noise + ITEMS[0][1].upper().replace("BOSTON", "Boston").replace("DENVER", "Denver"),
        "says: SHORT item, text here ok!",
        noise + "then Alice gave Dan 9 apples and later Dan gave Eve 9 apples from the same old wooden crate",
        noise + "then Alice gave Dan 9 apples and later Tom gave Eve 8 apples from the same old wooden crate",
        noise * 30,
        None,
    ]
    found = leaks(spark, texts)
    assert set(found) == {(0, 1), (1, 1), (2, 1), (3, 2), (4, 5)}
    assert found[0, 1] == 0 and found[1, 1] == 2 and found[4, 5] > 0


def test_leaks_of_hard_documents(spark, hard, no_rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.leaks(hard, items).count() == 0
    assert decontam.leaks(no_rows, items).count() == 0
    assert decontam.leaks(hard, items.limit(0)).count() == 0


def test_every_planted_passage_is_found(spark):
    def plain(text):
        return " " + " ".join(re.findall(r"\w+", (text or "").lower())) + " "

    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{DIRECTORY}/benchmark.parquet").select("item_id", "text").collect()
    expected = {(d.doc_id, i.item_id) for d in docs for i in items if plain(i.text) in plain(d.text)}
    found = {(r.doc_id, r.item_id) for r in queries.op7_decontamination(spark, DIRECTORY).collect()}
    assert expected and found == expected


@pytest.mark.parametrize("name", ["op1_mixing", "op6_quality", "op7_decontamination", "op8_urls"])
def test_no_python_on_the_main_path(spark, name):
    plan = queries.QUERIES[name](spark, DIRECTORY)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


@pytest.mark.parametrize("directory", ["/root/testdata/sf0.001", DIRECTORY])
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name, directory):
    result = connect(directory).execute(queries.ORACLES[name])
    names = [column[0] for column in result.description]
    df = queries.QUERIES[name](spark, directory)
    assert sorted(df.columns) == sorted(names)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(result.fetchall(), names)
