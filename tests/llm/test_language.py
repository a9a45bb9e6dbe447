import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from vicinage.llm import language as L

SCHEMA = "page_id long, url string, html string, host string, text string, lang string, logs string"


def soft(logs):
    e = [math.exp(x - max(logs)) for x in logs]
    return [x / sum(e) for x in e]


def slow(pages, langs, table):
    """(lang, probability) of pages (host, declared, text) by plain loops."""
    n = len(langs)
    logs = []
    for _, _, text in pages:
        raw = b" ".join(text.encode().split())
        slot, _ = L._trigrams([raw])
        count = max(1, len(slot))
        logs.append([sum(table[k, s] for s in slot) / count * min(count, L.EFFECTIVE) for k in range(n)])
    parts = [soft(x) for x in logs]
    hosts, suffixes, said = (defaultdict(lambda: [0.0] * n) for _ in range(3))
    total = [1.0] * n
    for (host, declared, _), own in zip(pages, parts, strict=True):
        for k in range(n):
            hosts[host][k] += own[k]
            suffixes[host.rsplit(".", 1)[-1]][k] += own[k]
            total[k] += own[k]
            if declared in langs:
                said[declared][k] += own[k]
    votes = [sum(v[k] for v in said.values()) for k in range(n)]
    out = []
    for (host, declared, _), own, x in zip(pages, parts, logs, strict=True):
        towards = [t / sum(total) for t in total]
        for counts, weight in ((suffixes[host.rsplit(".", 1)[-1]], L.SUFFIX), (hosts[host], L.HOST)):
            mass = [max(a - b, 0.0) + weight * p for a, b, p in zip(counts, own, towards, strict=True)]
            towards = [m / sum(mass) for m in mass]
        tells = [math.log((said[declared][k] + 0.5) / (votes[k] + 0.5 * n)) if declared in langs else 0.0 for k in range(n)]
        post = soft([a + b + math.log(c) for a, b, c in zip(x, tells, towards, strict=True)])
        out.append((langs[post.index(max(post))], max(post)))
    return out


def test_fusion_equals_plain_loops(spark, medium):
    langs, table = L.profiles(spark.read.parquet(f"{medium}/documents.parquet"))
    assert np.allclose(np.exp(table).sum(axis=1), 1)
    texts = ["the house and the garden of the town", "le chat est dans la maison avec nous", "", "der Hund und die Katze", "x"]
    pages = [(h, d, t) for h in ("a.example.de", "b.example.fr", "c.example.de") for d in ("", langs[0], "zz") for t in texts]
    rows = [(k, f"https://user@{h.upper()}:80/p?q", (f'<html lang="{d}">' if d else "<html>") + f"<body><script>no no</script>{t}</body></html>", *"abcd") for k, (h, d, t) in enumerate(pages)]
    got = L.identified(spark.createDataFrame(rows, SCHEMA), langs, table).orderBy("page_id").collect()
    for row, (lang, probability) in zip(got, slow(pages, langs, table), strict=True):
        assert abs(row["probability"] - probability) < 1e-6
        assert row["lang"] == lang


def test_held_out_documents_are_known_by_their_text(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").filter("lang is not null")
    langs, table = L.profiles(docs.filter("doc_id % 5 <> 0"))
    pages = docs.filter("doc_id % 5 = 0 and length(text) > 100").select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), F.col("lang").alias("truth"))
    found = L.identified(pages, langs, table).join(pages, "page_id")
    assert found.filter("text_lang = truth").count() >= 0.95 * found.count()


def test_every_language_has_a_profile(spark):
    """More than 32 languages, and some with one document in thousands."""
    langs = [f"{a}{b}" for a in "bcdfghj" for b in "aeiouy"]
    common = spark.range(20_000).select(F.lit("the house and the garden").alias("text"), F.lit("en").alias("lang"))
    rare = spark.createDataFrame([(" ".join([x * 3, x + "q" + x, "z" + x]), x) for x in langs], "text string, lang string")
    docs = common.unionByName(rare).withColumn("doc_id", F.monotonically_increasing_id())
    found, table = L.profiles(docs)
    assert found == sorted(["en", *langs]) and table.shape == (43, L.SLOTS)
    rows = [(k, f"http://h{k}.x/", f'<html lang="{x}">{x * 3} {x}q{x} z{x}', *"abcd") for k, x in enumerate(langs)]
    got = L.identified(spark.createDataFrame(rows, SCHEMA), found, table).orderBy("page_id").collect()
    assert [(r["text_lang"], r["lang"]) for r in got] == [(x, x) for x in langs]


def test_odd_pages(spark, medium):
    langs, table = L.profiles(spark.read.parquet(f"{medium}/documents.parquet"))
    rows = [(1, None, None, *"abcd"), (1, None, None, *"abcd"), (None, "not an address", "<", *"abcd"), (2, "http://h.x/", "word " * 50_000, *"abcd"), (3, "", "<html lang=>", *"abcd")]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = L.identified(pages, langs, table)
    assert got.count() == 5 and got.filter("lang is null or probability is null").count() == 0
    assert L.identified(pages.limit(0), langs, table).collect() == []
    assert [r["lang"] for r in L.identified(pages, [], table).collect()] == [None] * 5
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.profiles(empty)[0] == []
