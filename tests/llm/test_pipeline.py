"""Each stage of the corpus pipeline beside a plain version of its decision, on the rows that its predecessor kept."""

from collections import Counter

import numpy as np
from brute import components, passages, without
from compare import sql_rows
from test_packing import check as check_packing

import corpus_pipeline
from vicinage.llm import mixing, toxicity


def test_stages_take_effect(spark, small, tmp_path):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, steps[-1], small).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        steps.append(spark.read.parquet(f"{tmp_path}/{name}/documents.parquet"))
    texts = [Counter((r["doc_id"], r["text"]) for r in df.collect()) if "text" in df.columns else None for df in steps]
    assert all(df.columns == columns for df in steps[:-1])

    machine = toxicity.trained(spark, docs, small)

    def toxic(text):
        slot, _ = toxicity.terms([(text or "").encode()])
        pairs = sum(machine.v[i] @ machine.v[j] for k, i in enumerate(slot) for j in slot[k + 1 :] if machine.v[i].any() and machine.v[j].any())
        return 1 / (1 + np.exp(-(machine.bias[0] + machine.w[slot].sum() + pairs))) >= 0.5

    short = {k: n for k, n in texts[0].items() if len(k[1] or "") < 4000}
    assert all((k in texts[1]) == (not toxic(k[1])) for k in short)
    assert len(texts[1]) > 0.7 * len(texts[0])

    root = components(list(texts[1]), 5)
    assert texts[2] == Counter({k: n for k, n in texts[1].items() if root[k[0]][1] == k[0]})

    spans = {}
    for doc, start, n, _ in passages(list(texts[2]), 50):
        spans.setdefault(doc, []).append((start, n))
    assert texts[3] == Counter((i, without(t, spans[i]) if i in spans else t) for i, t in texts[2].elements())

    names, rows = sql_rows(mixing.OP9_SQL, f"{tmp_path}/repeats")
    at = {c: names.index(c) for c in names}
    copies = {int(r[at["doc_id"]]): int(r[at["taken"]]) // max(1, int(r[at["size"]])) for r in rows}
    assert texts[4] == Counter({k: copies[k[0]] for k in texts[3] if copies[k[0]]})

    check_packing(steps[5].collect(), list(texts[4].elements()), Tokenizer.from_file(path("byte_bpe_50k.json")), 0.97)


def test_run_gives_what_the_stages_give(spark, small):
    got = corpus_pipeline.run(spark, small)
    again = corpus_pipeline.run(spark, small)
    key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert Counter(map(tuple, got.select(*key).collect())) == Counter(map(tuple, again.select(*key).collect()))
