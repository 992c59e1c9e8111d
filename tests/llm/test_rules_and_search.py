"""Quality rules, decontamination, mixing, line templates, licences."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpus_fixtures import docs, odd, texts  # noqa: F401
from creditframe.llm import common, decontaminate, licences, line_templates, mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s or "")


def test_quality_counts(docs, texts):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        expect = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expect
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_keep_is_the_verdict_and_keeps_columns(docs, odd):
    verdict = {r.doc_id for r in quality.judge(docs).collect() if r.kept}
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == verdict
    assert quality.judge(odd).count() == odd.count()
    assert quality.keep(docs.limit(0)).count() == 0


def test_quality_threshold_table_is_data(spark):
    df = spark.createDataFrame([(1, "aa ## bb " * 10)], "doc_id int, text string")
    lax = (quality.Rule("symbols", "symbol_ratio", high=5.0),)
    broken = quality.judge(df).first().broken
    assert "symbols per word" in broken and quality.judge(df, rules=lax).first().broken == []


def test_quality_of_other_languages_and_very_long_texts(spark):
    russian = " ".join(f"слово{i} дом река" for i in range(100))
    long = " ".join(f"the {i}th word of it" for i in range(210_000))
    rows = [(1, russian, "ru"), (2, russian, "en"), (3, russian, None), (4, long, "en")]
    df = spark.createDataFrame(rows, "`doc.id` long, `a text` string, lang string")
    found = {r["doc.id"]: r for r in quality.judge(df, ("doc.id",), "a text").collect()}
    assert [found[i].kept for i in (1, 2, 3, 4)] == [True, False, True, True] and found[4].n_words == 1_050_000
    assert found[2].broken == ["stop words"]
    assert sorted(r["doc.id"] for r in quality.keep(df, "a text").collect()) == [1, 3, 4]
    assert all(r.kept for r in quality.judge(df.drop("lang").filter("`doc.id` < 4"), ("doc.id",), "a text").collect())


def search_brute(texts, bench):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = defaultdict(set)
    for i, t in bench:
        w = word.findall(lower(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            wins[tuple(w[k:k + 13])].add("null" if i is None else str(i))
    out = []
    for t in texts:
        w = word.findall(lower(t))
        cover, items = set(), set()
        for m in {len(x) for x in wins}:
            for k in range(len(w) - m + 1):
                if (hit := tuple(w[k:k + m])) in wins:
                    cover |= set(range(k, k + m))
                    items |= wins[hit]
        out.append((len(w), len(cover), sorted(items), len(cover) > 0 and 20 * len(cover) >= len(w)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, docs, texts, block_bytes):
    bench = [(1, texts[34].split("\n")[1]), (2, "Alpha beta"), (2, "Alpha beta"), (3, None), (4, "  "), (None, texts[0]),
             (5, texts[34].split("\n")[1] + " gamma")]
    table = spark.createDataFrame(bench, "item_id int, text string")
    found = decontaminate.find(docs, table, block_bytes=block_bytes)
    got = {r.row.doc_id: (r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == search_brute(texts, bench)


def test_decontamination_edges(spark, docs, odd):
    none = spark.createDataFrame([], "item_id int, text string")
    assert not any(r.contaminated for r in decontaminate.find(odd, none).collect())
    some = spark.createDataFrame([(1, "same text")], "item_id int, text string")
    assert sum(r.contaminated for r in decontaminate.find(odd, some).collect()) == 2
    assert decontaminate.clean(odd, some, block_bytes=1).count() == odd.count() - 2
    assert decontaminate.clean(docs, none).columns == docs.columns
    assert decontaminate.find(odd.limit(0), some).count() == 0


def test_wu_manber_skips_and_confirms():
    tables = decontaminate.WuManber([(b"a b c d", "x"), (b"z", "y")])
    words = b"q q q q a b c d a b c z".split()
    assert sorted(tables.find(words)) == [(4, 8, ["x"]), (11, 12, ["y"])]


def test_mix_reaches_entropy_or_repetition_limit(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 10 else f"small{i % 30}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    loose = mixing.plan(df, entropy=0.9, max_repeats=1e9)
    n = loose.sources.count()
    from math import log
    assert abs(loose.entropy - 0.9 * log(n)) < 0.01 and 0 < loose.exponent < 1
    tight = mixing.plan(df, entropy=1.0, max_repeats=2.0)
    uses = mixing.realise(df, tight)
    words = {r.doc_id: len(r.text.split()) for r in df.collect()}
    used = defaultdict(int)
    for r in uses.collect():
        used[r.source] += words[r.doc_id]
    for r in tight.sources.collect():
        assert r.tokens <= used[r.source] <= max(r.quota, r.tokens)
        assert r.quota - used[r.source] < 7 * 2           # a cut block stops before the row that does not fit
        assert r.quota <= 2.0 * r.tokens * 1.01
    # nothing is lost, and the same inputs give the same mix
    assert {r.doc_id for r in uses.collect()} == set(range(900))
    assert sorted(map(tuple, uses.collect())) == sorted(map(tuple, mixing.realise(df, mixing.plan(
        df.repartition(5), entropy=1.0, max_repeats=2.0)).collect()))


def test_mix_cut_block_is_a_prefix_of_its_permutation(spark):
    df = spark.createDataFrame([(i, "w w w", "s") for i in range(500)], "doc_id long, text string, source string")
    plan = mixing.plan(df, budget=600)
    uses = mixing.realise(df, plan).collect()
    assert len(uses) == 200 and {r.block for r in uses} == {0}
    row = df.select("doc_id", mixing._row_hash(F.col("doc_id"), F.col("text")).alias("h"))
    keys = sorted(r.k for r in row.select(mixing._block_key(F.col("h"), F.lit(0).cast("long")).alias("k")).collect())
    assert sorted(r.place for r in uses) == keys[:200]


def test_mix_edges(docs, odd):
    assert mixing.mix(docs).columns == docs.columns
    assert {r.doc_id for r in mixing.mix(docs).collect()} == {r.doc_id for r in docs.collect()}
    assert mixing.mix(docs.limit(0)).count() == 0
    one = odd.withColumn("source", F.lit(None).cast("string"))
    assert mixing.mix(one).count() == odd.count()
    blank = docs.filter("text is null")
    assert mixing.mix(blank).count() == blank.count()


def templates_brute(rows, least):
    leaf_docs, lines = defaultdict(set), []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            w = WORD.findall(line)
            if w:
                leaf = (len(w), *("<*>" if re.search("[0-9]", x) else x for x in w[:2]))
                leaf_docs[leaf].add(i)
                lines.append((i, k, leaf, w))
    at = defaultdict(set)
    for i, k, leaf, w in lines:
        for p, x in enumerate(w):
            if not re.search("[0-9]", x):
                at[leaf, p, x].add(i)
    of, docs_of = {}, defaultdict(set)
    for i, k, leaf, w in lines:
        if len(leaf_docs[leaf]) >= least:
            const = [len(at[leaf, p, x]) >= least if (leaf, p, x) in at else False for p, x in enumerate(w)]
            like = sum(c or any(z.isdigit() for z in x) for x, c in zip(w, const)) >= 0.8 * len(w) and sum(const) >= 3
            of[i, k] = " ".join(x if c else "<*>" for x, c in zip(w, const)) if like else " ".join(w)
            docs_of[of[i, k]].add(i)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if len(docs_of.get(of.get((i, k)), ())) < least)
            for i, t in rows if t is not None}


def test_line_templates(spark, docs, texts):
    logs = [f"user {i} logged in from host{i % 4} ok\nsee you" for i in range(12)]
    rows = [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(logs))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row.doc_id: r for r in line_templates.dedupe(df, min_docs=4).collect()}
    assert len(got) == len(rows)
    expect = templates_brute(rows, 4)
    for i, t in rows:
        assert got[i].kept == expect.get(i)
    assert got[1003].n_dropped == 2
    found = {r.template for r in line_templates.templates(df, min_docs=4)[1].collect()}
    assert "user <*> logged in from <*> ok" in found


def test_line_templates_edges(docs, odd):
    got = line_templates.dedupe(odd, min_docs=1)
    assert got.count() == odd.count()
    # equal rows are one document
    assert all(r.n_dropped == 0 for r in line_templates.dedupe(odd.filter("text = 'same text'"), min_docs=2).collect())
    assert line_templates.dedupe(docs.limit(0)).count() == 0


def test_line_templates_recur_from_two_documents(spark):
    rows = [(1, "shared by two only\nalpha own line"), (2, "beta gamma\nshared by two only"), (3, "one more text here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row.doc_id: (r.kept, r.n_dropped) for r in line_templates.dedupe(df).collect()}
    assert got == {1: ("alpha own line", 1), 2: ("beta gamma", 1), 3: ("one more text here", 0)}


def test_unlike_sentences_stay(spark):
    rows = [(1, "And reornd atou of. Thntstsh, the.\nA | and."), (2, "And reornd atou of. Lyeror onrewh.\nA | thndre."),
            (3, "one of the ten words here is not the same red"), (4, "one of the ten words here is not the same blue"),
            (5, "request 17 took 250 ms"), (6, "request 18 took 1 ms")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row.doc_id: r.kept for r in line_templates.dedupe(df).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: "", 4: "", 5: "", 6: ""}


def test_settled_texts_are_not_taken_apart(spark, monkeypatch):
    """Only leaves with a text of too few documents cross a shuffle by token."""
    sizes = {}

    def written(df, name):
        out = common.written(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(line_templates, "written", written)
    shared = "the same notice stands in both texts\nand so does this line of 7 words"
    rows = [(1, shared), (2, shared + "\nalpha own line")]
    got = {r.row.doc_id: r.kept for r in line_templates.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "alpha own line"}
    assert sizes["template-constants"] == 0
    # a third text of the leaf has to be compared with the two
    rows.append((3, "the same notice stands in both books"))
    got = {r.row.doc_id: r.kept for r in line_templates.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "alpha own line", 3: "the same notice stands in both books"}
    assert sizes["template-constants"] == 7


@pytest.mark.parametrize("least", [1, 2, 3])
def test_settled_and_other_texts_share_templates(spark, least):
    heads = ["job a1", "job  b2", "<*> c", "\u00e9t\u00e9 x9$1", "no digit", " no\tdigit"]
    tails = ["is done in time", "is done in 5 s", "is done\rin time", "is <*> in 5 s", "was left as it stood", "was 17 $0 as \\1"]
    # lines of one to all documents, the same but for blanks, digits or a token
    rows = [(i, "\n".join(f"{h} {t}" for j, h in enumerate(heads) for k, t in enumerate(tails) if (7 * i + 3 * j + 5 * k) % (2 + (j + k) % 5) == 0))
            for i in range(7)]
    got = {r.row.doc_id: r.kept for r in line_templates.dedupe(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=least).collect()}
    assert got == templates_brute(rows, least)


@pytest.fixture(scope="module")
def licence_model(docs):
    return licences.train(docs)


def test_licences_on_templates_and_mentions(spark, licence_model):
    rows = [(f"{k}", t) for k, v in licences.TEMPLATES.items() for t in v]
    rows += [(licences.UNKNOWN, m) for m in licences.MENTIONS] + [("MIT", "Gamma beta. Released under the MIT License. Alpha.")]
    df = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)], "doc_id int, text string, want string")
    got = licences.scan(df, licence_model, ("doc_id", "want")).collect()
    right = sum(r.family == r.row.want for r in got)
    assert right >= 0.9 * len(got), [(r.row.want, r.family, r.predicted, r.p, r.similarity) for r in got if r.family != r.row.want]
    assert all(r.family == licences.UNKNOWN for r in got if r.row.want == licences.UNKNOWN)


def test_licence_model_generalises(docs):
    """Held-out accuracy of the classifier on rows it was not fitted to."""
    rows = licences.labelled(docs).filter("held")
    model = licences.train(docs)
    z = rows.select("label", licences._logits(F.array_distinct("grams"), model).alias("z"))
    hits = z.select((F.array_position("z", F.array_max("z")) - 1 == F.col("label")).cast("int").alias("ok"))
    n, ok = hits.agg(F.count("*"), F.sum("ok")).first()
    assert n >= 10 and ok >= 0.9 * n


def test_licences_edges_and_native_plan(spark, odd, docs, licence_model):
    assert licences.scan(odd, licence_model).count() == 0
    assert licences.scan(docs.limit(0), licence_model).count() == 0
    plan = licences.scan(docs, licence_model)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    wrapped = spark.createDataFrame([(1, "x\nAll rights reserved.\n\nALL RIGHTS RESERVED.")], "doc_id int, text string")
    assert [(r.line, r.family) for r in licences.scan(wrapped, licence_model).collect()] == [(1, "Proprietary"), (3, "Proprietary")]


def test_licences_of_wrapped_notices_and_titles(spark, licence_model):
    rows = [
        ("MIT", "MIT License"), ("BSD", "BSD 3-Clause License"), ("GPL", "GNU GENERAL PUBLIC LICENSE"),
        ("MPL-2.0", "Mozilla Public License Version 2.0"), ("MIT", "# SPDX-License-Identifier: MIT"),
        ("MIT", "Some prose\n\nPermission is hereby granted, free of charge, to any person obtaining a\ncopy of this software and "
                "associated documentation files, to deal\nin the Software without restriction"),
        ("GPL", "Some prose\n\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU "
                "General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * later."),
        ("BSD", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"),
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance"),
        (licences.UNKNOWN, "The council read about\nthe licence of the town hall."), (licences.UNKNOWN, "My MIT License plate is blue."),
    ]
    df = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)], "doc_id int, text string, want string")
    got = licences.scan(df, licence_model, ("doc_id", "want")).collect()
    assert {r.row.doc_id for r in got} == set(range(len(rows)))
    assert [] == [(r.notice, r.predicted, r.p, r.similarity) for r in got if r.family != r.row.want]
