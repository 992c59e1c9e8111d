"""Token alignment against a plain version, and the fragment monoid."""

import hashlib
import random
from collections import Counter
from functools import reduce

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from corpus_fixtures import docs, odd, texts  # noqa: F401
from creditframe.llm import token_alignment as ta
from creditframe.llm.common import tokenizer_file
from creditframe.llm.pretokens import byte_letters


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(tokenizer_file(ta.FIRST))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=tokenizer_file(ta.SECOND))


def tokens(tools, text):
    """[(id, bytes)] by both libraries on the whole text; None where bytes differ."""
    a, b = tools
    if not text:
        return None
    byte = {v: k for k, v in byte_letters().items()}
    x = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    y = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        y.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (x, y) if all(b"".join(t for _, t in s) == whole for s in (x, y)) else None


def spans(side):
    at, out = 0, []
    for i, t in side:
        out.append((at, at + len(t), i))
        at += len(t)
    return out


def plain(tools, rows):
    """Result rows in the order of ``rows`` (id, text)."""
    linked, parts = [], []
    for _, text in rows:
        both = tokens(tools, text)
        if both is None:
            linked.append([])
            parts.append(None)
            continue
        x, y = spans(both[0]), spans(both[1])
        linked.append([(i, j) for a, b, i in x for c, d, j in y if a < d and c < b])
        ends = sorted({b for _, b, _ in x} & {d for _, d, _ in y})
        groups, lo = [], 0
        for e in ends:
            groups.append(",".join(str(i) for _, b, i in x if lo < b <= e) + "|" + ",".join(str(j) for _, d, j in y if lo < d <= e))
            lo = e
        parts.append((len(x), len(y), groups))
    count = Counter(p for links in linked for p in links)
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    out = []
    for (id, _), links, part in zip(rows, linked, parts):
        n_a, n_b, groups = part or (0, 0, [])
        out.append((id, n_a, n_b, len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if part else ""))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


ODD = ["", None, " ", "  two  blanks ", "▁lower", "a ▁ b", "tab\tnew\nline \n x", "日本 語 text", "naïve café’s don't I'LL we've",
       "<|endoftext|> plain <s>", "x" * 300, "123,456.78 £9 — ½", "é" * 40, "zero\x00byte", "　wide　 space", "ᚠᛇᚻ",
       "\U0001f600\U0001f468‍\U0001f469", "ﬁ Å", "end ", "a  ", "\n\n", "́combining"]


def test_whole_documents(spark, tools, texts):
    rows = list(enumerate([*texts, *ODD]))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_a int, `key` string").repartition(4)
    assert sorted(map(tuple, ta.align(df).collect())) == sorted(plain(tools, rows))


def test_long_documents_in_fragments(spark, tools, texts, monkeypatch):
    monkeypatch.setattr(ta, "FAN", 3)
    monkeypatch.setattr(ta, "PACK", 50)
    rng = random.Random(2)
    pieces = [t for t in [*texts, *ODD] if t and "▁" not in t and "　" not in t]
    rows = [(i, " ".join(rng.choices(pieces, k=6))[:1500]) for i in range(12)] + [(98, "no" * 400), (99, "a ▁ b " * 40), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ta.align(df, chunk=37).collect()), key=key) == sorted(plain(tools, rows), key=key)


def test_odd_rows(spark, tools, odd):
    rows = [tuple(r) for r in odd.collect()]
    assert sorted(map(tuple, ta.align(odd).collect()), key=key) == sorted(plain(tools, rows), key=key)
    assert ta.align(odd.limit(0)).collect() == []
    named = odd.selectExpr("cast(doc_id as string) as `a.b`", "text as `t t`")
    assert ta.align(named, id="a.b", text="t t").count() == len(rows)


def fragment_of(ends_a, ends_b, lo, hi, k):
    run = tuple(np.array(x, np.int64) for x in (range(len(ends_a)), ends_a, range(len(ends_b)), ends_b))
    return ta.Fragment.of(ta._clip(run, lo, hi), k)


def test_fragments_compose_in_any_order():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(6, 60)
        ends_a = sorted({*rng.sample(range(1, n), n // 3), n})
        ends_b = sorted({*rng.sample(range(1, n), n // 4), n})
        cuts = [0, *sorted(rng.sample(range(1, n), rng.randint(1, 5))), n]
        found = [fragment_of(ends_a, ends_b, a, b, k) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]

        def total(items):
            """Compose (fragment, groups) pairs by a random bracketing."""
            if len(items) == 1:
                return items[0]
            m = rng.randint(1, len(items) - 1)
            (f, x), (g, y) = total(items[:m]), total(items[m:])
            whole, seam = f.then(g)
            return whole, x + y + ([seam] if seam else [])

        whole, seams = total([(f, []) for f, _ in found])
        flat = reduce(lambda acc, f: (lambda r: (r[0], acc[1] + ([r[1]] if r[1] else [])))(acc[0].then(f)), [f for f, _ in found[1:]],
                      (found[0][0], []))
        assert [x.tolist() for x in whole.prefix] == [x.tolist() for x in flat[0].prefix]
        assert sorted((s[0], [x.tolist() for x in s[1]]) for s in seams) == sorted((s[0], [x.tolist() for x in s[1]]) for s in flat[1])
        common = sorted(set(ends_a) & set(ends_b))
        closed = sum(len(np.intersect1d(c[1], c[3])) for _, c in found if c) + len(seams) + 1
        assert closed == len(common) and not len(whole.suffix[0]) and not len(whole.suffix[2])


def test_cuts_are_safe(tools):
    text = (" " + "One two,  three\n four　 five's \tsix 7 8 nine ' ten " * 5).encode()
    both = ta.Tokenizers(tokenizer_file(ta.FIRST), tokenizer_file(ta.SECOND))
    whole = [x[0].tolist() for x in both.encode([text])[:2]]
    for at in range(1, len(text)):
        cut = ta.safe_cut(text, at, 1)
        assert ta.safe_cut(text, at, -1) <= at <= cut
        if cut < len(text):
            sides = [both.encode([text[:cut]]), both.encode([text[cut:]])]
            assert [sides[0][i][0].tolist() + sides[1][i][0].tolist() for i in (0, 1)] == whole
