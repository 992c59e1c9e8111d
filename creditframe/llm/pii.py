"""Personal data by weak supervision: labelers vote, EM weighs, a classifier decides.

1. One narrow pass finds the base spans (fixed patterns and checks) and wider
   candidates that no base pattern accepts: numbers grouped like cards or
   phone numbers (also several in one run), dotted quads, addresses whose
   domain has no dot, and keys or tokens of letters and digits (kind
   ``secret``, which has no base pattern).  Labelers vote on every span:
   pattern, check sum, range or variety, gazetteer (top-level domains, card
   issuers, country codes, special address blocks, known key prefixes),
   context words before it, and its surroundings.
2. Spans are counted per vote pattern (at most kinds x 3^labelers rows);
   expectation-maximisation over the counts estimates each labeler's
   reliability by kind and the probability of each pattern.
3. A logistic span classifier over surface features is fitted to those
   probabilities by Newton steps; each step sums one small matrix per task.
4. Base spans stay; a candidate is added when the classifier gives it at least
   ``ADD``.

The text is read once; the tables of spans are narrow.  All spans train.

Edge cases: null and blank texts have no spans; offsets are code points, end
exclusive; repeated rows are treated one by one; without any span nothing is
trained and nothing is added.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
ADD = 0.8

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wider candidates.
_HOST = re.compile(r"[A-Za-z0-9-]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBER = re.compile(r"\(?(?<![0-9])[0-9][0-9().\x20-]{5,38}[0-9](?![0-9])")
_GROUPED_CARD = re.compile(r"(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}|[0-9]{13,19})(?![0-9])")
_GROUPED_PHONE = re.compile(r"\(?(?<![0-9])[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,128}(?![A-Za-z0-9_+/-])")
_HEX = re.compile(r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})")
_ASSIGNED = re.compile(r"[=:]\s{0,2}[\"']?$")

# Gazetteers.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io de fr es uk eu ch at nl it us ca au".split())
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 "
                          "65 66 81 82 84 86 90 91 92 93 94 95 98".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "6011", "65", "35")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "pk_", "sk_", "xoxb-", "xoxp-", "AIza", "eyJ", "glpat-")
CUES = {
    "email": frozenset("email e-mail mail contact write adresse correo courriel".split()),
    "ip": frozenset("ip host server address addr ping client".split()),
    "card": frozenset("card visa mastercard amex credit debit karte carte tarjeta cc".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell telefon téléphone teléfono".split()),
    "secret": frozenset("token secret password passwd pwd key apikey api bearer credential auth".split()),
}
NOT_CUES = frozenset("version id order total serial isbn commit hash token key build item page no number ref sku".split())
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _quad(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, base?) around every ``@``, left to right."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            found = _DOMAIN.match(text, at + 1)
            wide = found or _HOST.match(text, at + 1)
            if wide:
                yield start, wide.end(), found is not None
                if found:
                    done = found.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out = [(0, a, b) for a, b, ok in emails(text) if ok]
    out += [(1, *m.span()) for m in _IP.finditer(text) if _quad(m[0])]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start():
            d = _digits(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def wider(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that touch no base span and not each other."""
    found = [(0, a, b) for a, b, ok in emails(text) if not ok]
    found += [(1, *m.span()) for m in _IP.finditer(text)]
    for run in _NUMBER.finditer(text):
        found += [(2, *m.span()) for m in _GROUPED_CARD.finditer(text, *run.span()) if 13 <= len(_digits(m[0])) <= 19]
        found += [(3, *m.span()) for m in _GROUPED_PHONE.finditer(text, *run.span()) if 7 <= len(_digits(m[0])) <= 12]
    for m in _SECRET.finditer(text):
        n = len(_digits(m[0]))
        if n >= 3 and sum(c.isalpha() for c in m[0]) >= 3:
            found.append((4, *m.span()))
    out, taken, b = [], sorted((s, e) for _, s, e in base), 0
    end = -1
    for k, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        while b < len(taken) and taken[b][1] <= s:
            b += 1
        if s >= end and not (b < len(taken) and taken[b][0] < e):
            out.append((k, s, e))
            end = e
    return out


def votes(text: str, kind: int, start: int, end: int) -> list[int]:
    """1 for, -1 against, 0 abstains: pattern, check, gazetteer, context, surroundings."""
    s = text[start:end]
    d = _digits(s)
    before = [w.lower() for w in _WORD.findall(text, max(0, start - 40), start)][-3:]
    left, right = text[start - 1:start], text[end:end + 1]
    if kind == 0:
        domain = s.rpartition("@")[2]
        pattern = 1 if "." in domain else -1
        check = -1 if ".." in s or s[0] in ".-" or domain[-1:] == "-" else 1
        gazetteer = 1 if domain.rpartition(".")[2].lower() in TOP_LEVEL and "." in domain else -1
    elif kind == 1:
        pattern = 1
        check = 1 if _quad(s) else -1
        gazetteer = -1 if s.startswith("0.") or s.startswith("255.") else 1
    elif kind == 2:
        pattern = 1 if _GROUPED_CARD.fullmatch(s) else 0
        check = 1 if luhn(d) else -1
        gazetteer = 1 if d.startswith(ISSUERS) else -1
    elif kind == 4:
        pattern = 1 if _HEX.fullmatch(s) or s.startswith(KEY_PREFIXES) else 0
        # random keys change between letters and digits often, part names do not
        mixed = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:])) >= 0.2 * len(s)
        check = 1 if mixed and len(set(s)) >= 10 or s.startswith(KEY_PREFIXES) else -1
        gazetteer = 1 if s.startswith(KEY_PREFIXES) else 0
    else:
        pattern = 1 if s[0] == "+" else 0
        check = 1 if 9 <= len(d) <= 15 else -1
        gazetteer = 1 if s[0] == "+" and any(d.startswith(c) for c in COUNTRY_CODES) else 0
    context = 1 if CUES[KINDS[kind]] & {*before} else -1 if NOT_CUES & {*before} else 0
    if kind == 4:
        return [pattern, check, gazetteer, context, 1 if _ASSIGNED.search(text, max(0, start - 8), start) else 0]
    around = -1 if left.isalnum() or right.isalnum() or left in "._/" and left else 1
    return [pattern, check, gazetteer, context, around]


N_FEATURES = 47


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Surface features: kind, length, make-up, neighbours, hashed words before."""
    s = text[start:end]
    n = len(s)
    digits = sum(c.isdigit() for c in s)
    left, right = text[start - 1:start], text[end:end + 1]
    out = [0.0] * N_FEATURES
    out[kind if kind < 4 else 44] = 1.0
    out[45] = float(kind == 4 and bool(_ASSIGNED.search(text, max(0, start - 8), start)))
    out[46] = float(kind == 4 and bool(_HEX.fullmatch(s)))
    out[4] = min(n, 40) / 40
    out[5] = digits / n
    out[6] = min(sum(not c.isalnum() for c in s), 8) / 8
    out[7] = float(left in (" ", "\n", "\t", ""))
    out[8] = float(right in (" ", "\n", "\t", ""))
    out[9] = float(s[0] == "+")
    out[10] = float(kind == 2 and luhn(_digits(s)))
    out[11] = float("." in s.rpartition("@")[2])
    for w in _WORD.findall(text, max(0, start - 40), start)[-3:]:
        out[12 + zlib.crc32(w.lower().encode()) % 32] = 1.0
    return out


_SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()),
                      T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()),
                      T.StructField("votes", T.ArrayType(T.IntegerType())),
                      T.StructField("features", T.ArrayType(T.FloatType()))])


def candidates(docs: DataFrame, keys: tuple[str, ...], text: str = "text") -> DataFrame:
    """(row struct of ``keys``, spans with votes and features) per row."""
    rows = docs.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("row"),
                       F.col(f"`{text}`").cast("string").alias("text"))
    arrow = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()),
                                ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.float32()))]))
    some = re.compile("[0-9@]")

    def spans(t: str | None) -> list[dict]:
        if not t or not some.search(t):
            return []
        base = base_spans(t)
        both = [(*x, True) for x in base] + [(*x, False) for x in wider(t, base)]
        return [{"kind": k, "start": s, "end": e, "base": b, "votes": votes(t, k, s, e),
                 "features": features(t, k, s, e)} for k, s, e, b in both]

    def run(batches):
        for b in batches:
            found = pa.array([spans(t) for t in b.column(1).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([b.column(0), found], ["row", "spans"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("spans", T.ArrayType(_SPAN))]))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> dict:
    """EM over (kind, votes, count): probability that a span of each pattern
    is personal data.  Every labeler has, per kind, a chance of voting for,
    against or not at all given the truth; priors keep them from flipping."""
    out = {}
    for kind in sorted({p[0] for p in patterns}):
        mine = [p for p in patterns if p[0] == kind]
        v = np.array([p[1] for p in mine]) + 1
        n = np.array([p[2] for p in mine], float)
        hot = np.eye(3)[v]                                   # pattern x labeler x vote
        prior = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])  # against, none, for; given no, yes
        # start from the balance of the votes, in which the check counts most
        q = 1 / (1 + np.exp(-2.0 * ((v - 1).sum(axis=1) + 3 * (v[:, 1] - 1))))
        for _ in range(rounds):
            yes = np.einsum("p,pld->ld", n * q, hot) + prior[1]
            no = np.einsum("p,pld->ld", n * (1 - q), hot) + prior[0]
            share = (n @ q + 1) / (n.sum() + 2)
            score = np.log(share / (1 - share)) + np.einsum(
                "pld,ld->p", hot, np.log(yes / yes.sum(1, keepdims=True)) - np.log(no / no.sum(1, keepdims=True)))
            q = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        out |= {(kind, p[1]): float(x) for p, x in zip(mine, q)}
    return out


def fit(spans: DataFrame, truth: dict, steps: int = 8, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights over ``spans`` (kind, votes, features) with soft labels."""
    weights = np.zeros(N_FEATURES)
    sc = spans.sparkSession.sparkContext
    size = N_FEATURES * (N_FEATURES + 1)
    for _ in range(steps):
        shared = sc.broadcast((weights, truth))

        def sums(batches):
            w, q = shared.value
            total = np.zeros((N_FEATURES, N_FEATURES + 1))
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.array(b.column("features").to_pylist(), float)
                y = np.array([q[k, tuple(v)] for k, v in zip(b.column("kind").to_pylist(), b.column("votes").to_pylist())])
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                total[:, :-1] += (x * (p * (1 - p))[:, None]).T @ x
                total[:, -1] += x.T @ (y - p)
            yield pa.RecordBatch.from_pydict({"s": pa.array([total.reshape(-1).tolist()], pa.list_(pa.float64()))})

        flat = spans.mapInArrow(sums, "s array<double>").select(F.posexplode("s").alias("i", "x"))
        got = flat.groupBy("i").agg(F.sum("x")).collect()   # one small matrix
        total = np.zeros(size)
        for i, x in got:
            total[i] = x
        total = total.reshape(N_FEATURES, N_FEATURES + 1)
        step = np.linalg.solve(total[:, :-1] + ridge * np.eye(N_FEATURES), total[:, -1] - ridge * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-4:
            break
    return weights


def find(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", add: float = ADD) -> DataFrame:
    """(row struct of ``keys``, spans: kind, start, end, base, p) per row."""
    found = written(candidates(docs, keys, text), "pii-spans")
    spans = found.select(F.explode("spans").alias("s")).select("s.*")
    patterns = [(r.kind, tuple(r.votes), r.n) for r in
                spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()]
    truth = reliabilities(patterns)
    weights = fit(spans, truth) if truth else np.zeros(N_FEATURES)
    def p_of(s):
        score = F.aggregate(F.zip_with(s["features"], F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w),
                            F.lit(0.0), lambda a, b: a + b)
        return 1 / (1 + F.exp(-score))

    scored = F.transform("spans", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"),
        p_of(s).alias("p")))
    return found.select("row", F.filter(scored, lambda s: s["base"] | (s["p"] >= add)).alias("spans"))
