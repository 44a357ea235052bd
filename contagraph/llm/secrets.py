"""Secret scans: pattern candidates, then a random forest trained on labelled findings removes false positives."""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contagraph.llm.common import col, short_batches, table

TREES, DEPTH, LEAF, KEEP, CONTEXT = 40, 9, 3, 0.5, 48
#: Labelled findings beyond so many are sampled for the fit.
MAX_FINDINGS = 50_000
#: Findings written by hand, and how often each counts beside one made by rule.
FINDINGS, WEIGHT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "findings.csv"), 10

# Common words of code, configuration and prose, for dictionary coverage and character transitions.
DICTIONARY = """
about access account action active admin after alpha and application array author basic batch before begin bench beta
bitmap block board body branch browser buffer build button cache call change channel char check child class clear client
close cloud code color column comment commit common component config connect console const container content control core
count create current custom data database date debug default delete demo deploy description design device direct document
double down driver dummy editor element email empty enable engine entity error event example export extension factory false
field file filter final first float folder font format from function general global group handler header height hello help
host html image import index info input insert instance integer internal item java json label language last layout length
level library license line link linux list load local login long main manager master member memory message method model
module name native network node normal null number object only open option order output package page panel param parent
password path pattern place player plugin point policy position post print private process project property public python
query queue random read record remote request reset resource response result return role root route sample schema screen
script search second section secret select server service session setting shared simple size source start state static
status storage stream string style submit system table target task template test text that the theme this time title token
tool true type under union unit update upload user utils valid value vector version video view web widget width window with
word work write your
""".split()
# Words beside a candidate that speak for and against a secret.
FOR = ("token", "secret", "passw", "pwd", "api_key", "apikey", "api-key", "access_key", "private", "credential", "auth", "bearer")
AGAINST = ("sha", "md5", "commit", "checksum", "digest", "integrity", "uuid", "guid", "revision", "etag", "example", "sample", "dummy", "placeholder", "changeme", "build", "version", "hash", "base64", "data:", "your", "insert", "getenv", "${")
PATHS = ("test", "example", "sample", "doc", "fixture", "mock", "lock", "vendor")

_RUN = re.compile(r"[A-Za-z0-9_+/=\-]{16,}").finditer
_VALUE = re.compile(r"[=:] {0,3}[\"']?([^\s\"',;]{8,})").finditer
_DIGIT = re.compile(r"[0-9]").search
_HEX = re.compile(r"[0-9a-fA-F]+").fullmatch


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each candidate: runs of 16 or more key characters, and values assigned after a word for a secret.

    A value gives way to runs with a digit, and goes before those without.
    """
    text = text or ""
    runs = [m.span() for m in _RUN(text)]
    found = [r for r in runs if _DIGIT(text, *r)]
    values = []
    if "=" in text or ":" in text:
        spans = (m.span(1) for m in _VALUE(text) if any(w in text[max(0, m.start() - 24) : m.start()].lower() for w in FOR))
        values = _apart(spans, found)
    return sorted(found + values + _apart((r for r in runs if not _DIGIT(text, *r)), values))


def _apart(spans: Iterable[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap none of the taken ones; both come in order and don't overlap among themselves."""
    out, i = [], 0
    for a, b in spans:
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i == len(taken) or taken[i][0] >= b:
            out.append((a, b))
    return out


def _transitions() -> dict[str, float]:
    pairs, first = Counter(), Counter()
    for w in DICTIONARY:
        for a, b in zip(f"^{w}", f"{w}$"):
            pairs[a + b] += 1
            first[a] += 1
    return {p: math.log((n + 0.1) / (first[p[0]] + 4)) for p, n in pairs.items()}


_STEP, _RARE = _transitions(), math.log(0.1 / 30)
_WORDS = re.compile("|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=len, reverse=True)))
FEATURES = ("length", "transitions", "coverage", "path", "words for", "words against", "entropy", "digits", "upper", "hex", "distinct", "run", "quoted")


def features(value: str, left: str, right: str, path: str) -> list[float]:
    low, n = value.lower(), max(1, len(value))
    steps = [_STEP.get(low[i : i + 2], _RARE) for i in range(n - 1)]
    counts = Counter(value)
    run = best = 1
    for a, b in zip(value, value[1:]):
        run = run + 1 if ord(b) - ord(a) in (0, 1) else 1
        best = max(best, run)
    near, far, where = left.lower()[-24:], (left[-CONTEXT:] + " " + right[:CONTEXT]).lower(), path.lower()
    return [
        float(min(n, 256)), sum(steps) / max(1, len(steps)), sum(len(m) for m in _WORDS.findall(low)) / n,
        float(any(w in where for w in PATHS)), float(any(w in near for w in FOR)), float(any(w in far or w in low for w in AGAINST)),
        -sum(c / n * math.log2(c / n) for c in counts.values()), sum(c.isdigit() for c in value) / n, sum(c.isupper() for c in value) / n,
        float(bool(_HEX(value))), len(counts) / n, float(best), float(left[-1:] in "\"'" and right[:1] in "\"'" and bool(left and right)),
    ]


class Forest:
    """Trees as arrays: feature (-1 at a leaf), limit, left and right child, share of true findings."""

    def __init__(self, trees: list[np.ndarray]) -> None:
        self.trees = trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 2) -> Forest:
        rng = np.random.default_rng(seed)
        return cls([cls._grow(x[pick], y[pick], rng) for pick in (rng.integers(0, len(y), len(y)) for _ in range(trees))])

    @staticmethod
    def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        nodes: list[list[float]] = []

        def grow(at: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append([-1, 0, -1, -1, y[at].mean()])
            if depth == DEPTH or len(at) < 2 * LEAF or y[at].min() == y[at].max():
                return me
            best = (y[at].mean() * (1 - y[at].mean()) - 1e-9, -1, 0.0)
            for f in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
                steps = np.unique(np.quantile(x[at, f], np.linspace(0, 1, 21)))
                for limit in (steps[1:] + steps[:-1]) / 2:
                    side = x[at, f] <= limit
                    n = side.sum()
                    if LEAF <= n <= len(at) - LEAF:
                        p, q = y[at][side].mean(), y[at][~side].mean()
                        best = min(best, ((n * p * (1 - p) + (len(at) - n) * q * (1 - q)) / len(at), int(f), float(limit)))
            if best[1] >= 0:
                side = x[at, best[1]] <= best[2]
                nodes[me][:2] = best[1:]
                nodes[me][2], nodes[me][3] = grow(at[side], depth + 1), grow(at[~side], depth + 1)
            return me

        grow(np.arange(len(y)), 0)
        return np.array(nodes)

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = t[at, 0].astype(np.int64)
                down = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= t[at, 1], t[at, 2], t[at, 3]).astype(np.int64)
                at = np.where(f < 0, at, down)
            total += t[at, 4]
        return total / len(self.trees)


def example_findings(n: int = 4000, seed: int = 11) -> pd.DataFrame:
    """Labelled findings (value, left, right, path, label) made by rule: keys of usual shapes, and what is often mistaken for them."""
    rng = np.random.default_rng(seed)
    chars = {"hex": "0123456789abcdef", "all": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "digit": "0123456789"}
    draw = lambda kind, k: "".join(rng.choice(list(chars[kind]), k))
    word = lambda: str(rng.choice(DICTIONARY))
    text = lambda: " ".join(word() for _ in range(rng.integers(2, 7)))
    out = []
    for _ in range(n):
        good, shape, quote = rng.random() < 0.5, rng.integers(0, 6), str(rng.choice(['"', "'", ""]))
        if good:
            value = [draw("hex", int(rng.choice([32, 40, 64]))), draw("all", int(rng.integers(20, 65))), "AKIA" + draw("upper", 16), "ghp_" + draw("all", 36), draw("all", int(rng.integers(12, 30))), "sk-" + draw("all", 48)][shape]
            left = f"{text()} {rng.choice(['token', 'secret', 'password', 'api_key', 'auth_token', 'access_key'])}{rng.choice([' = ', '=', ': '])}{quote}"
            path = f"{word()}/{word()}.py"
        else:
            value = [draw("hex", int(rng.choice([32, 40, 64]))), "-".join((draw("hex", 8), draw("hex", 4), draw("hex", 4), draw("hex", 12))), "_".join(word() for _ in range(4)) + draw("digit", 1), draw("digit", int(rng.integers(16, 25))), "/".join(word() for _ in range(4)) + "/" + draw("digit", 4), str(rng.choice(["xxxxxxxx", "1234567890123456", "abcdefgh12345678", "changeme-changeme1"])) + draw("digit", 2)][shape]
            left = f"{text()} {rng.choice(['commit', 'sha256', 'md5', 'uuid', 'revision', 'checksum', word()])}{rng.choice([' ', ': ', '='])}{quote}"
            if shape in (2, 5) and rng.random() < 0.5:
                left = f"{text()} {rng.choice(['token', 'secret', 'password'])} = {quote}"
            path = f"{word()}/{word()}.py" if rng.random() < 0.7 else f"{rng.choice(['tests', 'docs', 'example'])}/{word()}.lock"
        out.append((value, left, f"{quote} {text()}", path, int(good)))
    for _ in range(n // 4):  # without digits: keys, often with no word for a secret nearby, and words, rules and paths
        good, shape, quote = rng.random() < 0.5, rng.integers(0, 4), str(rng.choice(['"', "'", ""]))
        if good:
            value = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[: 52 if shape else 26]), int(rng.integers(20, 65))))
        else:
            value = [str(rng.choice(list("-_=+/"))) * int(rng.integers(16, 80)), "".join(word().capitalize() for _ in range(5)), str(rng.choice(list("-_/"))).join(word() for _ in range(4)), "".join(word() for _ in range(4))][shape]
        left = f"{text()} {rng.choice(['token', 'secret', 'password', word(), word(), word()])}{rng.choice([' = ', '=', ': ', ' '])}{quote}"
        out.append((value, left, f"{quote} {text()}", f"{word()}/{word()}.py", int(good)))
    return pd.DataFrame(out, columns=["value", "left", "right", "path", "label"])


def labelled_findings() -> pd.DataFrame:
    """Findings written by hand (shape, label, path, left, value, right); none is a real key."""
    return pd.read_csv(FINDINGS, keep_default_na=False)


def training_findings(by_hand: pd.DataFrame | None = None) -> pd.DataFrame:
    """The examples made by rule, and those written by hand WEIGHT times each."""
    by_hand = labelled_findings() if by_hand is None else by_hand
    return pd.concat([example_findings(), *[by_hand[["value", "left", "right", "path", "label"]]] * WEIGHT])


def fit(findings: pd.DataFrame) -> Forest:
    """A forest from labelled findings; of more than MAX_FINDINGS a sample is used."""
    rows = findings.sample(MAX_FINDINGS, random_state=1) if len(findings) > MAX_FINDINGS else findings
    x = np.array([features(*r) for r in rows[["value", "left", "right", "path"]].itertuples(index=False)])
    return Forest.fit(x, rows["label"].to_numpy(float))


def scan(docs: DataFrame, forest: Forest, keep: float = KEEP, text: str = "text", path: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, length (code points), kind, score, is_secret: a row for each candidate of each row of docs.

    Whole texts are read, however long. Null and empty texts have no candidates; a null path is "". Repeated rows repeat
    their findings, and candidates never overlap; equal candidates in equal surroundings have equal scores. An empty
    table gives no row. Extra columns don't matter. Each row is handled alone, without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest.trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Forest(shared.value)
        for batch in batches:
            ids, spans, x, kinds = [], [], [], []
            for i, t, p in zip(batch.column(0), batch.column(1), batch.column(2)):
                t = t.as_py() or ""
                for a, b in candidates(t):
                    ids.append(i.as_py())
                    spans.append((a, b - a))
                    x.append(features(t[a:b], t[max(0, a - CONTEXT) : a], t[b : b + CONTEXT], p.as_py() or ""))
                    kinds.append("hex" if x[-1][9] else "value")
            score = own.predict(np.array(x)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow_id), pa.array([s for s, _ in spans], pa.int64()), pa.array([n for _, n in spans], pa.int64()), pa.array(kinds, pa.string()), pa.array(score), pa.array(score >= keep)], names=["doc_id", "start", "length", "kind", "score", "is_secret"])

    picked = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"), col(path).cast("string").alias("path"))
    arrow_id = pa.int64()
    return short_batches(picked).mapInArrow(run, T.StructType.fromDDL("doc_id long, start long, length long, kind string, score double, is_secret boolean"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), fit(training_findings()))
