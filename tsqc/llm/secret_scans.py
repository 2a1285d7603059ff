"""Secret scans: patterns find candidates, a random forest removes false positives.

The forest sees length, character transitions, entropy, dictionary coverage, path marks and the neighbouring words of each
candidate. It is trained on the driver from labelled findings, of which at most TRAIN_BOUND are used. Where no findings are given,
labelled_findings() makes them from rules and a fixed seed. Texts are scanned whole in Arrow batches; nothing is shuffled.

Defined results: a null or empty text has no findings; of findings at one place the longest counts; repeated rows are
scanned each for itself; an empty table gives no rows; positions are code points; other columns do not matter, and redact()
leaves them as they are.
"""

from __future__ import annotations

import math
import random
import re
import string
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsqc.llm.common import mapped

TRAIN_BOUND = 20_000
AROUND = 48  # characters looked at on either side
THRESHOLD = 0.5

# Published shapes of credentials, words that go with secrets or with harmless identifiers, and common words.
SHAPES = {
    "cloud_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "platform_token": r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})",
    "web_token": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----\s*(?:[A-Za-z][A-Za-z0-9-]{0,40}:[^\n]{0,400}\n\s*){0,20}[A-Za-z0-9+/=\s]{16,}-----END [A-Z ]*PRIVATE KEY-----",
    "assigned": r"(?:\b[A-Za-z0-9_-]{0,64}?)?(?i:password|passwd|pwd|secret|token|api[_-]?key|auth|bearer|access[_-]?key|client[_-]?secret)(?:s|[0-9]{1,4})?(?:[_-][A-Za-z0-9_-]{0,64}|[A-Z][a-z0-9][A-Za-z0-9_-]{0,64})?\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?P<v>[^\s\"',;]{8,})",
    "opaque": r"(?<![A-Za-z0-9_+/-])[+/-]*(?P<o>[A-Za-z0-9_][A-Za-z0-9_+/-]{19,}={0,2})",
}
SECRET_WORDS = "password passwd pwd secret token api key apikey auth authorization bearer credential credentials private access login".split()
HARMLESS_WORDS = "commit sha sha1 sha256 md5 checksum digest hash revision uuid guid version etag build image example sample placeholder changeme xxxx http https www file path id".split()
COMMON_WORDS = "able about access account after again all also and any are back base been before block body book buffer build button call change check class client close code color column common config content count create current data date default delete description details device direct display document down each edit element email empty enable end error event example false field file filter find first for form format from function get global group handler have head height help hidden home icon image index info init input insert into item java just key kind label last left length level line link list load local log long main make manager map match max menu message method min mode model module more name network new next node not null number object off only open option order output page panel parent part pass path place plain point position post prev print process project property public query read record reference remove render request reset resource response result right root row run save script search section select send server service session set shared show side simple size some source start state status string style submit super switch system table target task template test text than that the their them then there they thing this time title token top total tree true type under unit update upload user util value view visible was web what when where which width window with word work world would write year your".split()
FEATURES = "length transitions entropy digits upper lower other hex dictionary vowels path url assigned quoted secret_near harmless_near shape repeat".split()

PATTERN = re.compile("|".join(f"(?P<{k}>{v})" for k, v in SHAPES.items() if k != "opaque"))
OPAQUE = re.compile(SHAPES["opaque"])  # between the others; with a letter and a digit
LETTER, DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")
# What each shape cannot do without. A text with none of it has no candidate and is passed over.
HINTS = {
    "cloud_key": "AKIA|ASIA",
    "platform_token": "gh[pousr]_|xox[abprs]-|sk_(?:live|test)_|AIza",
    "web_token": "eyJ",
    "private_key": "PRIVATE KEY",
    "assigned": "(?i:password|passwd|pwd|secret|token|key|auth|bearer)",
    "opaque": "[0-9]",
}
HINT = re.compile("|".join(HINTS[k] for k in SHAPES))
WORD = re.compile(r"[A-Za-z]+")
COMMON = frozenset(w for w in COMMON_WORDS if len(w) > 3)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order and apart."""
    out: list[tuple[int, int, str]] = []
    if not HINT.search(text):
        return out
    taken = [(0, 0)]
    for m in PATTERN.finditer(text):
        taken.append(m.span())
        a, b = m.span("v") if m["v"] else m.span()
        out.append((a, b, next(k for k in SHAPES if k != "opaque" and m[k])))
    if not DIGIT.search(text):
        return out
    more = []
    for (_, lo), (hi, _) in zip(taken, [*taken[1:], (len(text), 0)]):
        for m in OPAQUE.finditer(text, lo, hi):
            if LETTER.search(m["o"]) and DIGIT.search(m["o"]):
                more.append((*m.span("o"), "opaque"))
    return sorted(out + more)


def _coverage(s: str) -> float:
    """Share of characters in common words, the longest first at each place."""
    low, at, n = s.lower(), 0, 0
    while at < len(low):
        for size in range(min(12, len(low) - at), 3, -1):
            if low[at : at + size] in COMMON:
                n += size
                at += size
                break
        else:
            at += 1
    return n / max(1, len(s))


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(value: str, before: str, after: str, kind: str) -> list[float]:
    n = max(1, len(value))
    kinds = [_kind(c) for c in value]
    counts = np.bincount([ord(c) % 256 for c in value], minlength=1)
    p = counts[counts > 0] / n
    near_words = [w.lower() for w in WORD.findall(before[-AROUND:])[-4:]] + [w.lower() for w in WORD.findall(after[:AROUND])[:1]]
    low = value.lower()
    share = lambda k: kinds.count(k) / n
    return [
        math.log(n), sum(a != b for a, b in zip(kinds, kinds[1:])) / n, float(-(p * np.log2(p)).sum()), share(0), share(2), share(1), share(3),
        sum(c in string.hexdigits for c in value) / n, _coverage(value), sum(c in "aeiou" for c in low) / n, value.count("/") / n + value.count(".") / n, float("://" in before[-12:] or "www" in low or "http" in low),
        float(bool(re.search(r"[:=]\s{0,3}[\"']?$", before[-6:]))), float(before[-1:] in "\"'" and before[-1:] != "" and after[:1] == before[-1:]),
        float(sum(w in SECRET_WORDS for w in near_words)), float(sum(w in HARMLESS_WORDS for w in near_words)),
        float(list(SHAPES).index(kind)), len(set(low)) / n,
    ]


def labelled_findings(n: int = 4000, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """(value, before, after, kind, 1 for a secret) made by rules: keys, tokens and passwords against digests, identifiers, paths and placeholders."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choices(chars, k=k))
    hexes, alnum, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    prose = lambda: " ".join(pick("aeinorstlhd", r.randint(2, 8)) for _ in range(4))
    out = []
    for _ in range(n):
        q, op, filler = r.choice(['"', "'", ""]), r.choice([" = ", "=", ": ", " : "]), prose()
        word = r.choice(["password", "token", "secret", "api_key", "auth", "client_secret", "pwd", "access_key", "bearer"])
        case = r.randrange(14)
        if case == 0:
            out.append((r.choice(["AKIA", "ASIA"]) + pick(upper, 16), filler + " ", " " + prose(), "cloud_key", 1))
        elif case == 1:
            out.append((r.choice(["ghp_", "gho_"]) + pick(alnum, 36), filler + r.choice([" ", op]), " ", "platform_token", 1))
        elif case in (2, 3):
            out.append((pick(hexes, r.choice([18, 20, 32, 40, 64])), f"{filler} {word}{op}{q}", q + " " + prose(), "assigned", 1))
        elif case == 4:
            out.append((pick(alnum + "!@#%_-", r.randint(10, 40)), f"{filler} {word}{op}{q}", q + " ", "assigned", 1))
        elif case == 5:
            out.append((pick(alnum + "+/", r.choice([32, 40, 44, 64])), f"{filler} {r.choice(['secret', 'key', 'private'])}{op}{q}", q, "opaque", 1))
        elif case == 6:
            out.append((pick(hexes, r.choice([32, 40, 64])), f"{filler} {r.choice(['commit', 'sha256', 'md5', 'checksum', 'digest', 'revision', 'etag'])}{r.choice([' ', op])}", " ", "opaque", 0))
        elif case == 7:
            out.append(("-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), f"{filler} {r.choice(['uuid', 'id', 'guid'])}{r.choice([' ', op])}", " ", "opaque", 0))
        elif case == 8:
            out.append((r.choice(["_", "-", "/"]).join(r.choice(COMMON_WORDS) for _ in range(5)) + pick(string.digits, 2), filler + " ", " ", "opaque", 0))
        elif case == 12:
            out.append((f"eyJ{pick(alnum, r.randint(12, 40))}.eyJ{pick(alnum + '_-', r.randint(12, 90))}.{pick(alnum + '_-', 43)}", filler + r.choice([" ", op, " Bearer "]), r.choice([" ", q]), "web_token", 1))
        elif case == 13:
            body = "\n".join(pick(alnum + "+/", 64) for _ in range(r.randint(2, 20)))
            out.append((f"-----BEGIN {r.choice(['RSA ', 'EC ', 'OPENSSH ', ''])}PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----", filler + "\n", "\n", "private_key", 1))
        elif case == 9:
            out.append(("".join(w.title() for w in r.choices(COMMON_WORDS, k=2)) + r.choice(["", "()", ".value"]), f"{filler} {word}{op}", " ", "assigned", 0))
        elif case == 10:
            out.append((r.choice(["xxxxxxxx", "********", "changeme", "placeholder", "<your-key>", "${SECRET}", "example12", "required"]) * r.choice([1, 1, 2]), f"{filler} {word}{op}{q}", q, "assigned", 0))
        else:
            out.append(("/".join(pick("aeinorstlhd", r.randint(3, 9)) for _ in range(4)) + pick(string.digits, 3), filler + r.choice([" https://www.", " "]), " ", "opaque", 0))
    return out


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, children, share of secrets."""

    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, leaf: int = 4, seed: int = 11) -> Forest:
        r = np.random.default_rng(seed)
        wide = max(1, int(math.sqrt(x.shape[1])))
        for _ in range(trees):
            nodes: list[list[float]] = []

            def grow(rows: np.ndarray, d: int) -> int:
                me = len(nodes)
                nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
                if d == depth or len(rows) < 2 * leaf or y[rows].min() == y[rows].max():
                    return me
                best = (0.0, -1, 0.0)
                total, ones = len(rows), y[rows].sum()
                for f in r.choice(x.shape[1], wide, replace=False):
                    order = np.argsort(x[rows, f], kind="stable")
                    v, s = x[rows[order], f], np.cumsum(y[rows[order]])
                    at = np.flatnonzero(v[1:] != v[:-1])
                    at = at[(at + 1 >= leaf) & (total - at - 1 >= leaf)]
                    if not len(at):
                        continue
                    nl, ol = at + 1, s[at]
                    nr, o_r = total - nl, ones - ol
                    within = (ol**2 + (nl - ol) ** 2) / nl + (o_r**2 + (nr - o_r) ** 2) / nr
                    gain = within - (ones**2 + (total - ones) ** 2) / total  # fall of the Gini impurity, times the rows
                    i = int(gain.argmax())
                    if gain[i] > best[0] + 1e-9:
                        best = (float(gain[i]), int(f), float(v[at[i]]))
                if best[1] >= 0:
                    go = x[rows, best[1]] <= best[2]
                    nodes[me][:2] = best[1:]
                    nodes[me][2] = grow(rows[go], d + 1)
                    nodes[me][3] = grow(rows[~go], d + 1)
                return me

            grow(r.integers(0, len(x), len(x)), 0)
            a = np.array(nodes)
            self.trees.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            while (live := f[at] >= 0).any():
                i = np.flatnonzero(live)
                go = x[i, f[at[i]]] <= threshold[at[i]]
                at[i] = np.where(go, left[at[i]], right[at[i]])
            total += share[at]
        return total / max(1, len(self.trees))


def train(findings: list[tuple[str, str, str, str, int]] | None = None, seed: int = 11) -> Forest:
    """From labelled findings (value, before, after, kind, 1 or 0), at most TRAIN_BOUND of them."""
    findings = labelled_findings() if findings is None else findings
    if len(findings) > TRAIN_BOUND:
        findings = random.Random(seed).sample(findings, TRAIN_BOUND)
    if not findings:
        return Forest()
    x = np.array([features(*f[:4]) for f in findings])
    return Forest().fit(x, np.array([f[4] for f in findings], float), seed=seed)


def _judged(texts: list[str | None], forest: Forest) -> list[tuple[int, int, int, str, float]]:
    """(row, start, end, kind, score) of all candidates."""
    found, x = [], []
    for row, t in enumerate(texts):
        for a, b, kind in candidates(t or ""):
            found.append((row, a, b, kind))
            x.append(features(t[a:b], t[max(0, a - AROUND) : a], t[b : b + AROUND], kind))
    scores = forest.predict(np.array(x)) if x else []
    return [(*f, float(s)) for f, s in zip(found, scores)]


def scan(df: DataFrame, forest: Forest, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per candidate: doc_id, start, end, kind, score, is_secret."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            keys = b.column(0)
            found = _judged(b.column(1).to_pylist(), shared.value)
            columns = [list(c) for c in zip(*found)] or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.float64()), pa.array([s >= THRESHOLD for s in columns[4]], pa.bool_())],
                ["doc_id", "start", "end", "kind", "score", "is_secret"],
            )

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).transform(
        mapped, run, "doc_id long, start long, end long, kind string, score double, is_secret boolean"
    )


def redact(df: DataFrame, forest: Forest, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of df, with the secrets in its texts replaced by mark."""
    shared = df.sparkSession.sparkContext.broadcast(forest)
    at = df.columns.index(text)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            spans: dict[int, list[tuple[int, int]]] = {}
            for row, start, end, _, score in _judged(texts, shared.value):
                if score >= THRESHOLD:
                    spans.setdefault(row, []).append((start, end))
            for row, cuts in spans.items():
                t, parts, last = texts[row], [], 0
                for start, end in cuts:
                    parts += [t[last:start], mark]
                    last = end
                texts[row] = "".join(parts) + t[last:]
            columns = list(b.columns)
            if spans:
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return df.transform(mapped, run, df.schema)
