"""Secret scans with a random forest against false positives.

Candidates are long tokens of key-like characters, values assigned to
credential names, passwords in URLs and private key blocks.  Each is described
by its length, its transitions between character classes, its shares of
digits, capitals and vowels, its longest run of consonants, its entropy, how
much of it dictionary words cover, the path it belongs to and the words around
it.  A random forest (Gini splits, bootstrap rows, random columns per split)
trained on labelled findings decides which are secrets.

The dictionary is counted from all documents: of the alphabetic words in at
least ``COMMON`` of them the ``WORDS`` most frequent, so its size is bounded.
The path is the last file name in the text before the candidate, or else a
column's value.

Public data has no labelled findings; ``labelled_findings`` makes a bounded,
seeded set of them (``FINDINGS``) in ``FAMILIES``: credential formats in use
against checksums, identifiers, placeholders, numbers, words and names in
code.  Other findings can be passed to ``fit``.

Defined cases: a null or empty text has no candidates; texts are scanned whole,
and candidates of any length are found and described whole;
a null path is empty; rows that repeat are scanned each; other columns are
ignored; without documents the dictionary is empty.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm._spark import small_batches

FINDINGS, TREES, DEPTH, LEAF, CUTS, AROUND = 4000, 30, 9, 3, 24, 160
WORDS, COMMON, SHORTEST, LONGEST = 50_000, 5, 4, 14
_NAME = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credentials?|private[_-]?key)"
# in turn: a private key block, a password in a URL, an assigned value, a long token
CANDIDATE = re.compile(
    r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----((?:[^-]|-(?!----)){16,}?)-----END|(?<=[a-z0-9+.-])://[^\s/:@]*:([^\s/@]{3,})@"
    rf"|(?<![A-Za-z0-9])(?i:[a-z0-9]+[_-])?(?i:{_NAME})[\"']?[ \t]*[:=]>?[ \t]*[\"']?([^\s\"'<>;,]{{6,}})|(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{{16,}}={{0,2}})(?![A-Za-z0-9+/_-])"
)
_WORD = re.compile(r"[A-Za-z]{2,}")
_FILE = re.compile(r"[\w./-]*\w\.(?:py|js|ts|java|go|rb|php|sh|env|ya?ml|json|toml|ini|cfg|conf|properties|xml|md|txt|pem|key)\b", re.I)
# fixed values: names that hold credentials, names that hold other ids, words of placeholders, paths of tests, files of settings, prefixes of keys
CREDENTIAL = {"access", "akia", "api", "apikey", "auth", "bearer", "credential", "credentials", "key", "login", "passphrase", "passwd", "password", "private", "pwd", "secret", "token"}
OTHER = {"card", "checksum", "commit", "digest", "etag", "hash", "id", "integrity", "md5", "order", "phone", "revision", "sha", "sha1", "sha256", "uuid", "version"}
PLACEHOLDER = {"changeme", "default", "demo", "dummy", "example", "fake", "foobar", "insert", "mypassword", "none", "null", "placeholder", "replace", "sample", "string", "test", "todo", "undefined", "value", "xxxx", "your"}
TESTS = re.compile(r"test|spec|fixture|example|sample|mock|doc", re.I)
SETTINGS = re.compile(r"\.(env|ya?ml|ini|cfg|conf|properties|toml|pem|key)\b|deploy|config|settings", re.I)
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xox", "sk_", "pk_", "AIza", "eyJ")
_CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxz]+")
_VOWELS = re.compile(r"[aeiouy]")


def dictionary(docs: DataFrame, column: str = "text", words: int = WORDS, common: int = COMMON) -> list[str]:
    """The ``words`` most frequent alphabetic words of all ``docs``, of those in at least ``common`` rows."""
    each = F.array_distinct(F.regexp_extract_all(F.lower(F.col(column)), F.lit(rf"(?<![a-z])([a-z]{{{SHORTEST},{LONGEST}}})(?![a-z])"), F.lit(1)))
    counts = docs.select(F.explode(each).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= common)
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(words).collect()]


def coverage(low: str, known: frozenset) -> float:
    """The largest share of a value's characters that different places of dictionary words cover."""
    best = [0] * (len(low) + 1)
    for i in range(1, len(low) + 1):
        best[i] = best[i - 1]
        for k in range(SHORTEST, min(LONGEST, i) + 1):
            if best[i - k] + k > best[i] and low[i - k : i] in known:
                best[i] = best[i - k] + k
    return best[-1] / max(1, len(low))


def _kinds(s: str) -> str:
    return "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in s)


def describe(value: str, kind: int, before: str, after: str, path: str, known: frozenset) -> list[float]:
    """The features of a candidate; ``kind`` is the group of CANDIDATE that it matched."""
    n = len(value)
    kinds = _kinds(value)
    low = value.lower()
    counts = {c: low.count(c) for c in set(low)}
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    words = {w.lower() for w in _WORD.findall(before[-48:])[-4:]}
    next_words = {w.lower() for w in _WORD.findall(after[:48])[:3]}
    files = _FILE.findall(before)
    path = files[-1] if files else path
    vowels, letters = len(_VOWELS.findall(low)), n - kinds.count("d") - kinds.count("o")
    return [
        n, sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        kinds.count("d") / n, kinds.count("u") / n, kinds.count("o") / n, entropy, coverage(low, known),
        float(any(w in low for w in PLACEHOLDER)), float(kind), float(kind == 3), float(bool(words & CREDENTIAL)), float(bool(words & OTHER)), float(bool(next_words & OTHER)),
        float(bool(TESTS.search(path))), float(bool(SETTINGS.search(path))), float(value.startswith(PREFIXES)), float(bool(re.fullmatch(r"[0-9a-f-]+", low))), float(kinds.count("d") == n),
        vowels / max(1, letters), max(map(len, _CONSONANTS.findall(low)), default=0),
    ]


def _families(rng, words: list[str]):
    """Makers of findings by family: (text before, value, text after, is a secret)."""
    pick = lambda chars, n: "".join(rng.choice(list(chars), int(n)))
    between = lambda a, b: int(rng.integers(a, b))
    one = lambda *xs: str(rng.choice(list(xs)))
    hexa, upper, lower = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    alnum = lower + upper + "0123456789"
    word = lambda: str(words[between(0, len(words))]) if words else pick(lower, between(4, 9))
    prose = lambda: " ".join(word() for _ in range(6)) + " "
    name = lambda: one("password", "token", "secret", "api_key", "auth", "DB_PASSWORD", "access-key") + one("=", " = ", ": ", '="', " = \"")
    parts = lambda: [word() for _ in range(between(2, 6))]
    longer = lambda v: v if len(v) >= 16 else v + word() + word() + word() + word()
    return {
        "access key": lambda: (prose(), "AKIA" + pick(upper + "234567", 16), " " + prose(), True),
        "letters only key": lambda: (prose(), one("AKIA", "ghp_", "xoxb-", "") + pick(lower + upper, between(16, 44)), " " + prose(), True),
        "prefixed key": lambda: (prose(), one("ghp_", "xoxb-", "sk_live_", "AIza") + pick(alnum, between(24, 40)), " " + prose(), True),
        "assigned hex": lambda: (prose() + name(), pick(hexa, rng.choice([16, 18, 20, 32, 40])), "\n" + prose(), True),
        "assigned mixed": lambda: (prose() + name(), pick(alnum, between(12, 44)), "\n" + prose(), True),
        "assigned human": lambda: (prose() + name(), word() + one("", "_", "!", "#") + pick("0123456789", between(1, 5)) + one("", word(), "!", word().title()), "\n" + prose(), True),
        "url password": lambda: (prose() + one("postgres", "mysql", "https", "amqp") + "://" + word() + ":", one(pick(alnum, between(8, 24)), word() + pick("0123456789", 2) + word()), "@" + word() + ".example " + prose(), True),
        "private key": lambda: ("-----BEGIN " + one("", "RSA ", "EC ") + "PRIVATE KEY-----", "\n" + "\n".join(pick(alnum + "+/", 64) for _ in range(between(2, 8))) + "\n", "-----END", True),
        "bare mixed": lambda: (prose() + one("bearer ", "key ", "token "), pick(alnum, between(20, 44)), " " + prose(), True),
        "placeholder": lambda: (prose() + name(), one(*sorted(PLACEHOLDER)) + one("", "123", "_here", "-value", "_" + word()) + one(*sorted(PLACEHOLDER)), "\n" + prose(), False),
        "reference": lambda: (prose() + name(), one("os.environ[", "${", "process.env.", "get_", "config.", "self._") + word() + "_" + word() + one("", "]", "}", "()"), "\n" + prose(), False),
        "url placeholder": lambda: (prose() + one("postgres", "https") + "://" + word() + ":", one("password", "changeme", "example", "your_password", "xxxx", "<pass>", "${PASS}"), "@" + word() + ".example " + prose(), False),
        "checksum": lambda: (prose() + one("commit ", "sha256 ", "md5: ", "digest ", "etag ", "revision "), pick(hexa, rng.choice([32, 40, 64])), " " + prose(), False),
        "uuid": lambda: (prose() + one("", "id "), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), " " + prose(), False),
        "number": lambda: (prose(), pick("0123456789", between(16, 22)), " " + prose(), False),
        "long word": lambda: (prose(), longer("".join(word() for _ in range(between(3, 6)))), " " + prose(), False),
        "camel name": lambda: (prose(), longer("".join(w.capitalize() for w in parts())), " " + prose(), False),
        "snake name": lambda: (prose(), longer(one("_", "-").join(parts())), " " + prose(), False),
        "constant": lambda: (prose(), longer("_".join(parts()).upper()), " " + prose(), False),
        "path": lambda: (prose(), longer("/".join(parts())), " " + prose(), False),
    }


FAMILIES = tuple(_families(np.random.default_rng(0), []))


def labelled_findings(words: list[str], count: int = FINDINGS, seed: int = 20, families: tuple[str, ...] = FAMILIES) -> tuple[np.ndarray, np.ndarray]:
    """``count`` labelled findings of the families: features and whether each is a secret.

    Each is found in its text by the same candidate search as in documents.
    """
    rng = np.random.default_rng(seed)
    makers, known = _families(rng, words), frozenset(words)
    rows, labels = [], []
    paths = ["src/main.py", "deploy/prod.env", "config.yml", "tests/test_app.py", "docs/readme.md", "src3", ""]
    while len(rows) < count:
        family = families[len(rows) % len(families)]
        before, value, after, label = makers[family]()
        path = str(rng.choice(paths))
        at = [f for a, z, f in candidates(before + value + after, path, known) if a < len(before) + len(value) and z > len(before)]
        rows.append(at[0] if at else describe(value, 4, before, after, path, known))
        labels.append(label)
    return np.array(rows), np.array(labels)


@dataclass
class Forest:
    trees: list[tuple[np.ndarray, ...]]  # feature (-1: leaf), cut, left, right, value

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                i = np.flatnonzero(inner)
                node = at[i]
                at[i] = np.where(x[i, feature[node]] <= cut[node], left[node], right[node])
            total += value[at]
        return total / len(self.trees)


def _tree(x: np.ndarray, y: np.ndarray, rng) -> tuple[np.ndarray, ...]:
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        me, share = len(nodes), float(y[rows].mean())
        nodes.append([-1, 0.0, 0, 0, share])
        if depth == DEPTH or len(rows) < 2 * LEAF or share in (0.0, 1.0):
            return me
        best = None
        for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5)), replace=False):
            v = x[rows, f]
            for cut in np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1])):
                low = v <= cut
                a = int(low.sum())
                if LEAF <= a <= len(rows) - LEAF:
                    p, q = float(y[rows[low]].mean()), float(y[rows[~low]].mean())
                    gini = a * p * (1 - p) + (len(rows) - a) * q * (1 - q)
                    if best is None or gini < best[0]:
                        best = (gini, f, cut, low)
        if best is None:
            return me
        _, f, cut, low = best
        nodes[me][:2] = [int(f), float(cut)]
        nodes[me][2] = grow(rows[low], depth + 1)
        nodes[me][3] = grow(rows[~low], depth + 1)
        return me

    grow(rng.integers(0, len(y), len(y)), 0)
    cols = list(zip(*nodes, strict=True))
    return np.array(cols[0], np.int64), np.array(cols[1]), np.array(cols[2], np.int64), np.array(cols[3], np.int64), np.array(cols[4])


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 8) -> Forest:
    rng = np.random.default_rng(seed)
    y = y.astype(np.float64)
    return Forest([_tree(x, y, rng) for _ in range(trees)])


def candidates(text: str, path: str, known: frozenset):
    """(start, end, features) of each candidate, in order."""
    for m in CANDIDATE.finditer(text):
        g = m.lastindex
        value = m[g]
        if g == 3:
            value = value.rstrip(".!?)]}*&%$#")
            if len(value) < 6:
                continue
        start = m.start(g)
        yield start, start + len(value), describe(value, g, text[max(0, start - AROUND) : start], text[m.end() : m.end() + AROUND], path, known)


def scan(docs: DataFrame, forest: Forest, words: list[str], level: float = 0.5, key: str = "doc_id", path: str = "source") -> DataFrame:
    """Per row: key, n_candidates, n_secrets, starts, ends and scores (of the secrets, code points)."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((forest, frozenset(words)))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        model, known = held.value
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                found, x = [], []
                for i, (t, p) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    for a, z, f in candidates(t or "", p or "", known):
                        found.append((i, a, z))
                        x.append(f)
                score = model.probability(np.array(x)) if x else np.zeros(0)
                n, s = [0] * part.num_rows, [[] for _ in range(part.num_rows)]
                for (i, a, z), v in zip(found, score, strict=True):
                    n[i] += 1
                    if v >= level:
                        s[i].append((a, z, float(v)))
                longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array([len(r) for r in s], pa.int64()), pa.array([[q[0] for q in r] for r in s], longs), pa.array([[q[1] for q in r] for r in s], longs), pa.array([[q[2] for q in r] for r in s], doubles)],
                    [key, "n_candidates", "n_secrets", "starts", "ends", "scores"],
                )

    rows = docs.select(F.col(key), "text", F.col(path).cast("string").alias("path"))
    return rows.mapInArrow(run, f"`{key}` {kind}, n_candidates long, n_secrets long, starts array<long>, ends array<long>, scores array<double>")
