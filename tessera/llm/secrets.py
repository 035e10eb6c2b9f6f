"""Secret scans: candidate strings, and a random forest that takes false positives out.

Candidates are long runs of key characters with a digit in them, and values that are assigned to a name. The forest
judges a candidate by its length, its character transitions, how much of it dictionary words cover, the path of its
document and the words around it. It is trained from the small table of ``labelled_findings``, made by a rule.

Candidates are found in a map over whole documents; only they go on, and the forest is applied where they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import texts, with_row_id

_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_ASSIGNED = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?[\"']?[ \t]{0,4}[:=]{1,2}[ \t]{0,4}[\"']?([^\s\"',;]{6,})")
_WORD = re.compile(r"[A-Za-z]+")

SECRET_WORDS = frozenset("token secret password passwd pwd key apikey api auth bearer credential credentials private access".split())
HASH_WORDS = frozenset("sha sha1 sha256 md5 commit checksum hash digest uuid guid id revision etag fingerprint build version blob".split())
FAKE_WORDS = frozenset("example dummy sample test fake placeholder your changeme todo xxx mock insert here none null".split())
FAKE_PATHS = ("test", "example", "sample", "mock", "fixture", "doc", "spec")
KEY_PATHS = (".env", ".pem", "config", "credential", "secret", ".properties", ".yml", ".yaml")
#: Words that a random string hardly holds.
DICTIONARY = frozenset(
    "about access account after again also application background base before between build button cache change check class client code collection "
    "color column command config container content context control count create current data database date default delete description directory "
    "document domain element error event example field file filter first font format from function group handler have header height hello home "
    "image import index info input install instance integer interface internal item label language last layout length level library license like "
    "line link list load local login main manager map margin message method model module more name network node number object option order other "
    "page param parent password path pattern person placeholder plugin position prefix print process product project property public query "
    "read record remote report request resource response result return right root sample save schema score search secret section select server "
    "service session setting shared simple size source stack start state static status string style submit success system table target template "
    "test text that there this time title token type update upload user value variable vector version view where width window with word world your".split()
)

NAMES = (
    "length", "digits", "upper", "symbols", "entropy", "hex", "class_changes", "longest_run", "distinct", "vowel_changes", "steps", "covered",
    "fake_path", "key_path", "secret_before", "hash_before", "fake_near", "assigned", "quoted", "fake_inside", "groups",
)


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def covered_share(value: str) -> float:
    """Share of the characters that dictionary words cover, longest first at each place."""
    low, at, n = value.lower(), 0, 0
    while at < len(low):
        size = next((k for k in range(min(12, len(low) - at), 3, -1) if low[at : at + k] in DICTIONARY), 0)
        n += size
        at += size or 1
    return n / max(1, len(low))


def features(value: str, before: str, after: str, path: str) -> list[float]:
    """In the order of NAMES. before, after: the characters around the value."""
    n = len(value)
    kinds = [_class(c) for c in value]
    counts = Counter(value)
    m = len(value)
    run = longest = 1
    for a, b in zip(value, value[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    low = value.lower()
    letters = [c for c in low if c.isalpha()]
    vowels = [c in "aeiou" for c in letters]
    near = [w.lower() for w in _WORD.findall(before)[-4:]]
    around = near + [w.lower() for w in _WORD.findall(after)[:2]]
    path = path.lower()
    return [float(x) for x in (
        min(n, 1000), kinds.count(0) / m, kinds.count(2) / m, kinds.count(3) / m,
        -sum(k / m * math.log2(k / m) for k in counts.values()),
        bool(re.fullmatch(r"[0-9a-fA-F]+", value)),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / m,
        longest, len(counts),
        sum(a != b for a, b in zip(vowels, vowels[1:], strict=False)) / max(1, len(vowels)),
        sum(abs(ord(b) - ord(a)) <= 1 for a, b in zip(low, low[1:], strict=False)) / m,
        covered_share(value),
        any(x in path for x in FAKE_PATHS), any(x in path for x in KEY_PATHS),
        any(w in SECRET_WORDS for w in near), any(w in HASH_WORDS for w in near), any(w in FAKE_WORDS for w in around),
        bool(re.search(r"[:=][ \t]*[\"']?$", before)), before[-1:] in ("'", '"'),
        any(w in low for w in ("example", "dummy", "your", "xxx", "changeme", "test", "sample", "1234567")),
        value.count("-") + value.count("_"),
    )]


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) in code points, in order, without overlaps. An assigned value stays whole; of a run that overlaps it or
    its name, what lies before and after stays, where that is a candidate by itself."""
    assigned = list(_ASSIGNED.finditer(text))
    out, k = [m.span(1) for m in assigned], 0
    for m in _RUN.finditer(text):
        at, end = m.span()
        while k < len(assigned) and assigned[k].end() <= at:
            k += 1
        parts, j = [], k
        while j < len(assigned) and assigned[j].start() < end:
            parts.append((at, assigned[j].start()))
            at = max(at, assigned[j].end(1))
            j += 1
        parts.append((at, end))
        out += [(s, e) for s, e in parts if e - s >= 16 and any("0" <= c <= "9" for c in text[s:e])]
    return sorted(out)


# --- labelled findings --------------------------------------------------------------------------------------------------


def labelled_findings(number: int = 1600, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """(value, before, after, path, label) by a fixed rule; half are secrets."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    chars = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = sorted(DICTIONARY)
    filler = lambda: " ".join(chars("aeionrstlhd", rng.integers(2, 9)) for _ in range(rng.integers(1, 4)))
    out = []
    for i in range(number):
        path = pick("src7", "src12", "app/main.py", "lib/client.js", "deploy/.env", "config/app.yml", "notes.md", "")
        if i % 2:
            value = pick(chars(hexa, 40), chars(hexa, 32), chars(hexa, 64), chars(hexa.upper(), 40), chars(alnum, 24), chars(alnum, 40), chars(alnum + "+/", 40), "AKIA" + chars(alnum.upper(), 16), "ghp_" + chars(alnum, 36), "sk_live_" + chars(alnum, 24), chars(alnum + "!#%", 12))
            cue = pick("token", "secret", "password", "api_key", "API_KEY", "access_key", "auth_token", "TOKEN", "private key")
            before = f"{filler()} {cue}" + pick(' = "', ' = "', "=", ": ", ' : "', "='", " = ")
            out.append((value, before, pick('" ', '"', "\n", " ") + filler(), path, 1))
        else:
            kind = rng.integers(0, 8)
            value, before = chars(hexa, pick(32, 40, 64)), f"{filler()} {pick('commit', 'sha256', 'md5', 'checksum', 'revision', 'digest', 'build')}" + pick(" ", ": ", " = ", ":")
            if kind == 1:
                value, before = "-".join(chars(hexa, k) for k in (8, 4, 4, 4, 12)), f"{filler()} {pick('uuid', 'id', 'guid')}" + pick(" ", ": ", '="')
            elif kind == 2:
                value, before = pick("_", "-", "").join([pick(*words) for _ in range(rng.integers(2, 5))] + [chars("0123456789", rng.integers(1, 4))]), filler() + pick(" ", " = ", ": ")
            elif kind == 3:
                value, before = pick("your_api_key_here1", "changeme123456789", "xxxxxxxxxxxxxxxxxxx1", "example_token_0000", "dummy-secret-12345", "1234567890abcdef", "test_password_123", "placeholder1234567"), f"{filler()} {pick('token', 'password', 'api_key', 'secret')}" + pick(' = "', "=", ": ")
            elif kind == 4:
                value, before = chars("0123456789", rng.integers(16, 25)), filler() + pick(" ", " number ", ": ")
            elif kind == 5:
                value, before, path = chars(alnum, 24), f"example {pick('token', 'key')}" + pick(" = ", ": "), pick("tests/test_auth.py", "docs/example.md", "fixtures/mock.json")
            elif kind == 6:
                value, before = chars("0", 8) + chars(pick("0", "a", "f1"), rng.integers(12, 40)), f"{filler()} {pick('token', 'key', 'hash')} = "
            elif kind == 7:
                value, before = "/".join(pick(*words) for _ in range(rng.integers(3, 6))) + chars("0123456789", 2), filler() + pick(" ", " /", ": ")
            out.append((value, before, pick('"', " ", "\n") + filler(), path, 0))
    return out


def fit(spark: SparkSession, findings: list[tuple[str, str, str, str, int]] | None = None, trees: int = 20, depth: int = 7) -> RandomForestClassificationModel:
    rows = [(features(*x[:4]), float(x[4])) for x in (labelled_findings() if findings is None else findings)]
    table = spark.createDataFrame(rows, "features array<double>, label double").coalesce(1)
    table = table.select(array_to_vector("features").alias("features"), "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt").fit(table)


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """One row for each candidate: rid, doc_id, start, end (code points), value, probability, secret.

    Null and empty texts have no candidates; a null path is empty; repeated rows each have their own. Further columns are
    not looked at."""
    model = fit(docs.sparkSession) if model is None else model

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, end, value, numbers = [], [], [], [], []
            paths = b.column(3).to_pylist()
            for i, raw in enumerate(texts(b.column(2))):
                text = raw.decode("utf-8", "replace")
                for s, e in candidates(text):
                    row.append(i)
                    start.append(s)
                    end.append(e)
                    value.append(text[s:e])
                    numbers.append(features(text[s:e], text[max(0, s - 60) : s], text[e : e + 40], paths[i] or ""))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(value, pa.string()), pa.array(numbers, pa.list_(pa.float64()))], names=["rid", "doc_id", "start", "end", "value", "numbers"])

    rows = with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(path_col).cast("string").alias("path"))).select("rid", "doc_id", "text", "path")
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(out, f"rid long, doc_id {kind}, start long, end long, value string, numbers array<double>")
    judged = model.setFeaturesCol("features").transform(found.withColumn("features", array_to_vector("numbers")))
    probability = F.round(F.get(vector_to_array("probability"), 1), 6)
    return judged.select("rid", "doc_id", "start", "end", "value", probability.alias("probability"), (probability >= threshold).alias("secret"))
