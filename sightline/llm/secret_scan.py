"""Secret scans: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

import random
import re
import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import Words, sampled, sliced, utf8

_NAME = r"(?i:token|secret|passw(?:or)?d|passphrase|pwd|key|auth|credentials?)[A-Za-z0-9_.\-]{0,40}+[\"'`\])]{0,2}"
#: What a candidate is; the group of each pattern, or else the whole match. Runs of characters that keys are made of; dotted tokens; values that are
#: assigned to names of secrets, given to options of such names or sent as credentials, whatever their length or characters; private-key blocks.
CANDIDATES = [
    re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}={0,2}"),
    re.compile(r"(?<![A-Za-z0-9_.\-])[A-Za-z0-9_\-]{4,}+(?:\.[A-Za-z0-9_\-]{4,}+)+"),
    re.compile(_NAME + r"[ \t]{0,4}(?::=|=>|={1,3}|:)[ \t]{0,4}(?=[\"'`])(?:\"((?:\\.|[^\"\\\n])++)\"|'((?:\\.|[^'\\\n])++)'|`((?:\\.|[^`\\\n])++)`|[\"'`]([^\s\"'`]++))"),
    re.compile(_NAME + r"[ \t]{0,4}(?::=|=>|={1,3}|:)[ \t]{0,4}([^\s\"'`=:]\S*+(?<![,;]))"),
    re.compile(r"--?(?i:[a-z\-]{0,20}(?:token|secret|passw(?:or)?d|passphrase|pwd|key|auth))[ \t]{1,4}[\"'`]?([^\s\"'`\-]\S*+(?<![\"'`,;]))"),
    re.compile(r"(?i:bearer|basic)[ \t]{1,4}([A-Za-z0-9_.~+/\-]{6,}+=*+)"),
    re.compile(r"://[^\s:/@]{0,64}:([^\s/@]{1,256})@"),
    re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?)-----(?P<all>)(?:(?:[^-]|-(?!----))*+-----END \1-----|(?:\s{0,4}[A-Za-z0-9+/=]{16,}+)*+)"),
]
#: Without one of these in lower case a text has no match of the pattern.
_STEMS = ("token", "secret", "passw", "passphrase", "pwd", "key", "auth", "credential")
NEEDLES = [("",), (".",), _STEMS, _STEMS, _STEMS, ("bearer", "basic"), ("://",), ("-----begin",)]
AROUND = 48
MASK = "[SECRET]"
#: Findings that a forest is fitted on, at most.
FINDINGS = 20_000
_LEFT_PATH = re.compile(r"(?:[/\\.]|https?:|www\.|@)$|https?://\S*$")
_LETTERS = re.compile(r"[A-Za-z]+")
#: Buckets of hashed words; a word is one of the dictionary if its bucket holds KNOWN times the mean bucket's words, and three at least.
BITS, KNOWN = 18, 4.0
_APART = np.array([not (chr(i).isalpha() if i < 128 else True) for i in range(256)])
_STEP = np.where((np.arange(256) >= 32) & (np.arange(256) < 127), np.arange(256) - 31, 0)
STEPS = 96
#: Documents that example words are taken from, at most, and how many of them.
EXAMPLES, LEXICON = 300, 2000
FEATURES = 19


@dataclass
class Background:
    """What a corpus is made of: its dictionary (by hashed words), the log chance of each character after another one, and some common words."""

    known: np.ndarray
    steps: np.ndarray
    lexicon: list[str]


def background(docs: DataFrame) -> Background:
    """Counted over all whole texts. Null texts hold nothing; without any word the dictionary is empty. Sums meet in a shuffle, not on the driver."""

    def count(batches):
        words, steps = np.zeros(1 << BITS, np.int64), np.zeros(STEPS * STEPS, np.int64)
        for batch in sliced(batches):
            data, offsets = utf8(batch.column("text"))
            own = Words(data, offsets, lower=True, gaps=_APART)
            words += np.bincount((own.hash >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
            at = _STEP[data]
            pair = at[:-1] * STEPS + at[1:]
            inner = np.ones(len(pair), bool)
            inner[(offsets[1:-1] - 1)[(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]] = False
            steps += np.bincount(pair[inner], minlength=STEPS * STEPS)
        for kind, found in ((0, words), (1, steps)):
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(at), kind, np.int32)), "at": pa.array(at.astype(np.int32)), "n": pa.array(found[at])})

    sums = docs.select("text").mapInArrow(count, "kind int, at int, n bigint").groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()
    words, steps = np.zeros(1 << BITS), np.zeros(STEPS * STEPS)
    kind, at, n = (sums.column(c).to_numpy() for c in ("kind", "at", "n"))
    words[at[kind == 0]], steps[at[kind == 1]] = n[kind == 0], n[kind == 1]
    steps = steps.reshape(STEPS, STEPS) + 0.5
    known = (words >= 3) & (words >= KNOWN * words.mean())
    some = [r.text or "" for r in sampled(docs.select("doc_id", "text"), "doc_id", EXAMPLES, "examples").select("text").collect()]
    counts = Counter(w for t in some for w in _LETTERS.findall(t.lower()) if len(w) > 1)
    common = sorted(counts, key=lambda w: (-counts[w], w))[:LEXICON]
    return Background(known, np.log(steps / steps.sum(axis=1, keepdims=True)), common or ["one", "two", "three"])


@dataclass
class Tables:
    """For words in four places around a finding, the log of their odds among secrets, as labelled findings have it: 0 for words that say nothing."""

    odds: list[dict[str, float]]

    @staticmethod
    def places(before: str, found: str, after: str) -> tuple[list[str], ...]:
        """The nearest word before it, the other near ones, the words in it, and the nearest one after it."""
        near = _LETTERS.findall(before[-AROUND:].lower())
        return near[-1:], near[-6:-1], [w for w in _LETTERS.findall(found.lower()) if len(w) > 2], _LETTERS.findall(after[:AROUND].lower())[:1]

    @classmethod
    def learn(cls, findings: list[tuple[str, str, str, int]], least: int = 5) -> Tables:
        bad, all_ = [Counter() for _ in range(4)], [Counter() for _ in range(4)]
        for before, found, after, label in findings:
            for k, words in enumerate(cls.places(before, found, after)):
                all_[k].update(set(words))
                bad[k].update(set(words) if label else ())
        share = (sum(f[3] for f in findings) + 1) / (len(findings) + 2)
        base = np.log(share / (1 - share))
        return cls([{w: float(np.log((b[w] + 1) / (n - b[w] + 1)) - base) for w, n in a.items() if n >= least} for a, b in zip(all_, bad)])

    def of(self, before: str, found: str, after: str) -> list[float]:
        return [max((t.get(w, 0.0) for w in words), key=abs, default=0.0) for t, words in zip(self.odds, self.places(before, found, after))]


def features(findings: list[tuple[str, str, str]], usual: Background, tables: Tables) -> np.ndarray:
    """Length, character transitions, dictionary coverage, path and neighbouring words of each candidate (before, found, after)."""
    if not findings:
        return np.zeros((0, FEATURES))
    column = pa.array([f[1] for f in findings], pa.string())
    data, offsets = utf8(column)
    size = np.maximum(np.diff(offsets), 1)
    words = Words(data, offsets, lower=True, gaps=_APART)
    long = words.last - words.first
    covered = np.bincount(words.doc, long * (usual.known[(words.hash >> np.uint64(64 - BITS)).astype(np.int64)] & (long > 2)), len(findings)) / size
    at = _STEP[data]
    total = np.concatenate([[0.0, 0.0], np.cumsum(usual.steps[at[:-1], at[1:]])])
    usualness = (total[offsets[1:]] - total[offsets[:-1] + 1]) / np.maximum(size - 1, 1)
    rows = []
    for i, (before, found, after) in enumerate(findings):
        n = len(found)
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in found]
        share = {k: kinds.count(k) / n for k in "dulo"}
        counts = np.array([found.count(c) for c in set(found)]) / n
        steps = [abs(ord(b) - ord(a)) for a, b in zip(found, found[1:])]
        rows.append([
            n,
            sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
            usualness[i],
            sum(s <= 1 for s in steps) / max(1, len(steps)),
            share["d"],
            share["u"],
            share["l"],
            share["o"] - (found.count("-") + found.count("_") + found.count("/") + found.count(" ")) / n,
            float(-(counts * np.log2(counts)).sum()),
            sum(c in "0123456789abcdefABCDEF" for c in found) / n,
            covered[i],
            float(found.count("/")),
            float(found.count("-") + found.count("_")),
            float(bool(_LEFT_PATH.search(before)) or after[:1] in (".", "/", "@")),
            float(bool(re.search(r"[=:]\s*[\"'`]?$", before))) + 2.0 * (before[-1:] in ('"', "'", "`")) + 4.0 * (found[0] in "$%<{[("),
            *tables.of(before, found, after),
        ])
    return np.array(rows)


@dataclass
class Forest:
    """Complete binary trees in arrays; a leaf holds the share of secrets among its findings."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    depth: int
    usual: Background | None = None
    tables: Tables | None = None

    def judge(self, findings: list[tuple[str, str, str]]) -> np.ndarray:
        return self.score(features(findings, self.usual, self.tables))

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, at, rows = np.arange(len(self.leaf)), np.zeros((len(x), len(self.leaf)), np.int64), np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.cut[trees, at])
        return self.leaf[trees, at - (2**self.depth - 1)].mean(axis=1)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 6, tried: int = 4, least: int = 3, seed: int = 11) -> Forest:
    """Each tree sees a bootstrap of the findings, each split a few features; the split with the least Gini impurity is taken."""
    rng, inner = np.random.default_rng(seed), 2**depth - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        rows = rng.integers(0, len(x), len(x))
        node = np.zeros(len(x), np.int64)
        value = np.full(2 * inner + 1, y.mean())
        for i in range(inner):
            mine = np.flatnonzero(node == i)
            own = y[rows[mine]]
            if len(mine):
                value[i] = own.mean()
            if len(mine) >= 2 * least and 0 < own.sum() < len(own):
                best = (np.inf, 0, np.inf)
                for j in rng.choice(x.shape[1], tried, replace=False):
                    order = np.argsort(x[rows[mine], j], kind="stable")
                    v, hits = x[rows[mine][order], j], np.cumsum(own[order])
                    n = np.arange(1, len(v))
                    left, right = hits[:-1], hits[-1] - hits[:-1]
                    impurity = left * (1 - left / n) + right * (1 - right / (len(v) - n))
                    impurity[(v[1:] == v[:-1]) | (n < least) | (len(v) - n < least)] = np.inf
                    k = int(impurity.argmin())
                    if impurity[k] < best[0]:
                        best = (impurity[k], j, (v[k] + v[k + 1]) / 2)
                feature[t, i], cut[t, i] = best[1:]
            value[2 * i + 1 : 2 * i + 3] = value[i]
            node[mine] = 2 * i + 1 + (x[rows[mine], feature[t, i]] > cut[t, i])
        at = node - inner
        n = np.bincount(at, minlength=inner + 1)
        leaf[t] = np.where(n > 0, np.bincount(at, y[rows], inner + 1) / np.maximum(n, 1), value[inner:])
    return Forest(feature, cut, leaf, depth)


def labelled_findings(spark: SparkSession, words: list[str], n: int = 3000, seed: int = 5) -> DataFrame:
    """Findings labelled by the rule that made them: before, found, after, label. Secrets are random keys that are assigned, sent or named as such;
    the rest are digests, ids, paths, addresses and placeholders; `words` of the corpus stand around and in them. Which words tell of a secret is
    learned from the findings, so a table of reviewed findings can take their place where there is one."""
    rng = random.Random(seed)
    pick = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    digit = lambda s: s[:-1] + rng.choice(string.digits)
    hexes, mixed = "0123456789abcdef", string.ascii_letters + string.digits
    word = lambda: rng.choice(words)
    rows = []
    for i in range(n):
        lead, tail = " ".join(word() for _ in range(rng.randint(0, 6))), " ".join(word() for _ in range(rng.randint(0, 6)))
        key = digit(rng.choice([pick(hexes, rng.choice([32, 40, 64])), pick(mixed, rng.randint(20, 64)), pick(mixed + "+/", rng.choice([40, 44])), "AKIA" + pick(string.ascii_uppercase + string.digits, 16), "ghp_" + pick(mixed, 36), "sk-" + pick(mixed, 40)]))
        quote = rng.choice(['"', "'", "", "`"])
        if i % 2:
            name = rng.choice(["token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "SECRET_KEY", "private_key", "passwd"])
            name = rng.choice([name, name.upper(), f"{word()}_{name}"])
            sign = rng.choice([" = ", "=", ": ", ":", " := ", '": '])
            before = rng.choice([f"{name}{sign}{quote}"] * 4 + ["Authorization: Bearer ", f"--{name} "])
            rows.append((f"{lead} {before}", key, f"{quote} {tail}", 1))
            continue
        case = rng.randrange(8)
        if case == 0:
            row = rng.choice(["commit ", "sha1 ", "md5: ", "checksum = ", "sha256:", "revision ", "etag: ", "digest=", "blob "]), digit(pick(hexes, rng.choice([32, 40, 64]))), ""
        elif case == 1:
            u = pick(hexes, 32)
            row = rng.choice(["uuid = ", "id: ", "request id ", "trace_id=", ""]), f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{digit(u[20:])}", ""
        elif case == 2:
            row = rng.choice(["see https://www.example.com/", "open /", "in ./"]), "/".join([word() for _ in range(4)] + ["part" + pick(string.digits, 3), "index"]), ".html"
        elif case == 3:
            row = rng.choice(["token = ", "password: ", "api_key=", "secret = "]), rng.choice(["your_token_here_12345", "example-secret-key-000", "changeme_password_1234", "replace-this-value-123", "test_token_test_token1", "dummy_api_key_value_01"]), ""
        elif case == 4:
            row = f"{word()}.", f"{word()}{word()}{word()}{word()}{pick(string.digits, 2)}", "@mail.example.com"
        elif case == 5:
            row = " ", f"{word()}-{word()}-{word()}-{word()}-{rng.randint(1, 2030)}", ""
        elif case == 6:
            # Codes that nothing near calls a secret.
            row = rng.choice(["parcel ", "ticket ", "serial ", f"{word()} "]), digit(pick(rng.choice([string.ascii_uppercase + string.digits, mixed]), rng.randint(16, 24))), ""
        else:
            row = rng.choice([" ", "call ", "order ", "isbn "]), pick(string.digits, rng.randint(16, 20)), ""
        rows.append((f"{lead} {row[0]}", row[1], f"{row[2]} {tail}", 0))
    signs = "!@#$%^&*.:~?+"
    for i in range(n):
        lead, tail = " ".join(word() for _ in range(rng.randint(0, 6))), " ".join(word() for _ in range(rng.randint(0, 6)))
        name = rng.choice(["password", "secret", "passwd", "passphrase", "pwd", "api_key", "client_secret", "access_token", "credential", "private_key", "DB_PASSWORD"])
        sign, quote = rng.choice([" = ", "=", ": ", ":", " := "]), rng.choice(['"', "'", "", "`"])
        if i % 2:
            case = rng.randrange(7)
            dotted = "eyJ" + pick(mixed, rng.randint(12, 30)) + "." + pick(mixed + "-_", rng.randint(20, 80)) + "." + pick(mixed + "-_", rng.randint(20, 43))
            if case == 0:
                row = f"{name}{sign}{quote}", pick(mixed + signs, rng.randint(5, 20)), quote
            elif case == 1:
                row = f"{name}{sign}{quote}", pick(string.ascii_letters, rng.randint(5, 40)), quote
            elif case == 2:
                row = f'{name}{sign}"', " ".join(word() for _ in range(rng.randint(3, 6))), '"'
            elif case == 3:
                row = f"{name}{sign}{quote}", word() + rng.choice(["", pick(string.digits, rng.randint(1, 4)), pick(signs, 1)]), quote
            elif case == 4:
                row = rng.choice([f"{name}{sign}{quote}", "Authorization: Bearer ", "token = ", "jwt ", " "]), dotted, quote
            elif case == 5:
                kind, body = rng.choice(["RSA ", "EC ", "OPENSSH ", ""]), "\n".join(pick(mixed + "+/", 64) for _ in range(rng.randint(2, 12)))
                row = "", f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----", ""
            else:
                row = rng.choice([("Authorization: Bearer ", pick(string.ascii_letters, rng.randint(16, 48)), ""), (f"postgres://{word()}:", pick(mixed + "!$.~", rng.randint(4, 20)), "@db"), ("--password ", pick(mixed + signs, rng.randint(5, 16)), ""), ("token = '", pick(string.ascii_letters, rng.randint(16, 40)), "'")])
            rows.append((f"{lead} {row[0]}", row[1], f"{row[2]} {tail}", 1))
            continue
        case = rng.randrange(7)
        if case == 6:
            # Variables of templates and shells, whatever their names.
            row = f"{name}{rng.choice([': ', ' = ', '='])}{quote}", rng.choice(["${%s}", "$%s", "{{%s}}", "<%s>", "%%(%s)s", "{%s}"]) % rng.choice([f"{word()}_{name}_{word()}".upper(), f"{word()}_{name}", f"{word()}-{word()}-{name}", f"{word()}_{word()}".upper()]), quote
        elif case == 0:
            row = " ", "".join(word() for _ in range(8))[: rng.randint(16, 40)], ""
        elif case == 1:
            row = rng.choice(["import ", "in ", "https://", "see www.", " "]), ".".join(rng.choice([word(), word().title(), f"{word()}_{word()}", f"{word()}-{word()}"]) + "ahen" for _ in range(rng.randint(2, 5))), rng.choice(["", "/", "("])
        elif case == 2:
            row = f"{name}{rng.choice([': ', ' = ', '='])}", rng.choice(["none", "null", "None", "true", "required", "string", "str", "the", "must", "your", "this", "os.environ", "self.value", "getpass()", "${PASSWORD}", "$SECRET", "<password>", "{{secret}}", "%s", "input()"]), ""
        elif case == 3:
            row = rng.choice(["key: ", "Key: ", "token: ", "tokens: ", "keyboard: ", "monkey: ", "author: ", "keys = ", "authors: ", "token = "]), word(), rng.choice(["", ",", "."])
        elif case == 4:
            row = rng.choice([" ", "in ", "./", "call "]), rng.choice(["/", "_", "-"]).join(word() for _ in range(rng.randint(4, 7))) + "ahen", ""
        else:
            row = rng.choice(["\n", " "]), rng.choice("-_+/") * rng.randint(16, 80), ""
        rows.append((f"{lead} {row[0]}", row[1], f"{row[2]} {tail}", 0))
    return spark.createDataFrame(rows, "before string, found string, after string, label int")


def train(findings: DataFrame, usual: Background, bound: int = FINDINGS) -> Forest:
    """Fit on labelled findings: before, found, after, label. The smallest `bound` by hash are taken if there are more. Findings without text or
    label are left out; without any finding nothing is a secret."""
    named = findings.where("length(found) > 0 and label is not null").select(F.coalesce("before", F.lit("")).alias("before"), "found", F.coalesce("after", F.lit("")).alias("after"), F.col("label").cast("int").alias("label"))
    chosen = [tuple(r) for r in named.orderBy(F.xxhash64("before", "found", "after", "label"), "before", "found", "after").limit(bound).collect()]
    if not chosen:
        return Forest(np.zeros((1, 1), int), np.full((1, 1), np.inf), np.zeros((1, 2)), 1, usual, Tables([{}, {}, {}, {}]))
    tables = Tables.learn(chosen)
    forest = grow(features([c[:3] for c in chosen], usual, tables), np.array([c[3] for c in chosen], float))
    forest.usual, forest.tables = usual, tables
    return forest


def fit(docs: DataFrame) -> Forest:
    """A forest for a corpus: dictionary and transitions from all of it, findings made by rule."""
    usual = background(docs)
    return train(labelled_findings(docs.sparkSession, usual.lexicon), usual)


def candidates(text: str) -> list[tuple[int, int]]:
    """Start and end of each distinct candidate. One can lie in another: a key in a longer value that may not be a secret as a whole."""
    lower, found = text.lower(), set()
    for pattern, needles in zip(CANDIDATES, NEEDLES):
        if any(x in lower for x in needles):
            whole = "all" in pattern.groupindex or not pattern.groups
            found.update(m.span(0 if whole else m.lastindex) for m in pattern.finditer(text))
    return sorted(found)


def find(texts: list[str | None], forest: Forest) -> list[list[tuple[int, int, float]]]:
    """Candidates of each whole text: start, end, score."""
    spans = [candidates(t) if t else [] for t in texts]
    found = [(t[max(0, a - AROUND) : a], t[a:b], t[b : b + AROUND]) for t, s in zip(texts, spans) for a, b in s]
    scores = iter(forest.judge(found).tolist() if found else [])
    return [[(a, b, next(scores)) for a, b in s] for s in spans]


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """Candidates in every whole text: doc_id, start, end (code points), finding, score, is_secret (score from `threshold` on).

    A key that is not as in CANDIDATES is not seen: one of under 16 characters, or with other characters, that no name or option tells of.
    Null and empty texts hold none. Repeated rows give repeated findings. Ids are of any type, null or not. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def scanned(batches):
        for batch in sliced(batches):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows = [(i, a, b, t[a:b], s) for i, t, found in zip(ids, texts, find(texts, held.value)) for a, b, s in found]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (batch.column("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "end", "finding", "score"])

    found = docs.select("doc_id", "text").mapInArrow(scanned, f"doc_id {kind.simpleString()}, start bigint, end bigint, finding string, score double")
    return found.withColumn("is_secret", F.col("score") >= threshold)


def redact(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """All documents and columns, each secret in `text` replaced by MASK; `n_chars`, if it is there as a number, is the new text's length.

    Null and empty texts, and other columns whatever their names, stay as they are; repeated rows stay repeated.
    """
    names, counted = docs.columns, "n_chars" in docs.columns and docs.schema["n_chars"].dataType.typeName() in ("integer", "long")
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def cleaned(batches):
        for batch in sliced(batches):
            texts, changed = batch.column("text").to_pylist(), {}
            for i, found in enumerate(find(texts, held.value)):
                secrets: list[tuple[int, int]] = []
                for a, b in ((a, b) for a, b, s in found if s >= threshold):
                    if secrets and a < secrets[-1][1]:
                        a, b = secrets[-1][0], max(b, secrets.pop()[1])
                    secrets.append((a, b))
                if secrets:
                    edges = [0, *(x for span in secrets for x in span), len(texts[i])]
                    changed[i] = MASK.join(texts[i][a:b] for a, b in zip(edges[::2], edges[1::2]))
            if changed:
                columns = dict(zip(names, batch.columns))
                columns["text"] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], pa.string())
                if counted:
                    columns["n_chars"] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(columns["n_chars"].to_pylist())], columns["n_chars"].type)
                batch = pa.RecordBatch.from_arrays(list(columns.values()), names)
            yield batch

    return docs.mapInArrow(cleaned, docs.schema)
