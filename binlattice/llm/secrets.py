"""Secret scans: fixed patterns, and character Markov models for what they miss.

First-order character models are trained from labelled samples: of random
strings, one for each usual alphabet, and of ordinary identifiers. A token outside
the pattern matches is a secret where the log-likelihood ratio of its
transitions, the likeliest random model over the ordinary one, reaches ``ratio``
on average and ``evidence`` in sum. A token is scored whole, and if it fails, in
its parts between separators, so a key behind a long path isn't averaged with
the path. Tokens without letters are numbers and not scored.

Samples: the values that a pattern matched anywhere in the corpus are random
strings of the narrowest alphabet that holds them; all other tokens of at least
``MIN_ORDINARY`` characters and at most two digits are ordinary, so that a missed
secret isn't learned as such. Their transitions are counted over all documents,
whole texts, and summed in one aggregate whose size is fixed. As the corpus may
hold no secrets, or of one kind only, each model mixes the corpus's transition
shares with those of seeded random strings, or of identifiers joined from common
words; the corpus's weight grows with its transitions, up to one half.

Defined cases: null and empty texts hold no spans; rows that repeat a doc_id, or
have none, are scanned each for itself and count in training as often as they
occur; spans that begin together are listed in the order of kinds; texts of any
length are scanned whole, in time linear in their tokens and spans; no documents
give no rows; a corpus without samples of a class leaves the built-in ones;
other columns may have any names and are not returned.
"""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
THREE_DIGITS = re.compile(r"[0-9][^0-9]*[0-9][^0-9]*[0-9]")
LETTER = re.compile(r"[A-Za-z]")
SEPARATOR = re.compile(r"[/_=-]+")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
CODE = np.zeros(256, dtype=np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
RATIO, EVIDENCE, MIN_CHARS, MIN_ORDINARY, FILL = 0.4, 9.0, 12, 8, 400
SIZE, MIX = len(ALPHABET) + 1, 20_000
SETS = (string.hexdigits[:16], string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, ALPHABET)
ORDINARY = len(SETS)


def tokens_of(least: int) -> re.Pattern:
    return re.compile(f"[A-Za-z0-9+/_=-]{{{least},}}")


PLAIN = tokens_of(MIN_ORDINARY)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in code points; failing matches are dropped after matching."""
    spans = []
    low = text.lower().encode("utf-8", "replace")
    if any(w in low for w in WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def codes(token: str) -> np.ndarray:
    return CODE[np.frombuffer(token.encode(), dtype=np.uint8)]


def transitions(tokens: list[str]) -> np.ndarray:
    """How often each character follows each; row 0 stands for a token's start."""
    c = CODE[np.frombuffer("\n".join(["", *tokens]).encode(), dtype=np.uint8)]
    n = np.bincount(c[:-1] * SIZE + c[1:], minlength=SIZE * SIZE).reshape(SIZE, SIZE)
    n[:, 0] = 0
    return n


def shares(n: np.ndarray, smoothing: float = 0.5) -> np.ndarray:
    p = n[:, 1:] + smoothing
    return p / p.sum(axis=1, keepdims=True)


def train(counts: dict[int, np.ndarray]) -> np.ndarray:
    """Log-likelihood ratios by transition and random model, from counts by label."""
    p = []
    for label, tokens in enumerate(built_in()):
        base, own = shares(transitions(tokens)), counts.get(label)
        w = 0.0 if own is None else 0.5 * own.sum() / (own.sum() + MIX)
        p.append(base if own is None else (1 - w) * base + w * shares(own))
    ratios = np.stack([np.log(x) - np.log(p[ORDINARY]) for x in p[:ORDINARY]], axis=2)
    return np.pad(ratios, ((0, 0), (1, 0), (0, 0)))


def llr(table: np.ndarray, token: str) -> float:
    """The log-likelihood ratio of a token's transitions, in sum: the best random model's, less the choice among them."""
    c = codes(token)
    return float(table[np.concatenate([[0], c[:-1]]), c].sum(axis=0).max() - np.log(ORDINARY))


def built_in(count: int = FILL, seed: int = 7) -> list[list[str]]:
    """Seeded random strings over each alphabet, and identifiers joined from common words."""
    rng = random.Random(seed)
    names = "get set user name list index count value page file path data load store update remove request response handler manager config default test number table column order total".split()
    out = [["".join(rng.choices(a, k=rng.randint(20, 48))) for _ in range(count)] for a in SETS]
    plain = []
    for i in range(count):
        parts = rng.choices(names, k=rng.randint(2, 5))
        plain.append(rng.choice(("_", "-", "/")).join(parts) if i % 2 else parts[0] + "".join(p.title() for p in parts[1:]))
    return [*out, plain]


def alphabet(token: str) -> int:
    """The narrowest alphabet that holds a token."""
    return next(k for k, a in enumerate(SETS) if not token.strip(a))


def outside(text: str, spans: list[tuple[int, int, int]], pattern: re.Pattern):
    """(start, end) of the pattern's tokens that meet no span."""
    at, reach = 0, -1
    for m in pattern.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= m.start():
            yield m.start(), m.end()


def value(text: str, kind: int, start: int, end: int) -> str:
    """The secret itself: an assignment's value, or the whole match."""
    own = ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]
    return "".join(c for c in own if c in ALPHABET)


def samples(text: str) -> list[tuple[int, str]]:
    """(label, token): values that a pattern matched, by alphabet, and ordinary tokens."""
    spans = base_spans(text)
    plain = (text[a:b] for a, b in outside(text, spans, PLAIN))
    return [(alphabet(v), v) for a, k, b in spans if (v := value(text, k, a, b))] + [(ORDINARY, t) for t in plain if not THREE_DIGITS.search(t)]


def counted(docs: DataFrame) -> dict[int, np.ndarray]:
    """Transition counts by label over all documents."""

    def run(batches):
        total = np.zeros((ORDINARY + 1, SIZE, SIZE), dtype=np.int64)
        for batch in batches:
            held: dict[int, list[str]] = {}
            for text in batch.column(0).to_pylist():
                for label, token in samples(text):
                    held.setdefault(label, []).append(token)
            for label, tokens in held.items():
                total[label] += transitions(tokens)
        label, a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (label, a, b)] + [pa.array(total[label, a, b])], ["label", "a", "b", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(run, "label int, a int, b int, n long")
    out: dict[int, np.ndarray] = {}
    for r in rows.groupBy("label", "a", "b").agg(F.sum("n").alias("n")).collect():  # the size of the models at most
        out.setdefault(r.label, np.zeros((SIZE, SIZE), dtype=np.int64))[r.a, r.b] = r.n
    return out


def model_spans(text: str, start: int, end: int, table: np.ndarray, ratio: float, evidence: float, least: int) -> list[tuple[int, int, int]]:
    """A token, or those of its parts, that look random."""
    random_ = lambda a, b: LETTER.search(text, a, b) and (s := llr(table, text[a:b])) >= evidence and s >= ratio * (b - a)
    if random_(start, end):
        return [(start, 3, end)]
    cuts = [(m.start(), m.end()) for m in SEPARATOR.finditer(text, start, end)]
    if not cuts:
        return []
    parts = zip([start, *(b for _, b in cuts)], [*(a for a, _ in cuts), end], strict=True)
    return [(a, 3, b) for a, b in parts if b - a >= least and random_(a, b)]


def text_spans(text: str, table: np.ndarray, ratio: float = RATIO, evidence: float = EVIDENCE, least: int = MIN_CHARS) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base and model spans together."""
    base = base_spans(text)
    more = [s for a, b in outside(text, base, tokens_of(least)) for s in model_spans(text, a, b, table, ratio, evidence, least)]
    return base, sorted(base + more) if more else base


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, *, ratio: float = RATIO, evidence: float = EVIDENCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    table = train(counted(docs))

    def run(batches):
        for batch in batches:
            counts: list[list[int]] = []
            sums, every = [], []
            for text in batch.column(1).to_pylist():
                base, both = text_spans(text or "", table, ratio, evidence, min_chars)
                counts.append([sum(k == i for _, k, _ in both) for i in range(4)])
                sums.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every.append(joined(both))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(sums, pa.string()), pa.array(every, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"],
            )

    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return body.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")
