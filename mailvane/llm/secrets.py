"""Secret scans: character Markov models by log-likelihood ratio, beside three plain patterns.

First-order models over characters.  Secret ones: one for each alphabet of keys, trained
on labelled random samples, and one on the values of the patterns in all documents.  The
ordinary one is trained in equal shares on labelled samples of names as programs have them
(words joined by underscores, hyphens, slashes or capitals, with numbers, and rulers), and on
the other tokens of the same shape in all documents that are words or numbers, not both
mixed (a mixed one is left unlabelled, as it may be a secret).
All tables hold shares, not counts, so a larger corpus of the same kind gives the same
ratios.  A token, or a run of its parts between / and =, whose mean log ratio per step is
high enough under one of the secret models is a secret, too.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailvane.shipping import ship_package

KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

_KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Shorter runs fail anyway, and no run starts inside another.
HEX = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}")
#: Texts without any of these have no base match.
_MAYBE_ASSIGN = re.compile(rf"(?:{_KEYWORD})[\"']?\x20*[:=]")

#: Tokens the models are about: as long as a key, and of a key's characters.
LEAST_TOKEN = 16
TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_TOKEN},}}(?![A-Za-z0-9+/_=-])")
#: Letters and digits side by side.
_MIXED = re.compile(r"[A-Za-z][0-9]|[0-9][A-Za-z]")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SYMBOLS = len(_ALPHABET) + 1  # the last stands for a token's edge
_CODE = np.full(128, SYMBOLS - 1, dtype=np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))
#: Mean log ratio per character from which a token is a secret.
THRESHOLD = 1.0
#: Alphabets of the random samples.
KEY_ALPHABETS = (
    "0123456789abcdef",
    "0123456789ABCDEF",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "abcdefghijklmnopqrstuvwxyz234567",
    _ALPHABET[:62],
    _ALPHABET[:64],
    _ALPHABET[:62] + "_-",
)
SAMPLES, SAMPLE_SIZES = 4000, (16, 64)
#: Words that names are put together from.
NAME_WORDS = (
    "access action active address after alpha array async base batch before block body boolean bucket buffer build bytes cache call char "
    "check child class client close code collect column com command common config connection context convert core count create current "
    "data date debug default delete dev device dir dist document domain double driver enable end engine entry env error event example "
    "exception execute executor export factory field file filter find first flag float format function get global group handler hash head "
    "header hidden host html http id image impl import include index info init input install int interface internal item java job json key "
    "label last lat left length level lib library limit line list load local log long main map master max memory message meta method min "
    "mode model module name native net new next node null number object of open option order org output package page param parent parse "
    "part path pool port prefix private process program project property proxy public python query queue range rate read reader record "
    "ref region register remote render report request reset resource response result return right root row run sample save schema scope "
    "script search select send server service session set setting share size socket sort source spark src stack start state static status "
    "step store stream string style sub sum system table tag target task temp test text thread time timeout to token tool top total "
    "transform tree type unit update upper url user utils valid value var vector version view wait web width window word worker write"
).split()
NAMES = 40_000
#: Share of every transition that comes from single characters, and of these from all alike.
BACKOFF, EVEN = 0.05, 0.1
#: Where a token may be cut.
_CUT = re.compile(r"[/=]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the pattern matches, in code points, by start and then kind."""
    found = []
    if _MAYBE_ASSIGN.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _steps(token: str) -> np.ndarray:
    """Numbers of the pairs of neighbouring characters, edges included."""
    codes = _CODE[np.frombuffer(token.encode("ascii"), dtype=np.uint8)]
    edged = np.concatenate(([SYMBOLS - 1], codes, [SYMBOLS - 1]))
    return edged[:-1] * SYMBOLS + edged[1:]


def _merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, apart and in order."""
    starts: list[int] = []
    ends: list[int] = []
    for start, _, end in spans:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _free_parts(covered: tuple[list[int], list[int]], start: int, end: int) -> list[tuple[int, int]]:
    """What is left of a stretch of text outside the covered parts."""
    starts, ends = covered
    out = []
    for i in range(bisect_right(ends, start), len(starts)):
        if starts[i] >= end:
            break
        out.append((start, starts[i]))
        start = ends[i]
    return [(lo, hi) for lo, hi in [*out, (start, end)] if lo < hi]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each partition and class: how often each pair of characters occurs."""
    counts = np.zeros((2, SYMBOLS * SYMBOLS), dtype=np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            spans = base_spans(text)
            covered = _merged(spans)
            for start, kind, end in spans:
                value = ASSIGN.match(text, start).group(2) if kind == 0 else text[start:end]
                counts[1] += np.bincount(_steps(re.sub(r"[^A-Za-z0-9+/_=-]", "", value)), minlength=SYMBOLS**2)
            for m in TOKEN.finditer(text):
                if not _MIXED.search(m.group()) and _free_parts(covered, m.start(), m.end()) == [m.span()]:
                    counts[0] += np.bincount(_steps(m.group()), minlength=SYMBOLS**2)
    label, step = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(step.astype(np.int32)), pa.array(counts[label, step])], ["label", "step", "n"])


def _conditional(counts: np.ndarray) -> np.ndarray:
    """Transition table of pair counts; only their proportions matter.

    ``BACKOFF`` of every transition, and all of it after a character never seen, goes by
    how often the next character occurs at all.
    """
    pairs = counts.reshape(SYMBOLS, SYMBOLS)
    all_pairs, after = pairs.sum(), pairs.sum(axis=1, keepdims=True)
    single = np.full(SYMBOLS, 1 / SYMBOLS)
    if all_pairs:
        single = (1 - EVEN) * pairs.sum(axis=0) / all_pairs + EVEN * single
    share = np.divide(pairs, after, out=np.tile(single, (SYMBOLS, 1)), where=after > 0)
    return (1 - BACKOFF) * share + BACKOFF * single


def random_samples() -> np.ndarray:
    """Pair counts of random strings, one row for each of ``KEY_ALPHABETS``; always the same."""
    rnd = np.random.default_rng(5)
    counts = np.zeros((len(KEY_ALPHABETS), SYMBOLS * SYMBOLS))
    for k, alphabet in enumerate(KEY_ALPHABETS):
        codes = np.array([_ALPHABET.index(c) for c in alphabet])
        for n in rnd.integers(SAMPLE_SIZES[0], SAMPLE_SIZES[1], size=SAMPLES, endpoint=True):
            edged = np.concatenate(([SYMBOLS - 1], codes[rnd.integers(0, len(codes), size=n)], [SYMBOLS - 1]))
            np.add.at(counts[k], edged[:-1] * SYMBOLS + edged[1:], 1)
    return counts


def name_samples() -> np.ndarray:
    """Pair counts of names made of ``NAME_WORDS``; always the same."""
    rnd = np.random.default_rng(7)
    counts = np.zeros(SYMBOLS * SYMBOLS)
    number = lambda: str(rnd.integers(0, 10 ** rnd.integers(1, 4)))
    for _ in range(NAMES):
        words = [NAME_WORDS[i] for i in rnd.integers(0, len(NAME_WORDS), size=rnd.integers(3, 8))]
        style = rnd.integers(0, 7)
        if rnd.random() < 0.3:
            at = rnd.integers(0, len(words))
            words[at] += number()
        if style == 0:
            name = "_".join(words)
        elif style == 1:
            name = "_".join(words).upper()
        elif style == 2:
            name = "-".join(words)
        elif style == 3:
            name = "/" * (rnd.random() < 0.5) + "/".join(words)
        elif style == 4:
            name = words[0] + "".join(w.capitalize() for w in words[1:])
        elif style == 5:
            name = "".join(w.capitalize() for w in words)
        else:
            name = "-_=/+"[rnd.integers(0, 5)] * rnd.integers(LEAST_TOKEN, 60)
        counts += np.bincount(_steps(name), minlength=SYMBOLS**2)
    return counts


def _any_case(counts: np.ndarray) -> np.ndarray:
    """Pair counts with as much again of the same tokens in capitals, which need not occur themselves."""
    capital = np.array([*(_ALPHABET.index(c.upper()) for c in _ALPHABET), SYMBOLS - 1])
    pairs = counts.reshape(SYMBOLS, SYMBOLS)
    out = pairs.astype(float)
    np.add.at(out, (capital[:, None], capital[None, :]), pairs)
    return out.ravel()


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log ratio of every pair of characters, one row for each secret model, against ordinary.

    The values of the patterns make a last row; half of it are the random samples, so a
    few values alone do not decide.
    """
    ship_package()
    counted = docs.select(F.col(text_col)).mapInArrow(_count, "label int, step int, n long").groupBy("label", "step").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, SYMBOLS * SYMBOLS))
    for r in counted.collect():  # at most 2 x 68 x 68 rows
        counts[r["label"], r["step"]] = r["n"]
    return ratios(counts)


def ratios(counts: np.ndarray) -> np.ndarray:
    """The rows of :func:`train` from the pair counts of ordinary tokens (0) and pattern values (1)."""
    keys = random_samples()
    secret = [_conditional(k) for k in keys]
    if counts[1].any():
        pooled = keys.sum(axis=0)
        secret.append(_conditional(counts[1] / counts[1].sum() + pooled / pooled.sum()))
    names = name_samples()
    ordinary = names / names.sum()
    if counts[0].any():
        ordinary = ordinary + _any_case(counts[0]) / _any_case(counts[0]).sum()
    return np.array([(np.log(s) - np.log(_conditional(ordinary))).ravel() for s in secret])


def secret_runs(token: str, ratio: np.ndarray) -> list[tuple[int, int]]:
    """``(start, end)`` of the secrets within a token, by start.

    A token is a secret as a whole when its mean ratio reaches the threshold under one
    model.  Otherwise a run of neighbouring parts between / and = may be one, if long
    enough: that which exceeds the threshold by the largest sum is taken, then what is
    left and right of it is searched.
    """
    steps = _steps(token)
    cuts = [m.span() for m in _CUT.finditer(token)]
    starts = np.array([0, *(e for _, e in cuts)])
    ends = np.array([*(s for s, _ in cuts), len(token)])
    before, after = np.empty((len(ratio), len(starts))), np.empty((len(ratio), len(ends)))
    for k, model in enumerate(ratio):  # the sums before the step into a part, and with the step out of it
        sums = np.concatenate(([0.0], np.cumsum(model[steps] - THRESHOLD)))
        if sums[-1] >= 0:
            return [(0, len(token))]
        before[k], after[k] = sums[starts], sums[ends + 1]
    found: list[tuple[int, int]] = []
    todo = [(0, len(starts))]
    while todo:
        first, last = todo.pop()
        # of each end, the last start that leaves room for a token
        room = np.searchsorted(starts[first:last], ends[first:last] - LEAST_TOKEN, side="right") - 1
        long = np.flatnonzero(room >= 0)
        if not len(long):
            continue
        least = np.minimum.accumulate(before[:, first:last], axis=1)
        score = after[:, first + long] - least[:, room[long]]
        k, j = np.unravel_index(score.argmax(), score.shape)
        if score[k, j] >= 0:
            i = first + int(before[k, first : first + room[long[j]] + 1].argmin())
            j = first + int(long[j])
            found.append((int(starts[i]), int(ends[j])))
            todo += [(first, i), (j + 1, last)]
    return sorted(found)


def all_spans(text: str, ratio: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: base ones, and what the models find in the rest of every token.

    A token is judged without what base spans cover; a part of it that is left counts if
    it is long enough to be a token.
    """
    base = base_spans(text)
    covered = _merged(base)
    extra = [
        (low + start, 3, low + end)
        for m in TOKEN.finditer(text)
        for left, high in _free_parts(covered, m.start(), m.end())
        for low in [left if left == m.start() else high - len(text[left:high].lstrip("/="))]
        if high - low >= LEAST_TOKEN
        for start, end in secret_runs(text[low:high], ratio)
    ]
    return base, sorted(base + extra)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its matches; a null text is empty, repeated rows give equal rows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = all_spans(text or "", ratio)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            columns = list(zip(*rows)) or [()] * 5
            kinds_of = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds_of))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            )

    ship_package()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(find, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def secret_report(docs: DataFrame) -> DataFrame:
    """The query's rows: models trained on all documents, then every document scanned.

    Null and empty texts have no spans; long ones are scanned whole.  Repeated rows give
    equal rows and null ids stay null.  An empty table gives no rows; its models are those of
    the samples.  Other columns are not read.  A string of digits alone is no secret, as
    far as the models go.
    """
    return scan(docs, train(docs))


REDACTED = "[SECRET]"


def redacted(text: str, ratio: np.ndarray) -> str:
    out, at = [], 0
    for start, _, end in all_spans(text, ratio)[1]:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], REDACTED]
        at = end
    return "".join(out) + text[at:] if out else text


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every secret replaced by ``REDACTED`` and its length put right; other columns unchanged.

    Null texts stay null, and nothing but text and length is changed: repeated rows, null
    ids and columns of any name come back as they are.  An empty table stays empty.
    """
    ratio = train(docs.select(text_col), text_col)
    at, names = docs.columns.index(text_col), docs.columns
    size_at = names.index(length_col) if length_col in names else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            old = columns[at].to_pylist()
            new = [None if t is None else redacted(t, ratio) for t in old]
            columns[at] = pa.array(new, columns[at].type)
            if size_at is not None:
                sizes = columns[size_at].to_pylist()
                columns[size_at] = pa.array([n if a == b else len(b) for n, a, b in zip(sizes, old, new)], columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, numbers)

    ship_package()
    # Arrow functions look columns up by name, which fails for some names: numbers on the way
    numbers = [f"c{i}" for i in range(len(names))]
    plain = docs.toDF(*numbers)
    return plain.mapInArrow(clean, plain.schema).toDF(*names)
