r"""Secret scans (operator 2): expressions and a battery of randomness tests under false-discovery control.

Base kinds, each leftmost and non-overlapping: assign (a password-like name, a separator and a value of 8 or more characters),
access (an access key id of 16 or more characters) and hex (32 or more lowercase hexadecimal digits).

The method adds spans of kind `random`: runs of 20 or more characters of [A-Za-z0-9+/_-] that touch no base span; `=` belongs to a run
only as padding at its end, so that the value of NAME=value is a run. A run that has no encoding, or is not random in it, gives way to
its parts of 20 or more characters between / and +, between _ and -, or between all four, if it has such; of overlapping random
parts the one with the least p-value counts. For each run or part the encoding is inferred as the smallest alphabet that holds it (digits, hex, HEX, letters of one case, base32, letters, letters and digits, base64).
Three tests of the run in that encoding follow, each in both directions: how unlikely its statistic is if symbols are independent and
uniform, and how unlikely it is that ordinary text looks as random by it.

- chi-squared: counts of symbols against uniformity (symbols binned so that a bin expects five or more); against ordinary text, the
  statistic of the letters' counts, case aside, is too small for letters that are as frequent as there (normal approximation).
- runs: above and below the alphabet's middle (Wald-Wolfowitz); against ordinary text, the runs of one character class (lower, upper, digit; joiners and
  the step from a capital to a small letter do not count) are too many, by the binomial tail of changes of class, exact at every length.
- serial: correlation of neighbours at lag one; against ordinary text, the likelihood of the pairs of neighbouring letters under PAIRS over that
  under independent uniform letters: under ordinary text the inverse exceeds 1/p with a probability of p at most.

The battery gives one p-value: 1 if a test rejects uniformity at ALPHA / 3, else the least of the three p-values against ordinary text, each divided by its
share (SHARES, which sum to one). Benjamini-Hochberg takes it, over all runs of the text, at level FDR with weights in proportion to length (mean weight
one), so that short runs need more evidence. Digits alone have no evidence against ordinary text in any test: a long random number cannot be told from an account
or serial number; from 32 digits on they are of kind hex. A UUID is an identifier, not a secret, and is passed over on purpose. A text is its own family: the
decision needs no other row.

Results that the cases have: null and empty texts have no spans and the digest of the empty string; null ids are ordinary rows; rows
that repeat have the same result; extra columns are ignored; an empty table gives an empty result. Texts are searched whole.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, text_of

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{14,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?")
LEAST = 20
#: Parts of a run between joiners; padding stays with the last one.
PARTS = tuple(re.compile(rf"[A-Za-z0-9{c}=]{{{LEAST},}}") for c in ("_\\-", "+/", ""))
KINDS = ("assign", "access", "hex", "random")
ALPHA = 0.001
FDR = 0.01
#: The rate at which ordinary text of letters, digits and joiners changes character class between neighbours, with a margin.
CHANGES = 0.12
#: The shares of the error that the chi-squared test, the runs test and the serial test may use.
SHARES = (0.05, 0.85, 0.1)
UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
#: For each letter a row of how much rarer than 1/26 each letter follows it in ordinary text, in steps of 1/4 of the natural logarithm
#: from c = 0 (base 36), with a tenth of uniform letters: half from English Python modules, half from prose in four languages (sf0.01).
PAIRS = (
    "geabfjgjaji9c7hej8889hijil bjgi4kklccl6jk6hldgjblllbl akikbkl45lddjk7klfhbfkllil bhjf2jih8llekh6klfefdljkil ahdcdeiibkj9f6fgh69aehieif "
    "9hggaahi6ljcjj5hl9ebajklij 6gik3lgbalidibeilc9edhjlli 6egl3lhdalhejfahkedaghhlkh ehaf8cekikkcd59gjea7kgljlh 1ljl7lllililllbillhkdlllll "
    "djih1igibllekeiikhbjikclil 7jif49kl8kl7jkbjljdeekllbl 7fki3ill7lkheja9liejfljlkl 9fb88h8gcjhegf9gheb6fgiljj ffdbhchlbjiec5fej79c8hfill "
    "5lih89lhalkakk8cl9gaekkldl lllllllllllklklklkkl0lllll 7geg4jegakhgfb9ikabbfhilfj ch9h5kgbahjgdjcehfb5cljlgl 9hhi6jk57ljhjjbik9ebcjilfd "
    "dfgj4fijelkbd7edi9cajil8lk 7kkl2kll5lllkkbllkkkklklll 8kkgakl44llgkdckladklljlll 8c6d7clkalleelcbfdi6lflggl effi9jkeclldeab6la76jielkk "
    "becg6lfichgeekchgffd3gllkg"
)
#: (name, symbols in order) of the encodings, smallest first.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("digits", DIGITS), ("hex", DIGITS + "abcdef"), ("HEX", DIGITS + "ABCDEF"), ("lower", LOWER), ("upper", UPPER), ("base32", UPPER + "234567"), ("letters", UPPER + LOWER),
    ("base36", DIGITS + LOWER), ("BASE36", DIGITS + UPPER), ("base62", UPPER + LOWER + DIGITS), ("base64", UPPER + LOWER + DIGITS + "+/"), ("base64url", UPPER + LOWER + DIGITS + "-_"),
)


def normal_tail(z: float) -> float:
    """Two-sided tail of the standard normal distribution."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared with k degrees of freedom, by the cube-root normal approximation."""
    if k < 1:
        return 1.0
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def binomial_tail(n: int, q: float, least: int) -> float:
    """P(Binomial(n, q) >= least), term by term from the first, each from the one before it."""
    if least <= n * q:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(least + 1) - math.lgamma(n - least + 1) + least * math.log(q) + (n - least) * math.log1p(-q)
    term = total = 1.0  # over the first term; they fall, as least is above the mean
    for k in range(least, n):
        term *= (n - k) / (k + 1) * q / (1 - q)
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, math.exp(log) * total)


def inferred(run: str) -> tuple[str, str] | None:
    """The smallest encoding that holds the run, padding aside; None if none does."""
    body = set(run.rstrip("="))
    return next(((name, symbols) for name, symbols in ENCODINGS if body and body <= set(symbols)), None)


def uniform_tests(run: str, symbols: str) -> tuple[float, float, float]:
    """P-values of the three tests under uniform independent symbols."""
    place = {c: k for k, c in enumerate(symbols)}
    x = np.array([place[c] for c in run.rstrip("=")], float)
    n, size = len(x), len(symbols)
    bins = max(2, min(size, n // 5))
    edge = np.floor(np.arange(size) * bins / size).astype(int)
    expected = np.bincount(edge, minlength=bins) * n / size
    chi = float((((np.bincount(edge[x.astype(int)], minlength=bins)) - expected) ** 2 / expected).sum())
    high = x >= size / 2
    ups = int(high.sum())
    downs = n - ups
    if ups and downs:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * ups * downs / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    d = x - (size - 1) / 2
    serial = float((d[1:] * d[:-1]).sum()) / ((size * size - 1) / 12 * math.sqrt(n - 1))
    return chi_tail(chi, bins - 1), p_runs, normal_tail(serial)


def kind_of(c: str) -> int:
    return 0 if c in LOWER else 1 if c in UPPER else 2 if c in DIGITS else 3


def letter_evidence() -> np.ndarray:
    """Logarithm of the likelihood of each letter after each one in ordinary text over 1/26."""
    x = np.exp(np.array([[12 - int(c, 36) for c in row] for row in PAIRS.split()]) / 4)
    return np.log(x / x.sum(axis=1, keepdims=True) * 26)


def letter_shares() -> np.ndarray:
    """How frequent each letter is in ordinary text: what the pairs leave as it is."""
    share = np.full(26, 1 / 26)
    for _ in range(50):
        share = share @ (np.exp(LETTERS) / 26)
    return share / share.sum()


LETTERS = letter_evidence()
SHARE = letter_shares()


def ordinary_tests(run: str) -> tuple[float, float, float]:
    """P-values of the three tests under ordinary text: how unlikely it is to look as random as the run."""
    x = np.frombuffer(run.lower().encode(), np.uint8).astype(int) - 97
    letter = (x >= 0) & (x < 26)
    counts, n = np.bincount(x[letter], minlength=26), int(letter.sum())
    p_chi = 1.0
    if n > 1:
        # the statistic is 26 / n times the sum of squares, less n; mean and variance of that sum under the ordinary shares
        two, three = float((SHARE**2).sum()), float((SHARE**3).sum())
        pairs = n * (n - 1)
        mean, var = pairs * two, 2 * pairs * two + 4 * pairs * (n - 2) * three - 2 * pairs * (2 * n - 3) * two * two
        p_chi = 0.5 * math.erfc(-(float((counts * (counts - 1)).sum()) - mean) / math.sqrt(2 * var))
    kinds = [kind_of(c) for c in run]
    changes = sum(a != b and 3 not in (a, b) and (a, b) != (1, 0) for a, b in zip(kinds, kinds[1:], strict=False))
    both = letter[:-1] & letter[1:]
    p_serial = math.exp(min(0.0, float(LETTERS[x[:-1][both], x[1:][both]].sum())))
    return p_chi, binomial_tail(len(run) - 1, CHANGES, changes), p_serial


def battery(run: str, symbols: str) -> float | None:
    """The one p-value of the battery against ordinary text; None if a test rejects uniform symbols of the encoding."""
    if min(uniform_tests(run, symbols)) < ALPHA / 3:
        return None
    return min(1.0, *(p / share for p, share in zip(ordinary_tests(run), SHARES, strict=True)))


def tested(run: str) -> list[tuple[int, int, str, float | None]]:
    """(start, end, encoding, p-value or None) of the run, or of its parts if it is not random and has any."""
    if UUID.fullmatch(run):
        return []
    code = inferred(run)
    p = battery(run, code[1]) if code else None
    if p is not None:
        return [(0, len(run), code[0], p)]
    out = []
    for s, e in sorted({m.span() for part in PARTS for m in part.finditer(run)} - {(0, len(run))}):
        code = inferred(run[s:e])
        out.append((s, e, code[0] if code else "", battery(run[s:e], code[1]) if code else None))
    return out or [(0, len(run), "", None)]


def random_runs(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str, float]]:
    """(start, end, encoding, adjusted p) of the text's random runs outside the spans taken."""
    found, taken, at = [], sorted(taken), 0
    reach = 0  # the furthest end of the spans that start before the run's end
    for m in RUN.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if m.start() < reach or m.end() - m.start() < LEAST:
            continue
        found += [(m.start() + s, m.start() + e, code, p) for s, e, code, p in tested(m.group())]
    if not found:
        return []
    # weighted Benjamini-Hochberg: p over weight, weights in proportion to length
    length = np.array([e - s for s, e, *_ in found], float)
    p = np.minimum(1.0, np.array([1.0 if f[3] is None else f[3] for f in found]) * length.mean() / length)
    order = np.argsort(p, kind="stable")
    adjusted = np.empty(len(p))
    adjusted[order] = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out, least = [], sorted((float(q), s, -e, code) for (s, e, code, raw), q in zip(found, adjusted, strict=True) if raw is not None and q <= FDR)
    for q, s, e, code in least:
        near = bisect.bisect(out, (s,))
        if (near == 0 or out[near - 1][1] <= s) and (near == len(out) or out[near][0] >= -e):
            out.insert(near, (s, -e, code, q))
    return out


def scan(text: str) -> list[tuple[int, int, int, str, float]]:
    """(start, nth kind, end, encoding, adjusted p) of all spans, in order of start and kind."""
    spans = []
    low = text.lower() if not text.isascii() else text.casefold()
    if any(n in low for n in NAMES):
        spans += [(m.start(), 0, m.end(), "", 0.0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), "", 0.0) for m in ACCESS.finditer(text) if len(m.group()) >= 16]
    spans += [(m.start(), 2, m.end(), "hex", 0.0) for m in HEX.finditer(text)]
    taken = [(s, e) for s, _, e, *_ in spans]
    spans += [(s, 3, e, code, q) for s, e, code, q in random_runs(text, taken)]
    return sorted(spans)


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


def scanned(batches):
    for batch in batches:
        spans = [scan(t.as_py()) for t in batch["_text"]]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("encoding", pa.string()), ("q_value", pa.float64())]))
        rows = [[{"start": s, "kind": KINDS[k], "end": e, "encoding": c, "q_value": q} for s, k, e, c, q in x] for x in spans]
        yield pa.RecordBatch.from_pydict({"_id": batch["_id"], "spans": pa.array(rows, kind)})


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (id_col, spans array<struct<start, kind, end, encoding, q_value>>), in code points. No shuffle."""
    rows = docs.select(col(id_col).alias("_id"), text_of(docs, text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(scanned, f"_id {kind}, spans array<struct<start:bigint,kind:string,end:bigint,encoding:string,q_value:double>>")
    return out.select(F.col("_id").alias(id_col), "spans")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count("random").alias("n_random"),
    )
