r"""Personal data (operator 6): expressions propose, checksums confirm, context adjusts; DataFrame functions only.

Kinds: email; ip (parts at most 255); card (12 to 19 digits, Luhn); phone (9 to 15 digits); and, beyond these base kinds, iban
(mod 97) and ssn. A span's score starts at its kind's prior, gains where a checksum holds, and gains where a word of its kind stands in the 40
characters before it. Spans with a score of at least 0.5 are kept: base kinds start there, an iban's checksum
lifts it there, and an ssn needs its context.

The expressions are written so that Java scans a text once, without backtracking over long runs: a match can only start where
a run starts, so look-aheads and look-behinds reject the other places, and repetition is possessive where what follows cannot be in the run.
A text without a sign that its kind needs is not searched for it. Places come from the lengths of the parts between matches, counted in code points, which only a
text with matches is cut into; they are summed in blocks of about the square root of their number, and what stands before a match comes along. A row needs no other row: there is no shuffle.

Results that the cases have: null and empty texts have no spans, and the digest of the empty string; a null id is an ordinary row; rows that repeat
have the same result; extra columns are ignored; an empty table gives an empty result. Texts are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, text_of

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?=[A-Z][A-Z][0-9])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)(?![A-Za-z0-9])"
SSN = r"(?=[0-9]{3}-)(?<![A-Za-z0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"
NEAR = 40
#: (kind, expression, text that a match must hold, prior, gain by checksum, context words), in order of kinds.
KINDS = (
    ("email", EMAIL, "@", 0.8, 0.0, ("mail", "contact", "write to", "address")),
    ("ip", IP, ".", 0.5, 0.1, ("ip", "server", "host", "address")),
    ("card", CARD, None, 0.3, 0.4, ("card", "visa", "credit", "payment", "account")),
    ("phone", PHONE, "+", 0.5, 0.0, ("phone", "call", "tel", "mobile", "fax")),
    ("iban", IBAN, None, 0.1, 0.6, ("iban", "bank", "account", "transfer")),
    ("ssn", SSN, "-", 0.3, 0.0, ("ssn", "social security", "tax id")),
)
BASE = ("email", "ip", "card", "phone")
GAIN = 0.2
KEEP = 0.5


MATCH = "array<struct<start:int,value:string,near:string>>"


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, expression: str, needs: str | None = None) -> Column:
    """An array of (start, text, the NEAR characters before it) of the leftmost non-overlapping matches; starts count code points."""
    none = F.array().cast(MATCH)

    def placed(found: Column) -> Column:
        return F.when(F.size(found) > 0, bound(F.arrays_zip(F.slice(F.split(text, expression, -1), 1, F.size(found)).alias("gap"), found.alias("value")), starts)).otherwise(none)

    out = bound(F.regexp_extract_all(text, F.lit(expression), F.lit(0)), placed)
    return F.when(F.contains(text, F.lit(needs)), out).otherwise(none) if needs else out


def starts(pairs: Column) -> Column:
    """(gap, value) one after another -> (start, value, near). A block of matches is gathered at a time, so that no long array is copied for each match."""
    width = F.ceil(F.sqrt(F.size(pairs))).cast("int")

    def state(at: Column, tail: Column, out: Column) -> Column:
        return F.struct(at.alias("at"), tail.alias("tail"), out.alias("out"))

    def one(s: Column, x: Column) -> Column:
        start, near = s["at"] + F.length(x["gap"]), F.right(F.concat(s["tail"], x["gap"]), F.lit(NEAR))
        match = F.struct(start.alias("start"), x["value"].alias("value"), near.alias("near"))
        return state(start + F.length(x["value"]), F.right(F.concat(near, x["value"]), F.lit(NEAR)), F.array_append(s["out"], match))

    def block(s: Column, b: Column) -> Column:
        rows = F.slice(pairs, b * width + 1, width)
        return bound(F.aggregate(rows, state(s["at"], s["tail"], F.array().cast(MATCH)), one), lambda r: state(r["at"], r["tail"], F.array_append(s["out"], r["out"])))

    blocks = F.sequence(F.lit(0), F.ceil(F.size(pairs) / width).cast("int") - 1)
    return F.flatten(F.aggregate(blocks, state(F.lit(0), F.lit(""), F.array().cast(f"array<{MATCH}>")), block)["out"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Every second digit from the right doubled, digits of the products added: a multiple of 10."""
    of = F.split(F.reverse(digits(value)), "")

    def term(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(of, term), F.lit(0), lambda s, x: s + x) % 10 == 0


def mod97(value: Column) -> Column:
    """The first four characters moved to the end, letters as 10 to 35: 1 modulo 97."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))

    def step(state: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (state * 100 + code - 55) % 97).otherwise((state * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def valid(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("0"), p), F.lit(4)).cast("int") <= 255))
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    if kind == "iban":
        return mod97(value)
    return F.lit(True)


def kind_spans(text: Column, nth: int, kind: str, expression: str, needs: str | None, prior: float, gain: float, words: tuple[str, ...]) -> Column:
    checked = F.filter(matches(text, expression, needs), lambda m: valid(kind, m["value"]))
    context = F.lit(r"(?<![a-z])(?:" + "|".join(words) + ")")

    def span(m: Column) -> Column:
        score = F.round(F.lit(prior + gain) + F.when(F.regexp_like(F.lower(m["near"]), context), GAIN).otherwise(0.0), 2)
        return F.struct(m["start"].alias("start"), F.lit(nth).alias("nth"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["value"])).alias("end"), score.alias("score"))

    spans = F.transform(checked, span)
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= KEEP)


def spans_of(text: Column) -> Column:
    """An array of (start, nth kind, kind, end, score) in order of start and kind; failing matches and low scores are left out."""
    return F.sort_array(F.concat(*(kind_spans(text, nth, *kind) for nth, kind in enumerate(KINDS))))


def of_kind(spans: Column, nth: int) -> Column:
    return F.filter(spans, lambda s: s["nth"] == nth)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (id_col, spans array<struct<start, nth, kind, end, score>>)."""
    rows = docs.select(col(id_col).alias(id_col), text_of(docs, text_col).alias("_text"))
    return rows.select(col(id_col), spans_of(F.col("_text")).alias("spans"))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    found = pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["nth"] < len(BASE))
    counts = [F.size(of_kind(F.col("spans"), k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql_kind(kind: str, nth: int, pattern: str, keep: str) -> str:
    return rf"""
SELECT doc_id, {nth} AS nth, '{kind}' AS kind, start, start + len(v) AS stop FROM (
  SELECT doc_id, v, CAST(list_sum(list_transform(g[:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[:i-1], lambda x: len(x))), 0) AS BIGINT) AS start, text
  FROM (SELECT doc_id, text, g, m, unnest(m) AS v, generate_subscripts(m, 1) AS i FROM (
    SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM d)))
WHERE {keep}"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = (
    f"len({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda k: "
    f"CASE WHEN k % 2 = 1 THEN CAST({_DIGITS}[-k] AS INT) WHEN CAST({_DIGITS}[-k] AS INT) > 4 THEN 2 * CAST({_DIGITS}[-k] AS INT) - 9 ELSE 2 * CAST({_DIGITS}[-k] AS INT) END)) % 10 = 0"
)
OP6_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ("
    + " UNION ALL ".join(
        (
            _sql_kind("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
            _sql_kind("ip", 1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(v, '.'), lambda p: CAST(p AS HUGEINT))) <= 255"),
            _sql_kind("card", 2, r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
            _sql_kind("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 9 AND 15"),
            _sql_kind(
                "iban", 4, r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b",
                "list_reduce(list_prepend(0, list_transform(string_split(concat(v[5:], v[:4]), ''), lambda c: CAST(ascii(c) AS INT))), "
                "lambda a, c: CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END) = 1",
            ),
            _sql_kind(
                "ssn", 5, r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", r"regexp_matches(lower(text[greatest(start - 39, 1) : start]), '\b(ssn|social security|tax id)')"
            ),
        )
    )
    + r"""), l AS (
  SELECT doc_id, count(*) FILTER (nth = 0) AS e, count(*) FILTER (nth = 1) AS i, count(*) FILTER (nth = 2) AS c, count(*) FILTER (nth = 3) AS p,
    string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, nth) FILTER (nth < 4) AS base,
    string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, nth) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN l ON d.doc_id = l.doc_id
"""
)
