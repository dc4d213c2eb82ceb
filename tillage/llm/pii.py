"""Personal data (operator 9), by DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod 97 for account numbers, ranges and digit counts for
the others), and words shortly before or behind a span raise its score, which is part of the result. The patterns are written so that no text can make them slow: a run of characters is
entered at its beginning only and never given back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import id_and_text, let

BLOCK = 256  # lengths are summed in blocks, so that the positions of many matches in one text stay cheap
CONTEXT = 40
SPAN = "array<struct<start:int,end:int,score:double>>"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    weigh = lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))
    return _sum(F.transform(F.split(F.reverse(digits), ""), weigh)) % 10 == 0


def mod97(account: Column) -> Column:
    """Does an account number (two letters, two check digits, rest) pass the mod-97 check?"""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """One kind of personal data: a pattern, what must occur for it to match at all, a validator, score and context words."""

    name: str
    pattern: str
    hint: str
    valid: Callable[[Column], Column]
    score: float
    context: str

    @property
    def raised(self) -> float:
        return round(min(1.0, self.score + 0.2), 2)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


# A mail address may begin where the one before ended (\G), else only where a run of its characters begins.
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.7, "mail|contact|write"),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]",
        lambda m: m.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])?(?:\.(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])?)){3}$"),
        0.5, "ip|host|server|address|login",
    ),
    # Shorter digit runs cannot hold 16 digits, so the pattern asks for them at once; the maximal run is the same.
    Kind(
        "card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){15,}+", r"[0-9](?:[ -]?[0-9]){15}",
        lambda m: let(_digits(m), lambda d: F.length(d).between(16, 19) & luhn(d)), 0.8, "card|visa|credit|pay",
    ),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", lambda m: F.length(_digits(m)).between(8, 15), 0.6, "phone|call|tel|mobile|fax"),
)
MORE = (
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}", mod97, 0.9, "iban|account|bank",
    ),
)


# Matches have four characters at least, so this many of them fill the context on either side.
NEIGHBOURS = CONTEXT // 4


def _before(between: Column, found: Column, i: Column) -> Column:
    """The ``CONTEXT`` characters before match ``i``, earlier matches included: only pieces that can reach into them are joined."""
    first, n = F.greatest(i - NEIGHBOURS, F.lit(0)) + 1, F.least(i, F.lit(NEIGHBOURS))
    pieces = F.zip_with(F.slice(between, first, n), F.slice(found, first, n), lambda gap, m: F.concat(F.right(gap, F.lit(CONTEXT)), m))
    return F.right(F.concat(F.array_join(pieces, ""), F.right(between[i], F.lit(CONTEXT))), F.lit(CONTEXT))


def _behind(between: Column, found: Column, i: Column) -> Column:
    """The ``CONTEXT`` characters behind match ``i``, later matches included."""
    gaps, matches = F.slice(between, i + 2, F.lit(NEIGHBOURS)), F.slice(found, i + 2, F.lit(NEIGHBOURS))
    pieces = F.zip_with(gaps, matches, lambda gap, m: F.concat(F.left(gap, F.lit(CONTEXT)), F.coalesce(m, F.lit(""))))
    return F.left(F.array_join(pieces, ""), F.lit(CONTEXT))


def spans(text: Column, kind: Kind) -> Column:
    """The confirmed spans of a kind in a text: array of (start, end, score), code points, end exclusive."""
    empty = F.array().cast(SPAN)
    pattern = F.lit(kind.pattern)

    def located(found: Column) -> Column:
        return let(F.split(text, kind.pattern, -1), lambda between: let(_steps(between, found), lambda steps: let(_bases(steps), lambda bases: _confirmed(between, found, steps, bases))))

    def _steps(between: Column, found: Column) -> Column:
        return F.transform(found, lambda m, i: F.length(between[i]) + F.length(m))

    def _bases(steps: Column) -> Column:
        count = F.ceil(F.size(steps) / BLOCK).cast("int")
        totals = F.transform(F.sequence(F.lit(0), count - 1), lambda b: _sum(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))))
        return let(totals, lambda t: F.transform(t, lambda _, b: _sum(F.slice(t, F.lit(1), b))))

    def _confirmed(between: Column, found: Column, steps: Column, bases: Column) -> Column:
        def place(m: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            start = bases[block] + _sum(F.slice(steps, block * BLOCK + 1, i % BLOCK)) + F.length(between[i])
            near = _before(between, found, i).rlike(f"(?i){kind.context}") | _behind(between, found, i).rlike(f"(?i){kind.context}")
            score = F.when(near, F.lit(kind.raised)).otherwise(F.lit(kind.score))
            at = let(start, lambda s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), score.alias("score")))
            return F.when(kind.valid(m), at)

        return F.filter(F.transform(found, place), lambda s: s.isNotNull()).cast(SPAN)

    hint = text.contains(kind.hint) if len(kind.hint) == 1 else text.rlike(kind.hint)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.when(hint, let(matches, lambda found: F.when(F.size(found) > 0, located(found)).otherwise(empty))).otherwise(empty)


def find_pii(docs: DataFrame, more: tuple[Kind, ...] = MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one array of spans per kind) for every row. A null text counts as empty and has none; rows are independent, so null or repeated
    ids come back as they are; an empty table gives an empty result. One pass, no shuffle."""
    rows = id_and_text(docs, id_col, text_col)
    return rows.select(F.col("_id").alias(id_col), *[spans(F.col("_text"), k).alias(k.name) for k in (*BASE, *more)])


def _named(kind: Kind) -> Column:
    return F.transform(F.col(kind.name), lambda s: F.concat_ws(":", F.lit(kind.name), s["start"], s["end"]))


def digest(found: DataFrame, more: tuple[Kind, ...] = MORE, id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, the SHA-256 of the base spans, all spans as text, and their scores in the same order."""
    scores = F.concat(*[F.transform(F.col(k.name), lambda s: s["score"].cast("string")) for k in (*BASE, *more)])
    texts = found.select("*", F.concat(*map(_named, BASE)).alias("_base"), F.concat(*map(_named, more)).alias("_more"), scores.alias("_scores"))
    return texts.select(
        id_col, *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in BASE], F.sha2(F.array_join("_base", ","), 256).alias("base_sha256"),
        F.array_join(F.concat("_base", "_more"), ",").alias("spans"), F.array_join("_scores", ",").alias("scores"),
    )


def _duck_spans(kind: str, pattern: str, valid: str) -> str:
    of = next(k for k in (*BASE, *MORE) if k.name == kind)
    return f"""{kind}_a AS (SELECT doc_id, regexp_extract_all(t, '{pattern}') m, string_split_regex(t, '{pattern}') b FROM docs),
{kind}_b AS (SELECT doc_id, m, [length(x) FOR x IN b] bl, [length(x) FOR x IN m] ml FROM {kind}_a),
{kind}_c AS (SELECT doc_id, unnest(m) w, unnest(bl[:len(ml)]) gap, unnest(ml) n, generate_subscripts(m, 1) i FROM {kind}_b WHERE len(m) > 0),
{kind}_d AS (SELECT doc_id, w, i, sum(gap + n) OVER (PARTITION BY doc_id ORDER BY i) - n AS s, n FROM {kind}_c),
{kind}_e AS (SELECT doc_id, w, CAST(s AS BIGINT) s, CAST(s + n AS BIGINT) e, t FROM {kind}_d JOIN docs USING (doc_id) WHERE {valid}),
{kind} AS (SELECT doc_id, count(*) n, string_agg('{kind}:' || s || ':' || e, ',' ORDER BY s) x, string_agg(CASE WHEN regexp_matches(substr(t, greatest(1, s - {CONTEXT - 1}), least({CONTEXT}, s)), '(?i){of.context}')
  OR regexp_matches(substr(t, e + 1, {CONTEXT}), '(?i){of.context}') THEN '{of.raised}' ELSE '{of.score}' END, ',' ORDER BY s) y FROM {kind}_e GROUP BY doc_id)"""


_LUHN = (
    "list_sum([CASE WHEN j % 2 = 1 THEN CAST(substr(reverse(d), j, 1) AS INT) WHEN CAST(substr(reverse(d), j, 1) AS INT) > 4 "
    "THEN 2 * CAST(substr(reverse(d), j, 1) AS INT) - 9 ELSE 2 * CAST(substr(reverse(d), j, 1) AS INT) END FOR j IN range(1, length(d) + 1)]) % 10 = 0"
).replace("(d)", "(regexp_replace(w, '[^0-9]', '', 'g'))")
_LENGTH = "length(regexp_replace(w, '[^0-9]', '', 'g'))"
_MOD97 = (
    "CASE WHEN regexp_full_match(w, '[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}') THEN list_reduce(list_prepend(CAST(0 AS BIGINT), [CASE WHEN c BETWEEN '0' AND '9' THEN CAST(ascii(c) - 48 AS BIGINT)"
    " ELSE CAST(ascii(c) - 55 AS BIGINT) END FOR c IN string_split(substr(w, 5) || substr(w, 1, 4), '')]), lambda a, c: CASE WHEN c < 10 THEN (a * 10 + c) % 97 ELSE (a * 100 + c) % 97 END) = 1 ELSE FALSE END"
)
ORACLE = "WITH docs AS (SELECT doc_id, coalesce(text, '') t FROM documents),\n" + ",\n".join([
    _duck_spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE"),
    _duck_spans("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max([CAST(p AS HUGEINT) FOR p IN string_split(w, '.')]) <= 255"),
    _duck_spans("card", r"[0-9](?:[\x20-]?[0-9])+", f"{_LENGTH} BETWEEN 16 AND 19 AND {_LUHN}"),
    _duck_spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"{_LENGTH} BETWEEN 8 AND 15"),
    _duck_spans("iban", "[A-Za-z0-9]+", _MOD97),
]) + """
SELECT d.doc_id, coalesce(email.n, 0) n_email, coalesce(ip.n, 0) n_ip, coalesce(card.n, 0) n_card, coalesce(phone.n, 0) n_phone,
sha256(concat_ws(',', email.x, ip.x, card.x, phone.x)) base_sha256, concat_ws(',', email.x, ip.x, card.x, phone.x, iban.x) spans, concat_ws(',', email.y, ip.y, card.y, phone.y, iban.y) scores
FROM docs d LEFT JOIN email USING (doc_id) LEFT JOIN ip USING (doc_id) LEFT JOIN card USING (doc_id) LEFT JOIN phone USING (doc_id) LEFT JOIN iban USING (doc_id)"""
