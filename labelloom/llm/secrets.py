"""Secret scan: base patterns and a comparison of two character Markov models, in DataFrame functions only.

Base spans are given patterns. Beyond them, each long token of what base spans leave of the text is scored by the
log-likelihood ratio per step of two first-order Markov models over its characters: random strings
against ordinary identifiers. Both are trained on labelled samples of the same corpus: the values that
base patterns find, and the other tokens that look like identifiers. Their transition counts come from
all rows (combined before the shuffle) and number at most the square of the alphabet, hence fit a literal.

A span's place follows from the texts between matches: `split` gives them, `regexp_extract_all` the
matches, and a running sum of their lengths the start of each. Positions are code points, ends exclusive.
Long texts are cut into pieces of some thousand characters, after a line break or a blank that no match can
cross, and each piece is searched on its own, so the work follows the length of a text, however many spans it has.

Defined results: null text is the empty text; overlapping base spans of different kinds all stay; equal
starts are ordered as the kinds are listed; rows pass through whatever their ids; without any labelled
sample no span is added.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import fresh

#: The base kinds in order: pattern, least length, group whose length counts. Fixed values of the contract.
#: Runs shorter than the least length are no matches of the last two, so their patterns may ask for it at once.
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 24),
)
#: Parts of which one stands, in lower case, in every text with a match: a cheap test before the pattern.
HINTS = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",)}
MARKOV = "markov"
ORDER = tuple(k for k, _, _ in KINDS) + (MARKOV,)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Tokens that the models judge, and the shorter ones that ordinary identifiers are learned from.
TOKEN, IDENTIFIER = (r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}" % n for n in (20, 12))
#: The alphabet's characters have codes from here on, this many.
FIRST_CODE, CODES = 43, 80
#: Log-likelihood ratio per step from which a token counts as random.
LEAST_RATIO = 0.5
#: Characters from which a text is cut, and its pieces: they end where no pattern matches across, after a line
#: break or after a blank that has no `:` or `=` next to it or beyond other blanks.
PIECE_CHARS = 4_096
PIECE = rf"(?s).{{0,{PIECE_CHARS}}}.*?(?:\n|(?<=[^:=\x20])\x20(?=[^:=\x20])|\z)"
#: Added to each transition count.
SMOOTHING = 0.5


def placed(text: Column, pattern: str, group: int = 0, hints: tuple[str, ...] = ()) -> Column:
    """Array of (start, end, value) of all matches, leftmost and not overlapping; `value` is the given group."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1)) if group else whole
    between = F.split(text, pattern, -1)
    rows = F.zip_with(
        F.zip_with(F.slice(between, 1, F.size(whole)), whole, lambda b, w: F.struct(F.length(b).alias("b"), F.length(w).alias("w"))),
        values,
        lambda s, v: F.struct(s["b"].alias("b"), s["w"].alias("w"), v.alias("v")),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))
    run = F.aggregate(
        rows,
        zero,
        lambda acc, x: F.struct(
            (acc["at"] + x["b"] + x["w"]).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        (acc["at"] + x["b"]).alias("start"), (acc["at"] + x["b"] + x["w"]).alias("end"), x["v"].alias("value")
                    )
                ),
            ).alias("out"),
        ),
    )
    # the cheap tests first: most texts hold no match at all
    may = [F.contains(F.lower(text), F.lit(h)) for h in hints]
    some = functools.reduce(lambda a, b: a | b, may) if may else F.lit(True)
    return F.when(some & F.regexp_like(text, F.lit(pattern)), run["out"]).otherwise(zero["out"])


def pieces(text: Column) -> Column:
    """(at, text) of the pieces of a text, in order; short texts are one piece."""
    one = F.array(F.struct(F.lit(0).alias("at"), text.alias("text")))
    cut = F.filter(F.regexp_extract_all(text, F.lit(f"({PIECE})"), F.lit(1)), lambda p: p != "")
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,text:string>>").alias("out"))
    run = F.aggregate(
        cut,
        none,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), p.alias("text")))).alias("out")
        ),
    )
    return F.when(F.length(text) <= PIECE_CHARS, one).otherwise(run["out"])


def blanked(text: Column, spans: Column) -> Column:
    """The text with blanks over the spans, which are in order of their starts."""
    run = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            F.concat(
                acc["out"],
                F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))),
                F.repeat(F.lit(" "), F.greatest(x["end"] - F.greatest(x["start"], acc["at"]), F.lit(0))),
            ).alias("out"),
            F.greatest(acc["at"], x["end"]).alias("at"),
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(run["out"], F.substring(text, run["at"] + 1, F.length(text))))


def _before(a: Column, b: Column) -> Column:
    """Order of spans: by start, then by kind."""
    return F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])


def base_spans(text: Column, kind: str) -> Column:
    pattern, least = next((p, n) for k, p, n in KINDS if k == kind)
    found = placed(text, pattern, 1 if kind == "assign" else 0, HINTS.get(kind, ()))
    return F.filter(found, lambda x: F.length(x["value"]) >= least)


def with_base(docs: DataFrame, text_column: str) -> tuple[DataFrame, str, str]:
    """Adds the pieces of each text with their base spans (kind number, start, end, value), in order, and the text without null; and both names."""
    parts, text = fresh(docs.columns, "__parts"), fresh(docs.columns, "__text")

    def based(piece: Column) -> Column:
        kinds = [
            F.transform(
                base_spans(piece["text"], kind),
                lambda x: F.struct(F.lit(number).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")),  # noqa: B023
            )
            for number, kind in enumerate(ORDER[:-1])
        ]
        return F.struct(piece["at"].alias("at"), piece["text"].alias("text"), F.array_sort(F.concat(*kinds), _before).alias("base"))

    out = docs.withColumn(text, F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    return out.withColumn(parts, F.transform(pieces(F.col(text)), based)), parts, text


def transitions(token: Column) -> Column:
    """Pairs of neighbouring characters of a token."""
    return F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substring(token, i, F.lit(2)))


def labelled_tokens(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(token, random): values of base spans as random samples, other identifier-like words as ordinary ones."""
    scanned, parts, _ = with_base(docs.select(F.col(text_column)), text_column)
    # what base patterns take is no ordinary identifier
    both = F.transform(
        parts,
        lambda p: F.concat(
            F.transform(p["base"], lambda x: F.struct(x["value"].alias("token"), F.lit(True).alias("random"))),
            F.transform(
                F.regexp_extract_all(blanked(p["text"], p["base"]), F.lit(f"({IDENTIFIER})"), F.lit(1)),
                lambda x: F.struct(x.alias("token"), F.lit(False).alias("random")),
            ),
        ),
    )
    return scanned.select(F.inline(F.flatten(both)))


def train(tokens: DataFrame) -> dict[str, float] | None:
    """Log-likelihood ratio of each character pair, from (token, random) rows; None without samples of both kinds."""
    long = tokens.where(F.length("token") >= 2)
    pairs = long.select("random", F.explode(transitions(F.col("token"))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    models = {}
    for random in (True, False):
        totals = dict.fromkeys(ALPHABET, SMOOTHING * len(ALPHABET))
        for (kind, pair), n in counts.items():
            if kind == random and pair[0] in totals and pair[1] in totals:
                totals[pair[0]] += n
        if not any(kind == random for kind, _ in counts):
            return None
        models[random] = {a + b: math.log((counts.get((random, a + b), 0) + SMOOTHING) / totals[a]) for a in ALPHABET for b in ALPHABET}
    return {p: models[True][p] - models[False][p] for p in models[True]}


def ratio(token: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of a token's transitions; `table` holds the ratios by pairs of character codes."""
    code = lambda i: F.ascii(F.substring(token, i, F.lit(1))) - FIRST_CODE
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.get(table, code(i) * CODES + code(i + 1))
    )
    return total / (F.length(token) - 1)


def ratio_table(model: dict[str, float]) -> Column:
    cells = [0.0] * (CODES * CODES)
    for pair, value in model.items():
        cells[(ord(pair[0]) - FIRST_CODE) * CODES + ord(pair[1]) - FIRST_CODE] = value
    return F.expr("array(" + ",".join(f"{v:.6f}D" for v in cells) + ")")  # folded to one literal of bounded size


def _scanned(docs: DataFrame, model: dict[str, float] | None, text_column: str, least_ratio: float) -> tuple[DataFrame, str, str]:
    """Adds (at, text, spans) of every piece; spans (kind, start, end, ratio) count from the piece's start."""
    scanned, parts, text = with_base(docs, text_column)
    table = ratio_table(model) if model is not None else None

    def span(x: Column, kind: Column, score: Column) -> Column:
        return F.struct(kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score.alias("ratio"))

    def spans(p: Column) -> Column:
        found = F.transform(p["base"], lambda x: span(x, x["kind"], F.lit(None).cast("double")))
        if table is not None:
            long = placed(blanked(p["text"], p["base"]), TOKEN)
            scored = F.transform(long, lambda t: span(t, F.lit(len(KINDS)), ratio(t["value"], table)))
            found = F.array_sort(F.concat(found, F.filter(scored, lambda t: t["ratio"] >= least_ratio)), _before)
        return F.struct(p["at"].alias("at"), p["text"].alias("text"), found.alias("spans"))

    return scanned.withColumn(parts, F.transform(parts, spans)), parts, text


def find_secrets(docs: DataFrame, model: dict[str, float] | None, text_column: str = "text", least_ratio: float = LEAST_RATIO) -> DataFrame:
    """All columns of `docs` and `secrets`: array of (kind, start, end, ratio), by start, then kind.

    `ratio` is null for base spans. The scan is a map: no shuffle, no Python.
    """
    scanned, parts, text = _scanned(docs, model, text_column, least_ratio)
    moved = F.transform(
        parts,
        lambda p: F.transform(
            p["spans"],
            lambda x: F.struct(x["kind"].alias("kind"), (x["start"] + p["at"]).alias("start"), (x["end"] + p["at"]).alias("end"), x["ratio"].alias("ratio")),
        ),
    )
    return scanned.withColumn(fresh(docs.columns, "secrets"), F.flatten(moved)).drop(parts, text)


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def secret_report(documents: DataFrame) -> DataFrame:
    """Per document: base spans by kind, their digest and all spans."""
    model = train(labelled_tokens(documents))
    found = find_secrets(documents.select("doc_id", "text"), model)
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(n).alias(f"n_{kind}") for n, kind in enumerate(ORDER[:-1])],
        F.sha2(spelled(F.filter("secrets", lambda x: x["kind"] < len(KINDS))), 256).alias("base_sha256"),
        spelled(F.col("secrets")).alias("spans"),
    )


def masked(docs: DataFrame, text_column: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """`docs` with every span replaced by `mask`; overlapping spans become one. Null texts stay null."""
    model = train(labelled_tokens(docs, text_column))
    scanned, parts, _ = _scanned(docs, model, text_column, LEAST_RATIO)

    def clean(p: Column) -> Column:
        run = F.aggregate(
            p["spans"],
            F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
            lambda acc, x: F.struct(
                F.when(x["start"] < acc["at"], acc["out"])
                .otherwise(F.concat(acc["out"], F.substring(p["text"], acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask)))
                .alias("out"),
                F.greatest(acc["at"], x["end"]).alias("at"),
            ),
        )
        whole = F.concat(run["out"], F.substring(p["text"], run["at"] + 1, F.length(p["text"])))
        return F.when(F.size(p["spans"]) == 0, p["text"]).otherwise(whole)

    text = F.col(text_column)
    return scanned.withColumn(text_column, F.when(text.isNotNull(), F.array_join(F.transform(parts, clean), ""))).select(*docs.columns)
