"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score. Columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds, written so that no start is tried twice within a run of characters.
#: Possessive repeats keep the matcher iterative on very long runs; \G lets a match begin where the last one ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
}
#: A text without a match of these has no span of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Words that make a kind likelier when they stand nearby.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "address|server|host|login",
    "card": "card|credit|visa|payment|account",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|transfer",
}
#: Scores of a confirmed span without context, before the context adds CONTEXT_BONUS.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.85}
CONTEXT_BONUS, REACH = 0.1, 40


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn's checksum over a string of digits."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """The check of ISO 7064 over letters and digits, the first four characters moved to the end."""
    plain = F.replace(code, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        k = F.ascii(c)
        return F.when(k >= 65, (rest * 100 + k - 55) % 97).otherwise((rest * 10 + k - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(add(r, c))) == 1


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
            F.split(match, r"\."), lambda p: F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(999)) <= 255
        )
    if kind == "card":
        number = digits(match)
        return F.when(F.length(number).between(13, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def _spans(kind: str, found: Column, gaps: Column) -> Column:
    """Confirmed matches as structs; positions are sums of the lengths of what stands before."""

    def step(state: Column, i: Column) -> Column:
        gap, match = F.get(gaps, i), F.get(found, i)
        start = state["at"] + F.length(gap)
        end = start + F.length(match)
        near = F.lower(F.concat_ws(" ", F.right(gap, F.lit(REACH)), F.left(F.get(gaps, i + 1), F.lit(REACH))))
        score = F.lit(BASE_SCORE[kind]) + F.when(near.rlike(CONTEXT[kind]), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), match.alias("text"), score.alias("score"))
        return F.struct(end.alias("at"), F.when(confirmed(kind, match), F.array_append(state["spans"], one)).otherwise(state["spans"]).alias("spans"))

    none = F.from_json(F.lit("[]"), "array<struct<kind:string,start:int,end:int,text:string,score:double>>")
    empty = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), empty, step)["spans"]).otherwise(none)


def find_pii(docs: DataFrame, kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """`docs` with `spans`: an array of (kind, start, end, text, score), by kind as listed, then by start.

    Starts and ends are code points, the end exclusive. email, ip, card and phone are the base kinds; iban is added to
    them. A kind's matches are the leftmost ones that don't overlap; one that fails its check is dropped.

    Null or empty text: no spans. Very long texts: one pass a kind, no backtracking over runs. Repeated rows: each for
    itself. An empty table: empty. Other columns are kept; a column named spans is replaced.
    """
    names = {k: f"__{k}" for k in kinds}
    text = F.coalesce(F.col("text"), F.lit(""))

    def where_needed(kind: str, value: Column) -> Column:
        need = NEEDS.get(kind)
        return F.when(F.contains(text, F.lit(need)), value).otherwise(F.array().cast("array<string>")) if need else value

    found = docs.withColumns({n: where_needed(k, F.regexp_extract_all(text, F.lit(PATTERNS[k]), 0)) for k, n in names.items()})
    cut = found.withColumns({n + "_gaps": F.when(F.size(n) > 0, F.split(text, PATTERNS[k], -1)) for k, n in names.items()})
    spans = cut.withColumn("spans", F.concat(*[_spans(k, F.col(n), F.col(n + "_gaps")) for k, n in names.items()]))
    return spans.drop(*names.values(), *[n + "_gaps" for n in names.values()])


def mask_pii(docs: DataFrame) -> DataFrame:
    """`docs` (its columns only) with each span's text replaced by its kind in angle brackets; n_chars follows the text.

    Spans that overlap one before them are covered by it. Null text stays null.
    """
    marked = find_pii(docs.withColumnRenamed("spans", "__own_spans"))
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def step(state: Column, s: Column) -> Column:
        end = -s["back"]
        piece = F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"])
        out = F.concat(state["out"], piece, F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.when(s["start"] >= state["at"], F.struct(end.alias("at"), out.alias("out"))).otherwise(
            F.struct(F.greatest(state["at"], end).alias("at"), state["out"].alias("out"))
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(order, start, step, lambda s: F.concat(s["out"], F.substr(F.col("text"), s["at"] + 1)))
    masked = marked.withColumn("text", F.when(F.size("spans") > 0, done).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*[F.col("__own_spans").alias(c) if c == "spans" else F.col(c) for c in docs.columns])


BASE_KINDS = ("email", "ip", "card", "phone")


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined positions of `find_pii`'s result, one row for each document."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(of(*BASE_KINDS)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
