"""Personal data: regular expressions propose spans, checksums confirm them, context words score them.

Base kinds are fixed by their patterns and checks: email, ip (parts up to 255), card (13 to 19 digits,
Luhn), phone (9 to 15 digits after a plus sign). Added kinds: iban (mod-97) and ssn, which is kept only
where a word nearby speaks for it. Every span has a score: its kind's, raised by context words of its
kind in the 48 characters before or after it, whatever stands between. Only where the text between it and the
next match of its kind holds a contrast ("but", "not") do words beyond that match not count. Offsets are in
code points, end exclusive.

An account number (iban) starts with a country and check digits and ends where a word ends: after as many
characters as its country has, or, for a country without a known length, after the most words (15 to 34
characters) that pass mod-97. Each start is tried. Of those that overlap, one of a known country counts,
else the first.

The patterns are the stated ones, written so that the matcher needs no recursion and looks at each
character a bounded number of times: repetitions that nothing can give back are possessive, and a match
that must start its run of characters says so (or starts where the last one ended).

Defined cases: a null text has no spans; rows of equal (or null) id are each judged alone; spans of one kind
never overlap, those of different kinds may; an empty table gives an empty result; very long texts are searched whole, in
blocks. Only the id and text are read, so other columns may have any name. All is done inside the row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a span of each kind looks like, and a cheap test that a text may hold one.
PATTERNS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){12,}+", r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    # only the start is matched; the group holds all that may belong to it and the character after that
    "iban": (r"\b(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?s:.)?))[A-Z]{2}[0-9]{2}", r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
}
BASE = ("email", "ip", "card", "phone")
#: A kind's own score, its context words, what they add, and the least score that counts.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "payment", "credit"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social", "security"),
}
BOOST, LEAST, NEAR = 0.3, 0.5, 48
#: Between two matches of a kind: what was said of the one is not said of the other.
CONTRAST = r"(?i)\b(?:but|not|aber|nicht|sondern|pero|sino|mais)\b"
#: Characters of an account number by country.
IBAN = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
    "HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 "
    "QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}
BLOCK = 256


def running(lengths: Column) -> Column:
    """Sums of what stands before each element, in blocks so that long arrays take linear time and no shuffle."""
    zero = F.array().cast("array<long>")

    def sums(part: Column, start: Column) -> Column:
        init = F.struct(start.alias("at"), zero.alias("out"))
        return F.aggregate(part, init, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))
    totals = F.transform(blocks, lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x))
    starts = sums(totals, F.lit(0).cast("long"))
    return F.when(n > 0, F.flatten(F.zip_with(blocks, starts, sums))).otherwise(zero)


def luhn(digits: Column) -> Column:
    """digits: decimal digits only, from the right every second one counts double."""
    d = F.split(F.reverse(digits), "(?!^|$)")
    each = F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), x.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def mod97(text: Column) -> Column:
    """The account number's country and check digits go last; letters count as 10 to 35."""
    bare = F.regexp_replace(text, " ", "")
    moved = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    return F.aggregate(F.split(moved, "(?!^|$)"), F.lit(0), lambda s, x: F.when(x.rlike("[0-9]"), (s * 10 + F.ascii(x) - 48) % 97).otherwise((s * 100 + F.ascii(x) - 55) % 97)) == 1


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def account(start: Column) -> Column:
    """The account number at the start of a text, or null."""
    words = F.regexp_extract_all(start, F.lit(r"[A-Z0-9]++\b"), F.lit(0))
    known = F.element_at(F.create_map(*[F.lit(x) for c in IBAN.items() for x in c]), F.substring(start, 1, 2))

    def ends(w: Column) -> Column:
        upto = F.transform(F.sequence(F.size(w), F.lit(1), F.lit(-1)), lambda j: F.array_join(F.slice(w, F.lit(1), j), " "))
        size = lambda t: F.length(F.replace(t, F.lit(" ")))
        return F.get(F.filter(upto, lambda t: F.coalesce(size(t) == known, size(t).between(15, 34)) & mod97(t)), F.lit(0))

    return let(words, lambda w: F.when(F.size(w) > 0, ends(w)))


def in_blocks(spans: Column, join) -> Column:
    """Spans by start, one after the other: join(last, x) is what the last one becomes by x, or null if x comes next. In blocks, as running()."""
    none = F.slice(spans, 1, 0)
    n = F.size(spans)

    def add(s: Column, x: Column) -> Column:
        both = F.when(s["last"].isNotNull(), join(s["last"], x))
        done = F.when(both.isNull() & s["last"].isNotNull(), F.concat(s["out"], F.array(s["last"]))).otherwise(s["out"])
        return F.struct(F.coalesce(both, x).alias("last"), done.alias("out"))

    def block(s: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(s["last"].alias("last"), none.alias("out")), add)
        return let(inner, lambda t: F.struct(t["last"].alias("last"), F.concat(s["out"], F.array(t["out"])).alias("out")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(spans, b * BLOCK + 1, BLOCK))
    init = F.struct(F.get(none, F.lit(0)).alias("last"), F.slice(F.array(none), 1, 0).alias("out"))
    kept = F.aggregate(blocks, init, block, lambda s: F.concat(F.flatten(s["out"]), F.array(s["last"])))
    return F.when(n > 1, kept).otherwise(spans)


def apart(spans: Column, first: Column) -> Column:
    """Of spans by start those that do not overlap; one that is `first` replaces one before it that is not."""
    return in_blocks(spans, lambda last, x: F.when(x["start"] < last["end"], F.when(first(x) & ~first(last), x).otherwise(last)))


def holds(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: match.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?){3}$"),
        "card": lambda: (F.length(digits) >= 13) & (F.length(digits) <= 19) & luhn(F.when(F.length(digits) <= 19, digits).otherwise("0")),
        "phone": lambda: F.length(digits).between(9, 15),
        "ssn": lambda: ~match.rlike("^(?:000|666|9)"),
    }[kind]()


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and, per kind, array<struct<kind, start, end, score>> by start.

    Step by step, so that no step's pattern runs again in the next one.
    """
    step = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found, between = {}, {}
    for kind, (pattern, hint) in PATTERNS.items():
        may = F.regexp_like("text", F.lit(hint))
        found[kind] = F.when(may, F.regexp_extract_all("text", F.lit(pattern), F.lit(int(kind == "iban")))).otherwise(F.array().cast("array<string>"))
        between[kind] = F.when(F.size(kind) > 0, F.split("text", pattern, -1))
    step = step.select("doc_id", "text", *[c.alias(k) for k, c in found.items()])
    # the text in pieces of equal length, so that what stands near an offset is found without a walk from the start
    padded = F.concat(F.lit(" " * (NEAR + 1)), F.col("text"))
    pieces = F.when(F.greatest(*[F.size(k) for k in PATTERNS]) > 0, F.regexp_extract_all(padded, F.lit(rf"(?s).{{1,{BLOCK}}}+"), F.lit(0)))
    step = step.select("doc_id", *PATTERNS, *[c.alias(f"{k}_gaps") for k, c in between.items()], pieces.alias("pieces"))
    # a piece of text, then a match, and so on: gaps are one more than matches
    step = step.select("doc_id", "pieces", *PATTERNS, *[F.transform(f"{k}_gaps", lambda gap: F.struct(F.length(gap).cast("long").alias("n"), ((F.length(gap) < NEAR) & gap.rlike(CONTRAST)).alias("contrast"))).alias(f"{k}_gaps") for k in PATTERNS])
    step = step.select("doc_id", "pieces", *[between_gaps(k).alias(k) for k in PATTERNS])
    step = step.select("doc_id", "pieces", *PATTERNS, *[running(lengths(k)).alias(f"{k}_at") for k in PATTERNS])
    step = step.select("doc_id", *[spans_of(k).alias(k) for k in PATTERNS])
    return step.select("doc_id", *[plain(apart(F.col(k), lambda s: s["known"])).alias(k) if k == "iban" else F.col(k) for k in PATTERNS])


def long_of(kind: str, match: Column) -> Column:
    """Characters that the pattern itself went over."""
    return F.lit(4) if kind == "iban" else F.length(match)


def between_gaps(kind: str) -> Column:
    gaps = F.col(f"{kind}_gaps")
    return F.when(F.size(kind) > 0, F.transform(kind, lambda m, i: F.struct(F.get(gaps, i).alias("gap"), F.get(gaps, i + 1).alias("next"), m.alias("m")))).otherwise(F.array())


def lengths(kind: str) -> Column:
    return F.transform(kind, lambda p: p["gap"]["n"] + long_of(kind, p["m"]))


def plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))


def window(at: Column, n: Column) -> Column:
    """n characters of the padded text from offset at."""
    piece, within = F.floor(at / BLOCK).cast("int"), F.pmod(at, F.lit(BLOCK)).cast("int")
    return F.substring(F.concat_ws("", F.get("pieces", piece), F.get("pieces", piece + 1)), within + 1, n)


def spans_of(kind: str) -> Column:
    # one character more than counts: a word that starts before is none
    said = r"(?!^)\b(?:" + "|".join(CONTEXT[kind]) + r")"

    def span(p: Column, before: Column) -> Column:
        match = account(p["m"]) if kind == "iban" else p["m"]
        return let(match, lambda m: judged(p, before + p["gap"]["n"], m))

    def judged(p: Column, start: Column, m: Column) -> Column:
        end = start + F.length(m)
        left = F.when(p["gap"]["contrast"] & (start > p["gap"]["n"]), p["gap"]["n"]).otherwise(NEAR).cast("int")
        rest = start + long_of(kind, p["m"]) + p["next"]["n"] - end  # up to the next match
        right = F.when(p["next"]["contrast"] & (rest > 0), F.least(rest, F.lit(NEAR))).otherwise(NEAR).cast("int")
        near = F.lower(window(start + NEAR - left, left + 1)).rlike(said) | F.lower(window(end + NEAR, right + 1)).rlike(said)
        score = F.lit(SCORES[kind]) + F.when(near, BOOST).otherwise(0.0)
        ok = m.isNotNull() if kind == "iban" else holds(kind, m)
        ok = ok if kind in BASE else ok & (score >= LEAST)
        fields = [F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.least(score, F.lit(1.0)).alias("score")]
        known = [F.substring(m, 1, 2).isin(*IBAN).alias("known")] if kind == "iban" else []
        return F.when(ok, F.struct(*fields, *known))

    return F.filter(F.zip_with(kind, f"{kind}_at", span), lambda s: s.isNotNull())


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, all spans as text, and the mean score."""
    base, every = F.concat(*BASE), F.concat(*PATTERNS)
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(every).alias("spans"),
        F.round(F.aggregate(every, F.lit(0.0), lambda s, x: s + x["score"]) / F.greatest(F.size(every), F.lit(1)), 6).alias("mean_score"),
    )


def merged(spans: Column) -> Column:
    """Of spans by start, those that overlap as one, of the first one's kind."""

    def over(x: Column, y: Column) -> Column:
        return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), F.greatest(x["end"], y["end"]).alias("end"))

    return in_blocks(spans, lambda last, x: F.when(x["start"] < last["end"], over(last, x)))


def stretch(start: Column, end: Column) -> Column:
    """The text from start to end, out of its pieces."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.slice("pieces", first + 1, F.floor((end - 1) / BLOCK).cast("int") - first + 1)
    return F.when(end > start, F.substring(F.array_join(some, ""), F.pmod(start, F.lit(BLOCK)).cast("int") + 1, (end - start).cast("int"))).otherwise("")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs, the text with the characters of each span that find() confirms, of any kind, replaced by its kind in brackets.

    Spans that overlap are replaced together, under the kind of the first one. All are found in the text as it was.
    """
    found = find(docs.select(F.struct("*").alias("row"), F.col(text).alias("text")), doc_id="row", text="text")
    every = F.array_sort(F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))) for k in PATTERNS]))
    plain_text = F.col(f"row.`{text}`")
    step = found.select(F.col("doc_id").alias("row"), every.alias("every")).select("row", merged(F.transform("every", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))).alias("spans"))
    step = step.select("row", "spans", plain_text.alias("t"), F.when(F.size("spans") > 0, F.regexp_extract_all(plain_text, F.lit(rf"(?s).{{1,{BLOCK}}}+"), F.lit(0))).alias("pieces"))
    before = lambda i: F.when(i > 0, F.get("spans", i - 1)["end"]).otherwise(0)
    parts = F.transform("spans", lambda s, i: F.concat(stretch(before(i), s["start"]), F.lit("["), s["kind"], F.lit("]")))
    rest = stretch(F.get("spans", F.size("spans") - 1)["end"], F.char_length("t").cast("long"))
    shown = F.when(F.size("spans") > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(F.col("t"))
    return step.select(*[shown.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
