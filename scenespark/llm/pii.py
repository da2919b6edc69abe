"""Personal data: overlapping candidate spans, boosted trees, calibrated thresholds (DataFrame functions only).

Generators propose spans by pattern, far more freely than the base rules.  Each candidate gets a set of yes/no
features of its own form and of the text around it.  One scan of the texts keeps only the candidates.  Since
features are yes/no, all candidates of the corpus fold into one row for each feature set, and trees are boosted
on those counts: nothing is sampled.

The corpus has no labels of personal data, so each generator learns from a weak label that its trees cannot see:
a validator (check digit, address ranges, digit count, top-level domain) or a cue in the text before the span
(``token =``, ``ssn``).  Features that decide the label, or nearly do, are hidden from that generator's trees
(``HIDDEN``).  The threshold of a generator is the lowest that keeps the wanted precision against the weak label
on documents kept apart; where none does, or nothing there has a label, the generator adds no span.  A cue marks
only some of the true spans, so the precision is a lower bound.  Spans of the base rules always stay, and the
generators without a base rule read the text without them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_crc, quoted, table

KINDS = ("email", "ip", "card", "phone", "secret", "id")
TREES, DEPTH, RATE, RIDGE = 30, 3, 0.3, 1.0
#: Precision a generator's threshold must keep on the documents apart.
PRECISION = 0.95
MARK, OTHER = "\x01", "\x02"
#: Elements and code points that are walked through at once in long texts.
WALK, BLOCK = 256, 4096

# Possessive forms and start conditions keep each pattern linear; they match what the plain forms match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # generators without a base rule
    "far_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\(\[\{](?:at|AT)[\)\]\}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\(\[\{](?:dot|DOT)[\)\]\}])\x20?[A-Za-z0-9-]++)++",
    "near_phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
GENERATORS = list(PATTERNS)
KIND_OF = {"far_email": "email", "near_phone": "phone"}
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CUES = r"(?i)(?:token|secret|passw|api.?key|\bkey|bearer|credential)[^A-Za-z0-9]{0,4}$"
CONTACT = r"(?i)(?:tel|phone|call|fax|mobile|ssn|card|mail|contact)[^A-Za-z0-9]{0,4}$"


def _let(value: Column, body) -> Column:
    """Bind a costly expression once, so that lambdas below it do not evaluate it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, step) -> Column:
    """array<int> -> its running ``step`` (a function of two Columns) from 0, in blocks: appending to one long array would be quadratic."""

    def block(acc: Column, part: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.array().cast("array<int>").alias("out"))
        inner = F.aggregate(part, start, lambda a, x: _let(step(a["at"], x), lambda y: F.struct(y.alias("at"), F.array_append(a["out"], y).alias("out"))))
        return _let(inner, lambda i: F.struct(i["at"].alias("at"), F.array_append(acc["out"], i["out"]).alias("out")))

    def walk(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / WALK).cast("int")), lambda b: F.slice(v, b * WALK + 1, WALK))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
        return F.flatten(F.aggregate(parts, start, block, lambda acc: acc["out"]))

    return _let(values, walk)


def split_at(text: Column, pattern: str) -> Column:
    """The text as an array in which every second element, from the second on, is a leftmost non-overlapping match."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)


SPAN = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct(start, end, match, before, after)> of the matches, in code points."""

    def walk(parts: Column) -> Column:
        ends = running(F.transform(parts, F.char_length), lambda a, x: a + x)
        at = lambda e: F.transform(
            F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)),
            lambda i: F.struct(
                F.get(e, i - 1).alias("start"), F.get(e, i).alias("end"), F.get(parts, i).alias("match"),
                F.right(F.get(parts, i - 1), F.lit(24)).alias("before"), F.substring(F.get(parts, i + 1), 1, 2).alias("after"),
            ),
        )
        return _let(ends, at)

    return F.when(text.rlike(pattern), _let(split_at(text, pattern), walk)).otherwise(F.array().cast(SPAN))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def is_base(kind: str, match: Column) -> Column:
    """Whether a match of a base pattern stands."""
    n = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        return F.when(n.between(16, 19), F.call_function("luhn_check", _digits(match))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(kind == "email")


def without_base(text: Column) -> Column:
    """The text with every standing base match written over, at its length."""

    def over(kind: str, parts: Column) -> Column:
        fill = lambda m: F.when(is_base(kind, m), F.repeat(F.lit(OTHER), F.char_length(m))).otherwise(m)
        return F.array_join(F.transform(parts, lambda m, i: F.when(i % 2 == 1, fill(m)).otherwise(m)), "")

    def each(kind: str, t: Column) -> Column:
        return F.when(t.rlike(PATTERNS[kind]), _let(split_at(t, PATTERNS[kind]), lambda parts: over(kind, parts))).otherwise(t)

    return reduce(lambda t, kind: _let(t, lambda x: each(kind, x)), KINDS[:4], text)


#: Yes/no features of a candidate, each from its span.
FEATURES = {
    "at": lambda s: s["match"].contains("@"),
    "bracketed": lambda s: s["match"].rlike(r"[\(\[\{]"),
    "dots3": lambda s: s["match"].rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"),
    "parts_fit": lambda s: s["match"].rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"),
    "plus": lambda s: s["match"].startswith("+"),
    "grouped": lambda s: s["match"].rlike(r"[0-9][ ().-]+[0-9]"),
    "even_groups": lambda s: s["match"].rlike(r"^[0-9]{4}(?:[ -][0-9]{4})+$"),
    "digits_only": lambda s: s["match"].rlike(r"^[0-9]+$"),
    "card_length": lambda s: F.length(_digits(s["match"])).between(16, 19),
    "check_digit": lambda s: F.when(F.length(_digits(s["match"])).between(12, 19), F.call_function("luhn_check", _digits(s["match"]))).otherwise(False),
    "phone_length": lambda s: F.length(_digits(s["match"])).between(8, 15),
    "hex": lambda s: s["match"].rlike(r"^[0-9A-Fa-f]{20,}$"),
    "mixed": lambda s: s["match"].rlike("[0-9]") & s["match"].rlike("[A-Za-z]"),
    "letters_only": lambda s: s["match"].rlike(r"^[A-Za-z]+$"),
    "both_cases": lambda s: s["match"].rlike("[a-z]") & s["match"].rlike("[A-Z]"),
    "long": lambda s: (s["end"] - s["start"]) >= 32,
    "cue": lambda s: s["before"].rlike(CUES),
    "contact": lambda s: s["before"].rlike(CONTACT),
    "assigned": lambda s: s["before"].rlike(r"[=:]\s?[\"']?$"),
    "quoted": lambda s: s["before"].rlike(r"[\"'`]$") & s["after"].rlike(r"^[\"'`]"),
    "top_domain": lambda s: s["match"].rlike(r"(?:\.|[\)\]\}]\s?)[A-Za-z]{2,}$"),
    "alone": lambda s: s["before"].rlike(r"(?:^|[\s\"'(<\[=:])$") & s["after"].rlike(r"^(?:$|[\s\"')>\].,;:!?%#$&*])"),
}
NAMES = list(FEATURES)
#: The feature that is a generator's weak label, and those its trees do not see.
LABEL = {"email": "top_domain", "ip": "parts_fit", "card": "check_digit", "phone": "phone_length", "far_email": "top_domain", "near_phone": "contact", "secret": "cue", "id": "contact"}
HIDDEN = {"secret": ("assigned", "quoted")}


def visible(generator: str) -> list[int]:
    """Places of the features that the trees of a generator use."""
    gone = {LABEL[generator], *HIDDEN.get(generator, ())}
    return [i for i, n in enumerate(NAMES) if n not in gone]


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs(text, ...) -> row (struct of ``keep``) and spans: array<struct(generator, kind, start, end, base, bits)>, in one scan."""

    def candidate(name: str):
        def build(s: Column) -> Column:
            bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(f(s), 1 << i).otherwise(0) for i, f in enumerate(FEATURES.values())])
            base = is_base(name, s["match"]) if name in KINDS else F.lit(False)
            base = F.lit(False) if name in KINDS[4:] else base
            return F.struct(
                F.lit(GENERATORS.index(name)).alias("generator"), F.lit(KINDS.index(KIND_OF.get(name, name))).alias("kind"),
                s["start"].alias("start"), s["end"].alias("end"), base.alias("base"), bits.alias("bits"),
            )

        return build

    def spans(text: Column) -> Column:
        of = lambda t, name: F.transform(matches(t, PATTERNS[name]), candidate(name))
        first = F.concat(*[of(text, name) for name in GENERATORS[:4]])

        def more(found: Column) -> Column:
            left = F.when(F.exists(found, lambda s: s["base"]), without_base(text)).otherwise(text)
            return F.concat(found, _let(left, lambda t: F.concat(*[of(t, name) for name in GENERATORS[4:]])))

        return _let(first, more)

    text = F.translate(F.coalesce("text", F.lit("")), MARK, OTHER)
    # no generator matches without a digit, an at sign, or a run of twenty
    some = text.rlike(r"[0-9@]|[\(\[\{](?:at|AT)[\)\]\}]|[A-Za-z_+/=-]{20}")
    empty = F.array().cast("array<struct<generator:int,kind:int,start:int,end:int,base:boolean,bits:int>>")
    return docs.select(F.struct(*map(quoted, keep)).alias("row"), F.when(some, _let(text, spans)).otherwise(empty).alias("spans"))


def boost(counts: list[tuple[int, float, float]], features: list[int]) -> list:
    """(feature bits, negatives, positives) -> start margin and trees as nested (feature, without, with) or leaf values."""
    total = sum(n + p for _, n, p in counts)
    positive = sum(p for _, _, p in counts)
    if not total:
        return [-4.0]
    mean = (positive + 0.5) / (total + 1)
    margin = {b: math.log(mean / (1 - mean)) for b, _, _ in counts}
    out: list = [math.log(mean / (1 - mean))]
    for _ in range(TREES):
        rows = []
        for b, n, p in counts:
            q = 1 / (1 + math.exp(-margin[b]))
            rows.append((b, p - (n + p) * q, (n + p) * q * (1 - q)))

        def grow(rows, depth):
            g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
            best, at = 1e-6, None
            if depth:
                for i in features:
                    g1, h1 = sum(r[1] for r in rows if r[0] >> i & 1), sum(r[2] for r in rows if r[0] >> i & 1)
                    gain = g1 * g1 / (h1 + RIDGE) + (g - g1) ** 2 / (h - h1 + RIDGE) - g * g / (h + RIDGE)
                    if gain > best:
                        best, at = gain, i
            if at is None:
                return RATE * g / (h + RIDGE)
            return (at, grow([r for r in rows if not r[0] >> at & 1], depth - 1), grow([r for r in rows if r[0] >> at & 1], depth - 1))

        tree = grow(rows, DEPTH)
        out.append(tree)
        for b in margin:
            node = tree
            while isinstance(node, tuple):
                node = node[1 + (b >> node[0] & 1)]
            margin[b] += node
    return out


def margin_of(model: list, bits: int) -> float:
    total = model[0]
    for node in model[1:]:
        while isinstance(node, tuple):
            node = node[1 + (bits >> node[0] & 1)]
        total += node
    return total


def threshold(tally: list[tuple[float, float, float]]) -> float:
    """(score, negatives, positives) -> the lowest score from which on the precision is kept; infinite if it never is."""
    out, n, p = math.inf, 0.0, 0.0
    by_score: dict[float, list[float]] = {}
    for score, neg, pos in tally:
        x = by_score.setdefault(score, [0.0, 0.0])
        x[0] += neg
        x[1] += pos
    for score in sorted(by_score, reverse=True):
        n, p = n + by_score[score][0], p + by_score[score][1]
        if n + p and p / (n + p) >= PRECISION:
            out = score
    return out


def train(spans: DataFrame) -> list[tuple[int, int]]:
    """Rows of candidates() -> (generator, feature bits) of the sets whose margin passes the generator's threshold.

    The driver sees one row for each generator and set of features that occurs (at most 2^22, in practice tens).
    """
    each = spans.select((id_crc(F.col("row.doc_id")) % 4 == 2).alias("apart"), F.explode("spans").alias("s"))
    rows = each.groupBy("apart", "s.generator", "s.bits").count().collect()
    chosen = []
    for g, name in enumerate(GENERATORS):
        shown, label = visible(name), NAMES.index(LABEL[name])
        mask = sum(1 << i for i in shown)
        counts: dict[bool, dict[int, list[float]]] = {True: {}, False: {}}
        for r in rows:
            if r["generator"] == g:
                x = counts[r["apart"]].setdefault(r["bits"] & mask, [0.0, 0.0])
                x[r["bits"] >> label & 1] += r["count"]
        model = boost([(b, *x) for b, x in sorted(counts[False].items())], shown)
        score = lambda bits, model=model, mask=mask: round(margin_of(model, bits & mask), 9)
        least = threshold([(score(b), *x) for b, x in counts[True].items()])
        chosen += sorted({(g, r["bits"]) for r in rows if r["generator"] == g and score(r["bits"]) >= least})
    return chosen


def select(spans: Column, chosen: list[tuple[int, int]]) -> Column:
    """Base spans and those whose features were chosen, each once, by kind and start."""
    keys = F.array(*[F.lit(g << 24 | b) for g, b in chosen]).cast("array<int>")
    good = F.filter(spans, lambda s: s["base"] | F.array_contains(keys, s["generator"] * (1 << 24) + s["bits"]))
    # equal neighbours of the sorted array are one; distinct() of structs would compare all with all
    return _let(F.array_sort(F.transform(good, _place)), lambda a: F.filter(a, lambda s, i: (i == 0) | (s != F.get(a, i - 1))))


def _place(s: Column) -> Column:
    return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def find_personal_data(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, base and spans: array<struct(kind int, start int, end int)> (index in KINDS; code points, end exclusive).

    Trains on the table itself and decides every span in it; spans may overlap.  Null and empty texts have no
    spans, long ones are read whole; null ids are kept; repeated rows are treated alike; an empty table gives
    an empty result.  ``keep`` names further columns to carry; those named doc_id, base or spans are replaced.
    """
    keep = [c for c in keep or [] if c not in ("doc_id", "base", "spans")]
    found = cut(candidates(docs, ["doc_id", *keep]), "pii-candidates")
    chosen = train(found)
    base = F.array_sort(F.transform(F.filter("spans", lambda s: s["base"]), _place))
    return found.select("row.*", base.alias("base"), select(F.col("spans"), chosen).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> the same columns with every span of the text replaced by ``<KIND>``.

    The rows ride along with their candidates, so nothing is joined and no column name is taken; overlapping
    spans are replaced as one, named by the first.  Texts without a span stay as they are, nulls included.
    """
    found = cut(candidates(docs, docs.columns), "pii-candidates")
    spans = select(F.col("spans"), train(found))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def write(text: Column, blocks: Column, spans: Column, ends: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            """Code points a to b, read from one block where they lie in one."""
            inside = F.substring(F.get(blocks, F.floor(a / BLOCK).cast("int")), a % BLOCK + 1, b - a)
            return F.when(b <= a, "").when(F.floor(a / BLOCK) == F.floor((b - 1) / BLOCK), inside).otherwise(F.substring(text, a + 1, b - a))

        def piece(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(ends, i - 1), F.lit(0))
            return F.concat(part(before, s["start"]), F.when(s["start"] >= before, F.get(names, s["kind"])).otherwise(""))

        rest = F.substring(text, F.element_at(ends, -1) + 1, F.lit(2**31 - 1))
        return F.concat(F.array_join(F.transform(spans, piece), ""), rest)

    def body(text: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.char_length(text) / BLOCK).cast("int")), lambda b: F.substring(text, b * BLOCK + 1, F.lit(BLOCK)))
        by_start = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return _let(by_start, lambda s: _let(blocks, lambda b: _let(running(F.transform(s, lambda x: x["end"]), F.greatest), lambda e: write(text, b, s, e))))

    found = found.select("row", spans.alias("_spans"))
    text = F.when(F.size("_spans") == 0, F.col("row.text")).otherwise(_let(F.col("row.text"), body))
    found = found.select(F.col("row").withField("text", text).alias("row"))
    return found.select("row.*")


def as_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark, sf_dir):
    """Spans of personal data in all documents; see ``find_personal_data`` for nulls, long texts, repeated rows and empty tables."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    of_kind = lambda i: F.filter("base", lambda s: s["kind"] == i)
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
