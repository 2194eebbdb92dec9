"""Personal data: validated patterns, and boosted trees over looser candidates."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.store import pinned

KINDS = ("email", "ip", "card", "phone")

# A run of local characters is entered at its start only (or where the last match ended), and
# repeats give nothing back: long runs cost one pass and no stack.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidate generators of high recall, by the kind they propose.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:[.:-][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9])[(]?[0-9]{1,4}[)]?(?:[\x20.-]{1,2}[(]?[0-9]{2,4}[)]?){2,4}(?![0-9])",
}
#: A cheap test before the patterns of a kind.
HINT = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9][.:-][0-9]", "card": r"[0-9][0-9\x20.-]{10}", "phone": r"[0-9]{4}|\+[0-9]"}
CUES = r"(?i)mail|contact|phone|tel|call|mobile|fax|card|visa|pay|account|host|server|addr|\bip\b"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """``array<struct<kind,start,end,got>>`` of a pattern's matches, in code points.

    Java's split walks the same matches as its find, so a match starts after the pieces and
    the matches before it.
    """
    got = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    walk = F.aggregate(
        F.arrays_zip(F.slice(pieces, 1, F.size(got)).alias("p"), got.alias("m")),
        F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<struct<kind:string,start:int,end:int,got:string>>)").alias("found")),
        lambda a, x: F.struct(
            (a["pos"] + F.length(x["p"]) + F.length(x["m"])).alias("pos"),
            F.array_append(
                a["found"],
                F.struct(F.lit(kind).alias("kind"), (a["pos"] + F.length(x["p"])).alias("start"), (a["pos"] + F.length(x["p"]) + F.length(x["m"])).alias("end"), x["m"].alias("got")),
            ).alias("found"),
        ),
        lambda a: a["found"],
    )
    return F.when(text.rlike(HINT[kind]), walk).otherwise(F.expr("cast(array() as array<struct<kind:string,start:int,end:int,got:string>>)"))


def _proposed(text: Column, kind: str) -> Column:
    """The candidates of a kind; numbers of 9 to 15 digits only for phones."""
    found = _spans(text, LOOSE[kind], kind)
    return F.filter(found, lambda x: F.length(_digits(x["got"])).between(9, 15)) if kind == "phone" else found


def _digits(got: Column) -> Column:
    return F.regexp_replace(got, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        d = digits.substr(F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str):
    """The test that a match of a strict pattern must pass."""

    def card(x):
        digits = _digits(x["got"])
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)

    return {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["got"].rlike(OCTETS),
        "card": card,
        "phone": lambda x: F.length(_digits(x["got"])).between(9, 15),
    }[kind]


def _of(kind: str):
    return lambda x: x["kind"] == kind


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _step(value: Column, bounds: tuple[int, ...]) -> Column:
    return sum((F.when(value >= b, 1).otherwise(0) for b in bounds), F.lit(0))


#: Features of a candidate and the number of values each can take; their product bounds the
#: rows that the driver sees in training.
FEATURES = {"kind": 4, "digits": 6, "length": 5, "breaks": 4, "cue": 2, "left": 3, "right": 3, "sound": 2}


def _sound(x: Column) -> Column:
    """Whether a candidate, whatever its separators, reads as its kind: a domain that ends in letters, octets, a checksum, a last group of four."""
    digits = _digits(x["got"])
    return (
        F.when(x["kind"] == "email", x["got"].rlike(r"(?:\.|dot[)\]]\x20?)[A-Za-z]{2,}$"))
        .when(x["kind"] == "ip", F.regexp_replace(x["got"], "[:-]", ".").rlike(OCTETS))
        .when(x["kind"] == "card", F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False))
        .otherwise(x["got"].rlike("[0-9]{4}$"))
    )


def _features(x: Column, text: Column) -> list[Column]:
    """Format and context of a candidate; signs that only base spans have (a plus, an ``@``) are left out."""
    kind = F.coalesce(*(F.when(x["kind"] == k, F.lit(i)) for i, k in enumerate(KINDS)))
    breaks = F.length(F.regexp_replace(x["got"], "[A-Za-z0-9]+", ""))
    before = F.when(x["start"] > 0, text.substr(F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24)))).otherwise("")
    after = text.substr(x["end"] + 1, F.lit(1))
    side = lambda c: F.when(c.rlike("[A-Za-z0-9]"), 2).when(c.rlike(r"\S"), 1).otherwise(0)
    return [
        kind, _step(F.length(_digits(x["got"])), (1, 7, 10, 13, 16)), _step(F.length(x["got"]), (8, 12, 16, 24)),
        _step(breaks, (1, 3, 5)), before.rlike(CUES).cast("int"), side(F.right(before, F.lit(1))), side(after), _sound(x).cast("int"),
    ]


def _hidden(x: Column) -> Column:
    """A base span as people write it to escape patterns: the ``@`` and dots spelled out, other separators, no plus."""
    got, form = x["got"], F.pmod(F.xxhash64(x["got"]), F.lit(3))
    pick = lambda *forms: F.when(form == 0, forms[0]).when(form == 1, forms[1]).otherwise(forms[2])
    host = F.substring_index(got, "@", -1)
    dots = pick(F.replace(host, F.lit("."), F.lit(" [dot] ")), F.replace(host, F.lit("."), F.lit("(dot)")), host)
    bare, rest = F.substring(got, 2, 1 << 20), F.regexp_replace(got, r"^\+[0-9]+[\x20.-]*", "")
    return (
        F.when(x["kind"] == "email", F.concat(F.substring_index(got, "@", 1), pick(F.lit(" [at] "), F.lit("(at)"), F.lit(" [at] ")), dots))
        .when(x["kind"] == "ip", F.replace(got, F.lit("."), pick(F.lit("-"), F.lit(":"), F.lit("-"))))
        .when(x["kind"] == "card", F.regexp_replace(_digits(got), "([0-9]{4})(?=[0-9])", "$1."))
        .otherwise(pick(bare, F.when(F.length(_digits(rest)) >= 9, rest).otherwise(bare), F.regexp_replace(F.regexp_replace(bare, r"[\x20().-]+", "."), r"^\.", "")))
    )


def _broken(x: Column) -> Column:
    """A hidden span that is no longer valid: letters gone from the domain's end, an octet too large, a wrong check digit, a last group too short."""
    new = x["new"]
    last = ((F.right(new, F.lit(1)).cast("int") + 1) % 10).cast("string")
    return (
        F.when(x["kind"] == "email", F.regexp_replace(new, "[A-Za-z]+$", "42"))
        .when(x["kind"] == "ip", F.regexp_replace(new, "^[0-9]+", "777"))
        .when(x["kind"] == "card", F.concat(F.left(new, F.length(new) - 1), last))
        .otherwise(F.left(new, F.length(new) - 1))
    )


def _rewritten(text: Column, base: Column) -> Column:
    """``struct<text,spans>``: a text with its base spans hidden, and where they stand in it.

    By a hash of the span, three in four are hidden whole (``good``) and one is broken. Of overlapping spans the first is hidden.
    """
    made = F.array_sort(F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["got"].alias("got"))))
    made = F.transform(made, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), _hidden(x).alias("new"), (F.pmod(F.xxhash64(x["got"], F.lit("broken")), F.lit(4)) > 0).alias("good")))
    made = F.transform(made, lambda x: x.withField("new", F.when(x["good"], x["new"]).otherwise(_broken(x))))
    at = lambda a, x: a["n"] + x["start"] - a["pos"]
    walk = F.aggregate(
        made,
        F.struct(F.lit(0).alias("pos"), F.lit(0).alias("n"), F.expr("cast(array() as array<string>)").alias("out"), F.expr("cast(array() as array<struct<kind:string,start:int,end:int,good:boolean>>)").alias("spans")),
        lambda a, x: F.when(
            x["start"] >= a["pos"],
            F.struct(
                x["end"].alias("pos"), (at(a, x) + F.length(x["new"])).alias("n"),
                F.array_append(a["out"], F.concat(text.substr(a["pos"] + 1, x["start"] - a["pos"]), x["new"])).alias("out"),
                F.array_append(a["spans"], F.struct(x["kind"].alias("kind"), at(a, x).alias("start"), (at(a, x) + F.length(x["new"])).alias("end"), x["good"].alias("good"))).alias("spans"),
            ),
        ).otherwise(a),
        lambda a: F.struct(F.concat(F.array_join(a["out"], ""), text.substr(a["pos"] + 1, F.length(text))).alias("text"), a["spans"].alias("spans")),
    )
    return F.when(F.size(base) > 0, walk)


def _rated(found: Column, text: Column, **more) -> Column:
    """Candidates with their features and what ``more`` tells of each."""
    return F.transform(
        found,
        lambda x: F.struct(
            x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.array(*_features(x, text)).alias("f"),
            *(tell(x).alias(name) for name, tell in more.items()),
        ),
    )


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(row, text, base, loose)``: each row with its base spans and the candidates of all generators with their features."""
    df = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = pinned(df, *(_spans(F.col("text"), STRICT[k], k).alias(f"s_{k}") for k in KINDS), *(_proposed(F.col("text"), k).alias(f"l_{k}") for k in KINDS))
    base = F.concat(*(F.filter(f"s_{k}", _valid(k)) for k in KINDS))
    df = pinned(df, base.alias("base"), F.concat(*(F.col(f"l_{k}") for k in KINDS)).alias("found"))
    rated = _rated(F.col("found"), F.col("text"), taken=lambda x: F.exists("base", lambda b: _overlap(x, b)))
    return pinned(df.select("row", "text", "base", "found"), F.when(F.size("found") > 0, rated).alias("loose")).drop("found")


def examples(found: DataFrame) -> DataFrame:
    """``(row, f, good, open)`` to learn from, for the rows of ``candidates``.

    Good are candidates over known spans rewritten so that no base pattern
    holds; over a broken span, or one of another kind, a candidate is bad. Candidates in the text as it is that
    touch no base span are open: nobody knows what they are.
    """
    df = pinned(found.select("row", "text", "base", "loose"), _rewritten(F.col("text"), F.col("base")).alias("w")).drop("text")
    df = pinned(df, *(F.when(F.col("w").isNotNull(), _proposed(F.col("w.text"), k)).alias(f"h_{k}") for k in KINDS))
    near = F.filter(F.concat(*(F.col(f"h_{k}") for k in KINDS)), lambda x: F.exists("w.spans", lambda b: _overlap(x, b)))
    df = pinned(df, near.alias("near"))
    hidden = _rated(F.col("near"), F.col("w.text"), good=lambda x: F.exists("w.spans", lambda b: _overlap(x, b) & (b["kind"] == x["kind"]) & b["good"]))
    df = pinned(df, hidden.alias("hidden"), F.filter("loose", lambda x: ~x["taken"]).alias("rest"))
    none = F.expr("cast(array() as array<struct<f:array<int>,good:boolean,open:boolean>>)")
    told = lambda name, good, unknown: F.coalesce(F.transform(name, lambda x: F.struct(x["f"].alias("f"), good(x).alias("good"), F.lit(unknown).alias("open"))), none)
    every = F.concat(told("hidden", lambda x: x["good"], False), told("rest", lambda x: F.lit(False), True))
    return df.select("row", F.inline(every))


@dataclass
class Trees:
    """Boosted regression trees of depth two over small whole-number features, and a threshold for each kind."""

    start: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    limits: dict[str, float] = field(default_factory=dict)

    def value(self, f: tuple) -> float:
        total = self.start
        for (i, a), (j, b, low, high), (k, c, low2, high2) in self.trees:
            total += (low if f[j] < b else high) if f[i] < a else (low2 if f[k] < c else high2)
        return total

    def column(self, f: Column) -> Column:
        total = F.lit(self.start)
        for (i, a), (j, b, low, high), (k, c, low2, high2) in self.trees:
            left = F.when(F.get(f, F.lit(j)) < b, F.lit(low)).otherwise(F.lit(high))
            right = F.when(F.get(f, F.lit(k)) < c, F.lit(low2)).otherwise(F.lit(high2))
            total = total + F.when(F.get(f, F.lit(i)) < a, left).otherwise(right)
        return total


def boost(cells: list[tuple[tuple, int, int]], rounds: int = 12, rate: float = 0.5, smooth: float = 1.0) -> Trees:
    """Trees for the cells ``(features, rows, positives)`` by Newton steps on the logistic loss."""
    n, good = sum(c[1] for c in cells), sum(c[2] for c in cells)
    model = Trees(math.log((good + 1) / (n - good + 1)))
    sums = [model.start] * len(cells)
    tests = [(i, a) for i, size in enumerate(FEATURES.values()) for a in range(1, size)]

    def gain(g, h):
        return g * g / (h + smooth)

    def best(rows, grad, hess):
        whole = sum(grad[r] for r in rows), sum(hess[r] for r in rows)
        top = (-1.0, tests[0], whole, (0.0, 0.0))
        for i, a in tests:
            low = [r for r in rows if cells[r][0][i] < a]
            g, h = sum(grad[r] for r in low), sum(hess[r] for r in low)
            other = whole[0] - g, whole[1] - h
            won = gain(g, h) + gain(*other)
            if won > top[0] + 1e-12:
                top = (won, (i, a), (g, h), other)
        return top

    step = lambda s: rate * s[0] / (s[1] + smooth)
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in sums]
        grad = [c[2] - c[1] * q for c, q in zip(cells, p)]
        hess = [c[1] * q * (1 - q) for c, q in zip(cells, p)]
        _, (i, a), _, _ = best(range(len(cells)), grad, hess)
        halves = [best([r for r in range(len(cells)) if (cells[r][0][i] < a) == low], grad, hess) for low in (True, False)]
        tree = ((i, a), *((*x[1], step(x[2]), step(x[3])) for x in halves))
        model.trees.append(tree)
        single = Trees(0.0, [tree])
        sums = [s + single.value(c[0]) for s, c in zip(sums, cells)]
    return model


def train(found: DataFrame, id_col: str = "doc_id", precision: float = 0.98, crowd: float = 1.0, least: int = 20) -> Trees:
    """Trees learned from all ``examples``, good ones against bad and open ones.

    Candidates are counted by feature values, at most ``prod(FEATURES.values())`` cells, and
    only the cells reach the driver. Documents in one fifth of the ids set the thresholds: per
    kind the lowest value at which, of what passes there, at least ``least`` are good, good ones are ``precision`` of
    the good and bad ones, and open ones are at most ``crowd`` times the good ones: data outside the base patterns is believed
    up to the frequency of known spans, beyond it candidates are look-alikes. Without such a value nothing of the kind is added.
    """
    fold = (F.pmod(F.xxhash64(f"row.{id_col}"), F.lit(5)) == 0).alias("held")
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    rows = examples(found).select(fold, "f", "good", "open").groupBy("held", "f").agg(F.count("*").alias("n"), count("good"), count("open")).collect()
    cells = sorted((tuple(r["f"]), r["n"], r["good"]) for r in rows if not r["held"])
    model = boost(cells) if cells else Trees()
    for i, kind in enumerate(KINDS):
        held = sorted(((model.value(tuple(r["f"])), r["n"], r["good"], r["open"]) for r in rows if r["held"] and r["f"][0] == i), reverse=True)
        n = good = unknown = 0
        for k, (value, more, ok, new) in enumerate(held):
            n, good, unknown = n + more, good + ok, unknown + new
            enough = good >= least and good >= precision * (n - unknown) and unknown <= crowd * good
            if enough and (k + 1 == len(held) or held[k + 1][0] < value):
                model.limits[kind] = value
    return model


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.98) -> DataFrame:
    """``(row, text, base, spans)`` for each row: base spans, and all spans by kind and start.

    Candidates whose value reaches the threshold of their kind and that touch no base span
    are added; of overlapping ones the higher value stays, then the earlier kind, then the
    earlier start. A null text counts as empty, an empty table gives no rows, repeated rows
    give equal results; columns of the input stay inside ``row``. Two scans, no shuffle of
    texts.
    """
    found = candidates(docs, text_col)
    model = train(found, id_col, precision)
    if not model.limits:
        return found.select("row", "text", "base", F.col("base").alias("spans"))
    limit = lambda x: F.coalesce(*(F.when(x["kind"] == k, F.lit(v)) for k, v in model.limits.items()))
    rated = F.transform(F.filter("loose", lambda x: ~x["taken"]), lambda x: F.struct((-model.column(x["f"])).alias("v"), F.coalesce(*(F.when(x["kind"] == k, F.lit(i)) for i, k in enumerate(KINDS))).alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    df = pinned(found, F.when(F.exists("loose", lambda x: ~x["taken"]), F.filter(rated, lambda x: -x["v"] >= limit(x))).alias("good"))
    better = lambda x, y: _overlap(x, y) & (F.struct(y["v"], y["k"], y["start"], y["end"]) < F.struct(x["v"], x["k"], x["start"], x["end"]))
    df = pinned(df, F.filter("good", lambda x: ~F.exists("good", lambda y: better(x, y))).alias("added"))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    added = F.coalesce(plain("added"), F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)"))
    df = pinned(df, F.concat(plain("base"), added).alias("order"))
    every = F.concat(*(F.array_sort(F.filter("order", _of(k))) for k in KINDS))
    return pinned(df, every.alias("spans")).select("row", "text", "base", "spans")


def listed(spans: Column | str) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """A text with each span, or run of overlapping spans, replaced by ``[KIND]`` of its first."""
    flat = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.upper(x["kind"]).alias("kind"))))
    walk = F.aggregate(
        flat,
        F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda a, x: F.when(
            x["start"] >= a["pos"],
            F.struct(x["end"].alias("pos"), F.array_append(a["out"], F.concat(text.substr(a["pos"] + 1, x["start"] - a["pos"]), F.lit("["), x["kind"], F.lit("]"))).alias("out")),
        ).otherwise(F.struct(F.greatest(a["pos"], x["end"]).alias("pos"), a["out"].alias("out"))),
        lambda a: F.concat(F.array_join(a["out"], ""), text.substr(a["pos"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, walk).otherwise(text)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in the text; a null text stays null, texts without spans stay as they are."""
    found = find_pii(docs, id_col, text_col)
    clean = F.when(F.col(f"row.{text_col}").isNotNull(), redacted(F.col("text"), F.col("spans")))
    return found.select(F.col("row").withField(text_col, clean).alias("row")).select("row.*")
